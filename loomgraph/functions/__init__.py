"""Subpackage of loomgraph: functions."""
