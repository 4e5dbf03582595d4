"""Subpackage of loomgraph: streaming."""
