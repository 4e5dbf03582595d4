"""Subpackage of loomgraph: plans."""
