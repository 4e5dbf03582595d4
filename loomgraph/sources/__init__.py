"""Subpackage of loomgraph: sources."""
