"""Subpackage of loomgraph: operators."""
