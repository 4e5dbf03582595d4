"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator lives in a module of its own with a
general interface; ``queries.py`` holds the thin registered queries.
"""
