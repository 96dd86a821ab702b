"""Operators for large training-text corpora.

Everything here is self-contained: nothing else in the library imports this package.
"""
