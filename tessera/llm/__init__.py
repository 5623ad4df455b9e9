"""Operators for building training corpora.

Nothing else in the library imports this subpackage; see the README for the
contract of each operator.
"""
