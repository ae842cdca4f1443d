"""Operators for building training corpora: each module holds one operator with a general interface.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
