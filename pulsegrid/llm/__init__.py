"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
