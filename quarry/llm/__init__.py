"""Operators for preparing language-model training data.

Nothing else in Quarry imports this subpackage, so it can be removed as a whole.
"""
