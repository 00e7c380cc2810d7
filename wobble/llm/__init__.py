"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""
