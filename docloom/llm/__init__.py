"""Operators for large training-data pipelines; nothing else in docloom imports this subpackage."""
