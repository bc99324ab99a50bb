"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it: the rest of the library works with the folder deleted.
"""
