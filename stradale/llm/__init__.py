"""Training-data operators: one module per operator, plus the query registry.

Nothing outside this subpackage imports it.
"""
