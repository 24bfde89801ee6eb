"""Training-data operators: one module per operator, plus the registry of their queries.

Nothing else in the library imports this subpackage.
"""
