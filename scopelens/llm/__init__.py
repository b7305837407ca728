"""Training-data operators: one module per operator, and ``registry`` for their queries and SQL.

Nothing outside this package imports it, so it can be removed as a whole.
"""
