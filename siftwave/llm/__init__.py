"""Training-data operators: each module is one operator, `registry` holds the registered queries.

Nothing outside this subpackage imports it.
"""
