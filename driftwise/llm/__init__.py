"""Training-data operators: one module per operator, the named queries in ``queries``.

Nothing outside this package imports it; the queries reach the driver through ``__spark_entry__.py``.
"""
