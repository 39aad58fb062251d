"""Feature blocks: one module per raw table.

Each module offers ``features`` (the engineered columns alone) and ``block``
(generic aggregates and engineered columns from the same grouped aggregate).
"""
