"""Named queries over the given tables, one module per area.

Queries read money as DECIMAL so that sums are the same whatever the partitioning;
the few statistics that stay floating point are given in single precision.
"""
