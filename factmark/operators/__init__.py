"""DataFrame operators.

A *panel* carries at most one row per (entity, date): it is always produced by an
aggregation on that key. Windows partitioned by entity therefore hold at most one
row per calendar day of the data, however many raw facts the entity has. Data with
no such bound (labels, cross-sections, event logs) is ordered with
``ordering.with_position`` or reduced with aggregates instead of a window.
"""
