"""Composed jobs, and the bindings that run every operator on the driver's tables."""
