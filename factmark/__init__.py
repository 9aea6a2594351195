"""factmark: point-in-time research analytics expressed as Spark jobs.

Every operator takes DataFrames and returns a DataFrame (or takes Columns and
returns a Column); nothing here owns a connection, a file handle or a loop over
entities.
"""
__version__ = "0.1.0"
