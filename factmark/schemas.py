"""Column contracts. All measures are DOUBLE, both time axes are DATE."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STR, DBL, LNG, INT, DAY, TS, FLAG = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(),
    T.DateType(), T.TimestampType(), T.BooleanType())


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


FACT_IN = _schema(
    ("entity_id", STR, "required"), ("field", STR, "required"), ("value", DBL),
    ("effective_date", DAY, "required"), ("knowledge_date", DAY, "required"),
    ("source", STR), ("is_restatement", FLAG))

FACTS = _schema(
    ("dataset_id", STR, "required"), ("version_number", INT, "required"),
    ("fact_ord", LNG, "required"), *[(f.name, f.dataType) for f in FACT_IN.fields])

DATASETS = _schema(
    ("dataset_id", STR, "required"), ("description", STR),
    ("point_in_time", FLAG, "required"), ("pit_note", STR))

VERSIONS = _schema(
    ("dataset_id", STR), ("version_number", INT), ("version_id", STR),
    ("content_hash", STR), ("row_count", LNG), ("knowledge_date", DAY),
    ("note", STR), ("created_at", TS), ("load", STR))

INDEX = _schema(
    *[(f.name, f.dataType) for f in FACT_IN.fields[:5]], ("version_number", INT), ("load", STR),
    ("bucket", INT))

PANEL = _schema(("entity_id", STR), ("effective_date", DAY), ("value", DBL))

LABELS = _schema(("series_id", STR), ("idx", LNG), ("t0", DAY), ("t1", DAY))

TRIALS = _schema(
    ("trial_id", STR), ("dataset_id", STR), ("dataset_version", STR),
    ("search_id", STR), ("researcher", STR), ("strategy", STR),
    ("params", T.MapType(STR, STR)), ("started_at", TS), ("sharpe", DBL),
    ("n_observations", LNG), ("outcome_at", TS))

RUNS = _schema(
    ("run_id", STR), ("strategy", STR), ("factors", T.ArrayType(STR)),
    ("params", T.MapType(STR, STR)), ("seeds", T.MapType(STR, LNG)),
    ("dataset_versions", T.ArrayType(STR)), ("started_at", TS), ("ended_at", TS),
    ("outcome", STR), ("result_hash", STR))

INSTRUMENTS = _schema(
    ("symbol", STR), ("price", DBL), ("adv", DBL), ("daily_volatility", DBL),
    ("shares_outstanding", DBL), ("spread", DBL), ("commission", DBL),
    ("borrow_available", DBL), ("borrow_fee_annual", DBL))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``: cast what is there, NULL what is absent."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])
