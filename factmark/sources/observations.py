"""Observation CSVs (one series per file) read as one distributed scan.

Each file starts with a header ``observation_date,<series>``. A lone period or an
empty cell marks an observation that does not exist: it is dropped, never carried
forward. Header lines are recognised by content, so a large file can be split.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FACT_IN, conform

MISSING = "."
# How entity and vintage are written in a file's path.
ENTITY_PATTERN = r"([^/]+)\.csv$"
VINTAGE_PATTERN = r"_(\d{8})[^/]*\.csv$"
VINTAGE_ENTITY_PATTERN = r"([^/]+)_\d{8}[^/]*\.csv$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, observed, raw, is_header) for every non-blank line with two cells."""
    lines = (spark.read.option("recursiveFileLookup", "true")
             .schema("observed string, raw string").option("mode", "PERMISSIVE").csv(path)
             .select(F.col("_metadata.file_path").alias("path"), F.trim("observed").alias("observed"),
                     F.trim("raw").alias("raw")))
    return lines.withColumn("is_header", F.coalesce(
        F.lower("observed").startswith("observation"), F.lit(False)))


def _from_path(pattern: str) -> Column:
    """Part of a file's path, as it was before the path was written as a URL."""
    part = F.regexp_extract("path", pattern, 1)
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def header_problems(spark: SparkSession, path: str) -> DataFrame:
    """Files without the expected header or without any observation."""
    per = _lines(spark, path).groupBy("path").agg(
        F.max(F.coalesce("is_header", F.lit(False)).cast("int")).alias("headers"),
        F.sum((~F.coalesce("is_header", F.lit(False))).cast("long")).alias("rows"))
    reason = (F.when(F.col("headers") == 0, "unexpected CSV header")
              .when(F.col("rows") == 0, "header and no observations"))
    return per.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def _observations(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(
        ~F.col("is_header") & F.col("raw").isNotNull() & ~F.col("raw").isin(MISSING, ""))
    return rows.withColumn("value", F.expr("try_cast(raw AS double)")).withColumn(
        "effective_date", F.expr("try_cast(observed AS date)"))


def _split(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("value").isNull() | F.col("effective_date").isNull() | (F.col("entity_id") == "")
    return (conform(facts.where(~bad), FACT_IN),
            facts.where(bad).select("path", "observed", "raw",
                                    F.lit("not a date and a number").alias("reason")))


def observation_facts(spark: SparkSession, path: str, field: str = "close",
                      source: str = "FRED", entity_pattern: str = ENTITY_PATTERN
                      ) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected lines). A closing level is known at the close, so both dates agree."""
    facts = _observations(spark, path).withColumns({
        "entity_id": _from_path(entity_pattern), "field": F.lit(field),
        "knowledge_date": F.col("effective_date"), "source": F.lit(source)})
    return _split(facts)


def vintage_facts(spark: SparkSession, path: str, field: str = "value", source: str = "ALFRED",
                  entity_pattern: str = VINTAGE_ENTITY_PATTERN,
                  vintage_pattern: str = VINTAGE_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(facts, rejected lines) of many vintages at once: known on the vintage date.

    A vintage cannot hold observations dated after it was taken; such rows are dropped.
    """
    stamp = F.regexp_extract("path", vintage_pattern, 1)
    facts = _observations(spark, path).withColumns({
        "entity_id": _from_path(entity_pattern), "field": F.lit(field),
        "knowledge_date": F.to_date(F.when(stamp != "", stamp), "yyyyMMdd")})
    facts = facts.withColumn("source", F.concat(
        F.lit(source + "@"), F.col("knowledge_date").cast("string")))
    good, bad = _split(facts.where(
        F.col("effective_date").isNull() | F.col("knowledge_date").isNull()
        | (F.col("effective_date") <= F.col("knowledge_date"))))
    undated = facts.where(F.col("knowledge_date").isNull() & F.col("value").isNotNull()
                          & F.col("effective_date").isNotNull() & (F.col("entity_id") != ""))
    return (good.where(F.col("knowledge_date").isNotNull()), bad.union(undated.select(
        "path", "observed", "raw", F.lit("no vintage date in the path").alias("reason"))))
