"""Identity of an archive: a digest per file, compared with a recorded manifest."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of a folder of documents.

    A file is one row, so this is for archives of many documents; files beyond
    ``spark.sql.sources.binaryFile.maxLength`` fail rather than being cut short.
    """
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content"))


def manifest(contents: DataFrame) -> DataFrame:
    """(name, sha256, bytes, version_id) with version_id = name@first 16 hex digits."""
    return contents.select(
        "name", F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").cast("long").alias("bytes"),
    ).withColumn("version_id", F.concat("name", F.lit("@"), F.substring("sha256", 1, 16)))


#: Rows that one step of ``verify`` writes out for a name at once.
STEP = 4096


def verify(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Every document in either manifest with what became of it: same, changed, missing, new.

    One row per document, also where several have one name or none: equal digests of a name
    are paired first, what is left of it one with one, and the rest of the longer side is
    missing or new. Documents are counted per name and digest, not joined by name.
    """
    sides = current.select("name", "sha256", F.lit(1).alias("now"), F.lit(0).alias("then")).union(
        recorded.select("name", "sha256", F.lit(0), F.lit(1)))
    digests = sides.groupBy("name", "sha256").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    both = F.least("now", "then")
    names = digests.groupBy("name").agg(
        F.sum(both).alias("same"), F.sum(F.col("now") - both).alias("now"),
        F.sum(F.col("then") - both).alias("then"))
    counts = {"same": F.col("same"), "changed": both, "missing": F.col("then") - both,
              "new": F.col("now") - both}
    states = names.select("name", F.explode(F.array(*[
        F.struct(F.lit(state).alias("state"), n.alias("n")) for state, n in counts.items()])).alias("s"))
    steps = states.select("name", "s.*").where("n > 0").select(
        "name", "state", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1,
                                                   F.lit(STEP).cast("long"))).alias("from"))
    return steps.select("name", F.explode(F.array_repeat("state", F.least(
        F.lit(STEP), F.col("n") - F.col("from")).cast("int"))).alias("state"))
