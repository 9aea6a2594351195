"""From raw documents to packed sequences: five stages, each on what the last one kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmark.llm import mixing, neardup, packing, quality, substring
from factmark.llm.queries import tokenizer_path
from factmark.session import materialise, scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Hashes order and boosted tables judge here, which SQL cannot express.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts, null ids
    and repeated rows are judged like any other row, equal texts alike; columns beyond those
    of documents go; an empty table stays empty."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels, carry=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """One row of those with equal ``doc_id`` and ``text``, and a ``_key`` of its own.

    The key is the id where it stands on one text; other texts of that id, and texts
    without an id, have a hash above 2**62, so that they come after usual ids."""
    digest = F.xxhash64("doc_id", "text")
    odd = materialise(  # small as a rule: joined without a shuffle
        docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.min(digest).alias("_first"))
        .where("_rows > 1 OR _id IS NULL").select("_id", "_first"), "odd-ids")
    if odd.isEmpty():
        return docs.select(*COLUMNS, F.col("doc_id").alias("_key"))
    own = F.shiftright(digest, 2).bitwiseAND((1 << 62) - 1).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(*COLUMNS).join(odd, F.col("doc_id") == F.col("_id"), "left")
    single = F.col("doc_id").isNotNull() & F.col("_id").isNull()
    repeated = (rows.where(~single)
                .withColumn("_key", F.when(digest == F.col("_first"), F.col("doc_id")).otherwise(own))
                .groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*", "_key"))
    return rows.where(single).select(*COLUMNS, F.col("doc_id").alias("_key")).union(repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, five-word shingles alike to 0.8. Rows without
    an id, or of one id, are rows of their own; those alike in id and text are one."""
    ship_package(spark)
    rows = _keyed(docs)
    kept = neardup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), width=5,
                                   percent=80).where("kept").select(F.col("doc_id").alias("_kept"))
    return rows.join(kept, F.col("_key") == F.col("_kept"), "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document holds; a document that had words and
    has none left goes. Rows without an id come last, among them in the order of a hash."""
    ship_package(spark)
    rows = _keyed(docs).withColumnRenamed("doc_id", "_own").withColumnRenamed("_key", "doc_id")
    cut = substring.remove_repeats(rows, window=13, carry=["lang", "source", "_own"])
    return cut.where("n_words = 0 OR n_removed < n_words").withColumn("doc_id", F.col("_own")) \
        .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows may repeat and share an id; those
    without words, a null text among them, are taken never. Rows that repeat in the input
    are rows of their own, null sources are a source, the last one; an empty table stays
    empty. Of two documents of one id, which lies first follows from a hash of both."""
    ship_package(spark)
    return mixing.mixed_copies(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 ids: a row per piece, not per
    document. Copies of a document are packed each; a null or empty text is its end id."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_path(), window=2048)


STAGES = [("quality classifier", keep_good), ("MinHash near-dedup", drop_near_copies),
          ("substring dedup", drop_repeats), ("mixing", mix_sources),
          ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
