"""An append-only fact table on Parquet whose loads are immutable, numbered versions.

Layout, below a root folder:

* ``facts/dataset_id=/version_number=/load=`` holds the facts of a load;
* ``index/dataset_id=/bucket=/version_number=/load=`` holds the first report of every
  period that a load was the first to report, or reported with an earlier knowledge date;
* ``versions/`` holds one JSON file per version: its catalogue row.

A load writes facts and index into folders of its own, then commits by giving its finished
catalogue file the name of the next version, which fails where that name is taken. A load
that dies before leaves nothing that is read; one that loses the race marks its facts anew
against what the winner stored and takes the number after.
"""
from __future__ import annotations

import datetime
import json
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import PointInTimeError, ResearchError
from ..operators.bitemporal import KEY, mark_restatements, require_point_in_time
from ..operators.fingerprint import multiset_hash
from ..operators.validation import split_facts
from ..schemas import FACT_IN, FACTS, INDEX, VERSIONS, conform
from ..session import discard, materialise

# The columns whose content identifies a load.
CONTENT = ["entity_id", "field", "value", "effective_date", "knowledge_date"]
#: Parts of the first-value index of a dataset. A load reads those its periods fall into.
BUCKETS = 64


def _folder(spark: SparkSession, dataset_id: str) -> str:
    """The folder that a partitioned write gives a dataset."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"dataset_id={names.escapePathName(dataset_id)}"


def versions(spark: SparkSession, root: str, dataset_id: str | None = None) -> DataFrame:
    """The version catalogue: one row per load."""
    try:
        catalogue = spark.read.schema(VERSIONS).json(f"{root}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        catalogue = spark.createDataFrame([], VERSIONS)
    if dataset_id is not None:
        catalogue = catalogue.where(F.col("dataset_id") == dataset_id)
    return catalogue.orderBy("dataset_id", "version_number")


def current_versions(catalogue: DataFrame) -> DataFrame:
    """The newest version of every dataset."""
    return catalogue.groupBy("dataset_id").agg(
        F.max_by("version_id", "version_number").alias("version_id"),
        F.max("version_number").alias("version_number"))


def read_facts(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Facts of all committed versions of a dataset.

    Only their folders are listed and read, whatever else lies beside them.
    """
    loads = versions(spark, root, dataset_id).select("version_number", "load").collect()
    if not loads:  # a row per load, small by nature
        return spark.createDataFrame([], FACTS)
    base, own = f"{root}/facts", _folder(spark, dataset_id)
    folders = [f"{base}/{own}/version_number={r.version_number}/load={r.load}" for r in loads]
    return conform(spark.read.schema(FACTS).option("basePath", base).parquet(*folders), FACTS)


def read(spark: SparkSession, root: str, dataset_id: str, datasets: DataFrame) -> DataFrame:
    """The facts of a dataset that the catalogue ``datasets`` declares point-in-time; any
    other is refused before anything is read."""
    require_point_in_time(datasets, dataset_id)
    return read_facts(spark, root, dataset_id)


def content_summary(facts: DataFrame) -> DataFrame:
    """Row count, newest knowledge date and content hash of a load, in one pass."""
    return facts.agg(F.count(F.lit(1)).alias("row_count"),
                     F.max("knowledge_date").alias("knowledge_date"),
                     multiset_hash(CONTENT).alias("content_hash"))


# --- first values --------------------------------------------------------------------------

def _bucketed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int"))


def first_values(spark: SparkSession, root: str, dataset_id: str,
                 buckets: list[int] | None = None) -> DataFrame:
    """The first report of every stored period, or of those in the given buckets: one or a
    few rows per period, the least of which counts. No fact file is read."""
    base = f"{root}/index"
    try:
        rows = spark.read.schema(INDEX).option("basePath", base).parquet(
            f"{base}/{_folder(spark, dataset_id)}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    committed = versions(spark, root, dataset_id).select("version_number", "load")
    return rows.join(committed, ["version_number", "load"], "left_semi")


def _news(batch: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """First reports of the batch that the index lacks or has with a later knowledge date."""
    order = F.struct("knowledge_date", "value")
    first = batch.groupBy(*KEY).agg(F.min(order).alias("first"))
    before = known.groupBy(*KEY).agg(F.min("knowledge_date").alias("before"))
    return _bucketed(first.join(before, KEY, "left").where(
        F.col("before").isNull() | (F.col("first.knowledge_date") < F.col("before"))).select(
            *KEY, F.col("first.value").alias("value"),
            F.col("first.knowledge_date").alias("knowledge_date"),
            F.lit(number).alias("version_number")))


# --- loads ---------------------------------------------------------------------------------

def append_facts(spark: SparkSession, root: str, dataset_id: str, facts: DataFrame,
                 datasets: DataFrame, note: str | None = None, mark: bool = True) -> str:
    """Append a load as the next version and return its id.

    Restatements are marked against the first values stored and inside the batch, at the
    cost of the batch: of what is stored only the index is read, and of it the buckets that
    the batch falls into. A load whose content is already stored returns the existing
    version and writes nothing. Loads may run at the same time, in any number of sessions:
    each gets a number of its own and is marked against all before it.
    """
    if datasets.where(F.col("dataset_id") == dataset_id).isEmpty():
        raise PointInTimeError(f"cannot load {dataset_id!r}: the catalogue of datasets does not name it")
    # The load is read to be hashed, to be marked and to be written: the version must hold
    # exactly the rows its hash describes, so they are fixed first.
    facts = materialise(conform(facts, FACT_IN), "load")
    for row in split_facts(facts)[1].take(1):
        raise PointInTimeError(f"a fact of this load cannot be stored: {row.reason} "
                               f"(entity {row.entity_id!r}, field {row.field!r})")
    summary = content_summary(facts).first()
    if not summary.row_count:
        raise ResearchError(f"nothing to store for {dataset_id!r}: the load is empty")
    buckets = [r.bucket for r in _bucketed(facts).select("bucket").distinct().collect()]
    same = F.col("content_hash") == summary.content_hash
    while True:
        seen = versions(spark, root, dataset_id).agg(
            F.min(F.when(same, F.struct("version_number", "version_id"))).alias("same"),
            F.max("version_number").alias("newest")).first()
        if seen.same is not None:
            return seen.same.version_id
        number, load = 1 + (seen.newest or 0), uuid.uuid4().hex
        folders = _write(spark, root, dataset_id, facts, buckets, mark, number, load)
        entry = {"dataset_id": dataset_id, "version_number": number,
                 "version_id": f"{dataset_id}@v{number}", "content_hash": summary.content_hash,
                 "row_count": summary.row_count, "knowledge_date": str(summary.knowledge_date),
                 "note": note, "created_at": datetime.datetime.now(datetime.UTC).isoformat(),
                 "load": load}
        if _commit(spark, root, entry):
            return entry["version_id"]
        for folder in folders:  # another load came first: mark anew against its facts
            discard(spark, folder, "load=")


def _write(spark: SparkSession, root: str, dataset_id: str, facts: DataFrame, buckets: list[int],
           mark: bool, number: int, load: str) -> list[str]:
    """Facts and first values of a load, in folders that nobody reads before its commit."""
    own = {"dataset_id": F.lit(dataset_id), "version_number": F.lit(number), "load": F.lit(load)}
    known = first_values(spark, root, dataset_id, buckets)
    if mark:
        facts = mark_restatements(facts, known)
    # Ordinals are unique inside the version, not dense: numbering them densely would
    # sort the whole load for no reader's benefit.
    numbered = conform(facts.withColumns({
        "is_restatement": F.coalesce("is_restatement", F.lit(False)),
        "fact_ord": F.monotonically_increasing_id(), **own}), FACTS)
    parts = ["dataset_id", "version_number", "load"]
    numbered.withColumn("load", own["load"]).write.mode("append").partitionBy(*parts).parquet(
        f"{root}/facts")
    place = _folder(spark, dataset_id)
    _news(facts, known, number).withColumns(own).repartition("bucket").write.mode("append") \
        .partitionBy("dataset_id", "bucket", "version_number", "load").parquet(f"{root}/index")
    return [f"{root}/facts/{place}/version_number={number}/load={load}",
            *(f"{root}/index/{place}/bucket={b}/version_number={number}/load={load}"
              for b in buckets)]


def _commit(spark: SparkSession, root: str, entry: dict) -> bool:
    """Publish a catalogue row under its version's name; False where the name is taken."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = f"{root}/versions"
    name = f"{quote(entry['dataset_id'], safe='')}.v{entry['version_number']:010d}.json"
    draft, final = (hadoop.Path(f"{folder}/{n}") for n in (f".{uuid.uuid4().hex}.draft", name))
    conf = spark._jsc.hadoopConfiguration()
    files = draft.getFileSystem(conf)
    out = files.create(draft, False)
    out.write(bytearray((json.dumps(entry) + "\n").encode()))
    out.close()
    whole = spark._jvm.java.net.URI.create(files.makeQualified(draft).toString())
    context = hadoop.FileContext.getFileContext(whole, conf)
    never = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # no overwriting
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), never)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        files.delete(draft, False)
        return False


def fact_ids(facts: DataFrame) -> DataFrame:
    """fact_id = dataset@version#ordinal."""
    return facts.withColumn("fact_id", F.concat(
        "dataset_id", F.lit("@v"), F.col("version_number").cast("string"), F.lit("#"),
        F.col("fact_ord").cast("string")))
