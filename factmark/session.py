"""Session settings and the one place scratch storage is chosen."""
from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ResearchError

# Settings a cluster session should carry. Skewed join keys are split at run
# time by AQE, which also turns a join into a broadcast only after it has
# measured the side's shuffled size, so no operator hints a broadcast of data
# that grows.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of long texts: a batch for Python is bounded in bytes, not only in rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def local_session(cores: str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("factmark")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", "8"))
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, which their Python workers import by name.

    Without it a worker started in another folder has no such module. Once per context.
    """
    context = spark.sparkContext
    if getattr(context, "_factmark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    target = os.path.join(tempfile.mkdtemp(prefix="factmark-"), "factmark.zip")
    Path(target).write_bytes(data.getvalue())
    context.addPyFile(target)  # Spark copies it to each executor
    context._factmark_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster
    a machine-local folder would be lost with its machine, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not root:
            if not context.master.startswith("local"):
                raise ResearchError("set spark.checkpoint.dir to a shared folder")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(root)
    return root or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/factmark-{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str, mark: str = "factmark-") -> None:
    """Remove a folder of intermediate data, once nothing reads it any more. Its own name
    has to begin with ``mark``, as those that ``scratch_path`` gives do."""
    if not path.rstrip("/").rpartition("/")[2].startswith(mark):
        raise ResearchError(f"{path} is not intermediate data")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the checkpoint folder and read it back.

    For results that several later stages read: the work above is not repeated, every
    reader sees the same rows even if a lost executor forces a recomputation, and
    Parquet still lets each of them read only its columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables an operator writes for itself; all are removed when it is done with them.

    ``table`` cuts lineage as ``materialise`` does. ``parts`` merges the tasks of the stage
    that writes, for tables whose size is known to need fewer than there are shuffle
    partitions. Tables that the operator's own lazy result reads are ``kept``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame, parts: int | None = None, kept: bool = False) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not kept:
            self._paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables nothing reads any more; others are left alone."""
        for table in tables:
            if held := self._paths.pop(id(table), None):
                discard(self.spark, held[1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in list(self._paths.values())])
