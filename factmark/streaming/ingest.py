"""Fact files arriving over time, each micro-batch appended as one immutable version."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.validation import split_facts
from ..sources.versions import append_facts


def stream_fact_ingest(facts: DataFrame, root: str, dataset_id: str, datasets: DataFrame,
                       checkpoint: str, rejected: str | None = None):
    """Start the ingest and return its query.

    Every micro-batch is marked against what is stored and appended. A batch replayed
    after a failure has the same content hash as the version it already wrote, so it
    adds nothing. Invalid facts go to ``rejected`` when a path is given.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_facts(batch)
        if rejected is not None:
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
        if not good.isEmpty():
            append_facts(batch.sparkSession, root, dataset_id, good, datasets,
                         note=f"micro-batch {batch_id}")

    return (facts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
