"""Streams over several micro-batches must equal the batch operators."""
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factmark.operators import factors
from factmark.schemas import DATASETS
from factmark.sources import versions
from factmark.streaming import bars, ingest

BAR = "entity_id string, ts timestamp, close double"


def ts(i):
    return datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i)


def run(spark, tmp_path, batches, schema, transform, out_schema):
    """Feed each list of rows as its own micro-batch, restarting the query in between."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        bars.run_to_files(transform(stream), out, state)
    return spark.read.schema(out_schema).parquet(out)


def test_streamed_momentum_equals_batch_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    series = {n: 100 * np.cumprod(1 + rng.normal(0, 0.02, 50)) for n in "ab"}
    rows = [(n, ts(i), float(v)) for n, p in series.items() for i, v in enumerate(p)]
    cuts = [(0, 7), (7, 30), (30, 50)]
    batches = [[r for r in rows if ts(lo) <= r[1] < ts(hi)] for lo, hi in cuts]
    # A straggler of the first batch arrives with the last, and one bar twice.
    batches[2] += [("a", ts(3), 1e6), ("b", ts(40), 1e6)]
    out = run(spark, tmp_path, batches, BAR,
              lambda s: bars.stream_momentum(s, 10, 2), bars.SIGNAL_OUT)
    done, late = bars.split_late(out)
    assert {(r.entity_id, r.ts) for r in late.collect()} == {("a", ts(3)), ("b", ts(40))}
    panel = spark.createDataFrame(rows, BAR).select(
        "entity_id", F.to_date("ts").alias("effective_date"), F.col("close").alias("value"))
    want = {(r.entity_id, r.effective_date): r.factor
            for r in factors.momentum(panel, 10, 2).collect()}
    got = {(r.entity_id, r.ts.date()): r for r in done.collect()}
    assert set(got) == set(want)
    for key, value in want.items():
        assert (got[key].signal is None) if value is None else got[key].signal == pytest.approx(value)
        assert got[key].position == int(value is not None and value > 0)
    for name in series:
        position = [got[name, ts(i).date()].position for i in range(50)]
        changed = [got[name, ts(i).date()].changed for i in range(50)]
        assert changed == [p != b for p, b in zip(position, [0] + position[:-1])]


def test_streamed_audit_counts_across_batches(spark, tmp_path):
    schema = "entity_id string, ts timestamp, visible long, newest_visible timestamp"
    batches = [[("a", ts(0), 1, ts(0)), ("a", ts(1), 2, ts(1))],
               [("a", ts(2), 4, ts(2)), ("a", ts(3), 3, ts(4))], [("a", ts(1), 1, ts(1))]]
    out = run(spark, tmp_path, batches, schema, bars.stream_lookahead_audit, bars.AUDIT_OUT)
    rows = [(r.delivered, r.future_visible, r.extra_visible, r.late)
            for r in out.orderBy("delivered").collect()]
    assert rows == [(1, False, False, False), (2, False, False, False), (3, False, True, False),
                    (4, True, False, False), (5, False, False, True)]


def test_streamed_ingest_versions_marks_and_replays(spark, tmp_path, facts_of):
    source, root, state, bad = (str(tmp_path / n) for n in ("in", "store", "state", "bad"))
    catalog = spark.createDataFrame([("d", None, True, None)], DATASETS)
    loads = [[("A", "x", 1.0, "2020-01-01", "2020-02-01"), ("A", "x", 1.0, "2020-01-02", "2020-01-01")],
             [("A", "x", 2.0, "2020-01-01", "2020-03-01")]]

    def ingest_all(checkpoint):
        stream = spark.readStream.schema(facts_of([]).drop("version_number").schema).parquet(source)
        ingest.stream_fact_ingest(stream, root, "d", catalog, checkpoint, bad).awaitTermination()

    for rows in loads:
        facts_of(rows).drop("version_number").coalesce(1).write.mode("append").parquet(source)
        ingest_all(state)
    stored = {(r.version_number, r.value): r.is_restatement
              for r in versions.read_facts(spark, root, "d").collect()}
    assert stored == {(1, 1.0): False, (2, 2.0): True}
    assert spark.read.parquet(bad).count() == 1
    # The same batch delivered again finds its content already stored.
    ingest.append_facts(spark, root, "d", facts_of(loads[1]).drop("version_number"), catalog)
    assert versions.versions(spark, root).count() == 2
