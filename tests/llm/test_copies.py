"""Rows that are alike and many: no task holds them all, and results stay what they are."""
from collections import Counter

import brute
import pytest

from factmark.llm import copies, labels, mixing, sharding, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def hot(monkeypatch):
    for module in (copies, mixing, sharding, substring):
        monkeypatch.setattr(module, "HOT", 20)


def rows(spark, parts=6):
    v = brute.vocabulary(80)
    same = " ".join(v[:40])
    out = [(None, same, "x", "s", 1)] * 150 + [(7, same, "x", "s", 1)] * 150
    out += [(100 + i, " ".join(v[i:i + 30]), "x", f"s{i % 3}", 1) for i in range(40)] + [(5, None, None, None, None)]
    return spark.createDataFrame(out, SCHEMA).repartition(parts), out


def test_copies_are_numbered_once_each(spark, hot):
    df = spark.range(500).selectExpr("id % 7 AS k", "id AS v").union(
        spark.range(300).selectExpr("99L AS k", "id AS v")).repartition(5)
    got = Counter((r.k, r._copy) for r in copies.numbered(df, "k").collect())
    assert max(got.values()) == 1
    assert {c for k, c in got if k == 99} == set(range(300))
    few = copies.numbered(df.where("k = 3 AND v < 70"), "k")
    assert {r._copy for r in few.collect()} == {0}


def test_repeated_rows_do_not_change_removal(spark, hot):
    df, out = rows(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(df, 13).collect())
    assert sum(got.values()) == len(out)
    assert {k[2] for k in got if k[0] == 7} == {0}  # equal ids never remove each other
    assert {k[2] for k in got if k[0] is None} == {40}  # null ids come after all others


def test_repeated_rows_are_mixed_and_sharded_whole(spark, hot):
    df, out = rows(spark)
    mixed = mixing.mix(df, carry=["source"]).collect()
    assert len(mixed) == len(out) and all(0 <= r.taken <= 3 * r.size for r in mixed)
    by_source = Counter()
    for r in mixed:
        by_source[r.source, r.target] += r.taken
    assert all(abs(taken - target) <= 16 * 4 for (_, target), taken in by_source.items())
    shards = sharding.shard_by_size(df, 4).collect()
    slots = {}
    for r in shards:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(shards) == len(out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_sampled_id_brings_one_row(spark):
    df, _ = rows(spark)
    marks = spark.createDataFrame([(7, 1), (100, 0), (101, 1)], "doc_id long, quality int")
    chosen = labels.sample(marks, "quality", 100)
    got = labels.labelled_texts(df.withColumn("label", df.n_chars), chosen).collect()
    assert len(got) == len({r.doc_id for r in got}) == chosen.count()
