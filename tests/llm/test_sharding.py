import random
import zlib
from collections import defaultdict

import pytest
from factmark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def test_longest_first_by_hand():
    assert sharding.longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {
        "a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.longest_first([], 3) == {}


@pytest.mark.parametrize(("alone", "numbered"), [(2048, 50_000), (2, 4)])
def test_groups_stay_together_and_slots_have_no_gaps(spark, monkeypatch, alone, numbered):
    monkeypatch.setattr(sharding, "ALONE", alone)
    monkeypatch.setattr(sharding, "NUMBERED", numbered)
    r = random.Random(1)
    texts = ["é" * r.randint(0, 200) + str(i % 150) for i in range(300)]
    texts += ["a copy that many hold"] * 150 + [None, "", "", None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 0), (3, texts[3], "", 0)]
    out = sharding.shard_by_size(spark.createDataFrame(rows, SCHEMA).repartition(3), 6).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    shard_of, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for x in out:
        t = text[x["doc_id"]]
        assert x["size"] == len(t.encode()) + 8 and x["text_crc32"] == zlib.crc32(t.encode())
        assert x["law"] == "bytes" and x["grown_shard"] is None
        shard_of[t].add(x["shard"])
        slots[x["shard"]].append(x["slot"])
        load[x["shard"]] += x["size"]
    assert all(len(s) == 1 for s in shard_of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if alone == 2048:  # every group is placed by itself: the plain schedule
        groups = defaultdict(int)
        for x in out:
            groups[text[x["doc_id"]]] += x["size"]
        plain = [0] * 6
        for size in sorted(groups.values(), reverse=True):
            plain[plain.index(min(plain))] += size
        assert sorted(load.values()) == sorted(plain)


def test_empty_table(spark):
    assert sharding.shard_by_size(spark.createDataFrame([], SCHEMA)).collect() == []
