import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from factmark.llm import packing
from factmark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, start int, sequence_id string"
ODD = ["", None, " ", "\n\n a  b \xa0 c\xa0\n d　 e  \nf", "<|endoftext|> x<|endoftext|>y  ",
       "a\t\tb's don't  'll 12 x² ½  Ⅷ\x1c a \x1f", "é é à\n\n\n  z\r\n", "  lead",
       "trail \n", "\x85 a\x85 \x85b", "日本 語　テ ス", " " * 5000 + "x", "ab" * 4000,
       "\U0001f600 ́a"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_tokenizers(tokenizer):
    texts = ODD + brute.family(1, 5, 200, 9)
    flat, offsets = packing.tokens(pa.array(texts), tokenizer_path())
    for i, t in enumerate(texts):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == ids_of(tokenizer, t), repr(t)[:60]


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_put_every_document_together_again(spark, tokenizer, window):
    texts = ODD + [t for s in range(4) for t in brute.family(s, 6, 5 + 60 * s * s, 3)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    pieces = packing.pack(docs, tokenizer_path(), window, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["length"] == len(p["ids"])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for i, t in enumerate(texts):
        own, want = sorted(by_doc[i], key=lambda p: p["start"]), ids_of(tokenizer, t)
        assert [x for p in own for x in p["ids"]] == want
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(want)
            at += p["length"]
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at & (at - 1) == 0 and at < window


def test_null_ids_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b", 0, "")] * 2 + [(1, "c", 0, "")] * 2, SCHEMA)
    got = packing.pack(docs, tokenizer_path()).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {None: 6, 1: 4}
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []


def test_each_rest_goes_where_the_sum_of_squares_grows_least():
    size, packer, r = 20, packing.Packer(20), np.random.default_rng(0)
    levels = np.zeros(size + 1, int)
    for i in range(400):
        n = int(r.integers(1, size))
        best = {}
        for f in range(size - n + 1):
            if f and not levels[f]:
                continue
            after = levels.copy()
            after[f] -= f > 0
            after[f + n] += f + n < size
            best[f] = (after[:size] ** 2).sum()
        packer.add(i, np.ones(n, np.uint32))
        after = packer.levels[:size].copy()
        assert (after ** 2).sum() == min(best.values())
        levels[:size] = after
    assert sum(len(x) for x in packer.open.values()) == levels.sum()
