import heapq
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factmark.errors import ResearchError
from factmark.llm import tokenfile
from factmark.llm.huffman import STEP, Code, code_lengths
from factmark.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "\n\t", "a", "It's  DON'T́ x", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>x",
       "́lead éé", "\u0085 　wide", "Straße İI ΣΣ", "1234 5,6 ...!?",
       "\x1c\x1d mixed \x0b\x0c", "\U0001f600 ﬁ", "word " * 400, "x" * 5000]


def test_words_give_the_ids_of_whole_texts():
    coder = tokenfile.WordsCoder(PATH)
    assert coder.by_word
    r = random.Random(3)
    texts = ODD + [None] + ["".join(r.choice(["a", "B", " ", "\n", "'s", "é", "́", "7", "<|", "|>", " "])
                                    for _ in range(r.randrange(40))) for _ in range(300)]
    flat, offsets = coder.encode(pa.array(texts, pa.string()), 1)
    whole = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, w in enumerate(whole):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == [*w.ids, 1], texts[i]
    letters = [chr(c) for c in range(0x21, 0x180)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(3000)]
    texts += ["ÀÉÎ'LL ŸŠž's x'RE", "ŉoſſ ßẞ ×÷ İı"]
    flat, offsets = coder.encode(pa.array(texts, pa.string()), 1)
    whole = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, w in enumerate(whole):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == [*w.ids, 1], texts[i]
    coder.KEPT = 50  # forgetting words changes nothing
    for _ in range(2):
        again, _ = coder.encode(pa.array(texts, pa.string()), 1)
        assert (again == flat).all()


def test_other_tokenizers_encode_whole_texts():
    coder = tokenfile.WordsCoder(tokenizer_path())
    assert not coder.by_word
    flat, offsets = coder.encode(pa.array(["a  b", None], pa.string()), 1)
    assert offsets.tolist() == [0, len(flat) - 1, len(flat)] and flat[-1] == 1


def huffman_bits(counts):
    """Total bits of an unlimited Huffman code."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=60))
def test_lengths_are_optimal_and_limited(counts):
    counts = np.array(counts)
    free = code_lengths(counts, 25 if len(counts) <= 24 else 60)
    assert (counts * free).sum() == huffman_bits(counts.tolist())
    tight = code_lengths(counts, max(len(counts) - 1, 1).bit_length())
    assert tight.max() <= max(len(counts) - 1, 1).bit_length()
    for bits in (free, tight):
        assert sum(2.0 ** -bits) == pytest.approx(1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(1, 50), st.integers(0, 2**32 - 1))
def test_blocks_round_trip(n, symbols, seed):
    r = np.random.default_rng(seed)
    ids = np.unique(r.integers(0, 60000, symbols)).astype(np.uint32)
    data = ids[np.minimum(r.geometric(0.3, n) - 1, len(ids) - 1)]
    code = Code(ids.copy(), code_lengths(np.arange(len(ids), 0, -1) ** 3, 9))
    payload, marks = code.encode(data)
    assert code.decode(payload, marks, n).tolist() == data.tolist()
    assert len(marks) == 2 * -(-n // STEP)


def test_codes_are_canonical_and_damage_is_noticed():
    code = Code(np.array([7, 3, 9, 1]), np.array([2, 2, 2, 2]))
    assert code.encode(np.array([1, 3, 7, 9]))[0] == bytes([0b00011011])
    code = Code(np.array([5, 6, 7]), np.array([1, 2, 2]))
    payload, marks = code.encode(np.array([5, 6] * 200))
    with pytest.raises(ResearchError):
        code.decode(bytes(len(payload)), marks, 400)
    with pytest.raises(ResearchError):
        code.encode(np.array([4]))


def expected(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    coded = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows]
    for d, ids in sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    r = random.Random(5)
    words = brute.vocabulary(300)
    rows = [(i * 7 % 401, " ".join(r.choices(words, k=r.randrange(60)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (2001, "long " + "far word " * 60000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows],
                                 "doc_id long, text string, row string, n int").repartition(5)
    path = f"{tmp_path}/files"
    tokenfile.write_ids(docs, PATH, path)
    got = tokenfile.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    assert [tuple(g)[:4] for g in got] == expected(rows)
    assert all(len(g.ids) == g.n_tokens and g.ids[-1] == 1 for g in got)
    book = spark.read.parquet(f"{path}/codes").collect()
    assert sum(c.n for c in book) == sum(g.n_tokens for g in got)


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(None, "same text")] * 40 + [(3, "same text")] * 60 + [(2, "b"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tokenfile.write_ids(docs, PATH, f"{tmp_path}/a")
    got = tokenfile.read_ids(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [g.doc_id for g in got] == [None] * 40 + [2] + [3] * 61
    assert [g.start for g in got] == np.cumsum([0] + [g.n_tokens for g in got[:-1]]).tolist()
    tokenfile.write_ids(docs.where("false"), PATH, f"{tmp_path}/b")
    assert tokenfile.read_ids(spark, f"{tmp_path}/b").collect() == []
