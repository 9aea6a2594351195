import hashlib
import random
from collections import Counter, defaultdict

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factmark.llm import alignment
from factmark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "\n x", "\ttab \t x", "don't 's 'll",
       "<|endoftext|> x", "x<s></s><unk> <0x41> <0x0A>", "low▁line", "ok then low ▁ line", "é ́x",
       "\U0001f600 ﬁ ½", "　wide   x", "\x1c \x1d x", "\u0085 y", "Ǆ ǆ", "x" * 3000, "ab " * 500,
       "中文 字", "{\r } ;\r x", "_ _a", "  two  two", "end.\n\nNext", "zero​width", "﻿ bom"]


def naive(rows):
    """Whole texts through both libraries, ends compared one by one."""
    a_tok, b_tok = alignment._load(A, B)
    a_bytes, b_bytes = alignment._a_bytes(a_tok), alignment._b_bytes(b_tok)
    docs, count = [], Counter()
    for doc_id, text in rows:
        ids_a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b_tok.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if (b"".join(a_bytes[i] for i in ids_a) != want or b"".join(b_bytes[i] for i in ids_b) != want):
            ids_a = ids_b = []
        ends_a = np.cumsum([len(a_bytes[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(b_bytes[i]) for i in ids_b]).tolist()
        groups, links, last = [], [], (0, 0)
        for i, end in enumerate(ends_a):
            if end in ends_b:
                j = ends_b.index(end)
                groups.append(f"{','.join(map(str, ids_a[last[0]:i + 1]))}|"
                              f"{','.join(map(str, ids_b[last[1]:j + 1]))}")
                links.append((ids_a[i], ids_b[j]))
                last = (i + 1, j + 1)
        count.update(links)
        docs.append((doc_id, len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    return [(d, na, nb, ng, len(ln), sum(count[x] == highest[x[1]] for x in ln),
             sum(count[x] for x in ln), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
            for d, na, nb, ng, ln, g in docs]


def test_documents_match_brute_force(spark):
    r = random.Random(4)
    words = brute.vocabulary(200) + ["the", "of", "don't", "naïve", "42", "!!", "\n", "\t", ""]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(80)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, None), (7, "same"), (7, "same")]
    rows += [(2000 + i, "".join(r.choice(["a", "Z", " ", "\n", "é", "  ", "7", "'s", "▁", "<s>", " ", "-"])
                                for _ in range(r.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame([(d, t, 3, "x") for d, t in rows],
                                 "doc_id long, text string, n_a int, links string").repartition(4)
    got = alignment.align(docs, A, B, with_groups=True).collect()
    assert Counter(map(tuple, got)) == Counter(naive(rows))
    assert alignment.align(docs.where("false"), A, B).collect() == []


def test_hot_repeated_rows_and_long_texts(spark, monkeypatch):
    long = " ".join(random.Random(1).choices(brute.vocabulary(50), k=60000))
    rows = [(None, "copies of one text")] * 300 + [(5, "copies of one text")] * 300 + [(6, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(g.doc_id, g.n_groups, g.n_links, g.count_sum) for g in alignment.align(docs, A, B).collect()}
    assert len(got) == 3
    small = next(g for g in got if g[0] == 5)
    assert small[3] >= 600 * small[1]


def test_forgetting_chunks_changes_nothing(monkeypatch):
    import pyarrow as pa
    coder = alignment.PairCoder(A, B)
    args = pa.array(range(len(ODD)), pa.int64()), pa.array(ODD), True
    first = coder.aligned(*args).to_pylist()
    monkeypatch.setattr(alignment, "KEPT", 10)
    assert coder.aligned(*args).to_pylist() == first == coder.aligned(*args).to_pylist()


def test_a_chunk_that_recurs_is_aligned_once(monkeypatch):
    import pyarrow as pa
    given, real = [], alignment.joint_ends
    monkeypatch.setattr(alignment, "joint_ends", lambda a, b: given.append(len(a)) or real(a, b))
    coder = alignment.PairCoder(A, B)
    words = pa.array(["so many words " * 500 + "end"])
    first = coder.aligned(pa.array([1]), words, True).to_pylist()
    monkeypatch.setattr(alignment, "KEPT", 200)
    coder.chars = 300  # over the limit: the words met again and again are kept
    assert coder.aligned(pa.array([1]), words, True).to_pylist() == first
    assert first[0]["n_a"] > 1500 and sum(given) < 50


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.booleans(), st.booleans()), max_size=80))
def test_diagonal_runs_find_every_joint_end(steps):
    at, a, b = 0, [], []
    for size, left, right in steps:
        at += size
        a += [at] * left
        b += [at] * right
    a, b = a + [at + 1], b + [at + 1]
    i, j = alignment.joint_ends(a, b)
    assert [a[x] for x in i] == [b[y] for y in j] == sorted(set(a) & set(b))
    assert alignment.joint_ends([], [])[0].tolist() == []
