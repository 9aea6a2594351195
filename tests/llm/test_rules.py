import random

import brute
from factmark.llm import rules, text

SCHEMA = "doc_id long, text string, n_words int, kept string"


def expected(t):
    w = brute.words(t)
    chars = sum(map(len, w))
    lines = [x for x in (t or "").split("\n") if brute.words(x)]
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {"n_words": len(w), "word_chars": chars,
           "n_symbols": sum(c in "#*$%&|<>" for c in t or ""), "n_dup_lines": len(later),
           "dup_line_chars": sum(len(x) for line in later for x in brute.words(line)),
           "n_repeat_words": sum(brute.repeated(w, 5))}
    for n in rules.LIMITS:
        out[f"dup_chars_{n}"] = sum(len(x) for x, r in zip(w, brute.repeated(w, n), strict=True) if r)
    out["base_failed"] = len(w) < 10 or 100 * out["n_repeat_words"] > 20 * len(w)
    out["kept"] = not out["base_failed"] and out["dup_line_chars"] <= rules.LINE_LIMIT * chars and all(
        out[f"dup_chars_{n}"] <= x * chars for n, x in rules.LIMITS.items())
    return out


def test_matches_brute_force_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 400)
    r, v = random.Random(1), brute.vocabulary(40)
    texts = [None, "", " ", "\n\n", "one", "\tone  two\x0b\x0cthree \r\n", "a\xa0b   c\x1c",
             "a b c d e " * 6, "same line\nsame line\n same line\n\n\n", "#*$% & |<> x" * 3]
    for _ in range(40):
        line = " ".join(r.choice(v) for _ in range(r.randint(1, 12)))
        texts.append("\n".join(r.choice([line, line + " z", " ".join(r.sample(v, 9))])
                               for _ in range(r.randint(1, 6))))
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts)] + [(None, "a b", 1, ""), (3, texts[3], 7, "")]
    out = rules.repetition_coverage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by_id = {x["doc_id"]: x.asDict() for x in out}
    for i, t in enumerate(texts):
        got = by_id[i]
        assert {k: got[k] for k in expected(t)} == expected(t), t


def test_empty_table(spark):
    assert rules.repetition_coverage(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    row = rules.repetition_coverage(spark.createDataFrame([(1, long, 0, "")], SCHEMA)).first()
    assert row["n_words"] == 200_000 and row["n_repeat_words"] == 0 and row["kept"]
