from collections import Counter, defaultdict

import brute
import corpus_pipeline
from factmark.llm import mixing, quality
from factmark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_each_stage_does_to_its_input_what_it_should(spark, tmp_path):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns

    def run(k, docs):
        path = str(tmp_path / str(k))
        stages[k](spark, docs, SF).write.parquet(path)
        return spark.read.parquet(path)

    good = run(0, docs)
    rejected = {r["doc_id"] for r in quality.quality(docs, labels).where("predicted = 0").collect()}
    assert rejected
    assert sorted(map(tuple, good.collect())) == sorted(
        tuple(r) for r in docs.collect() if r["doc_id"] not in rejected)

    single = run(1, good)
    want = brute.near_components([(r["doc_id"], r["text"]) for r in good.collect()], 5, 80)
    assert sorted(map(tuple, single.collect())) == sorted(
        tuple(r) for r in good.collect() if want[r["doc_id"]][1] == r["doc_id"])
    assert single.count() < good.count()

    cut = run(2, single)
    rows = single.collect()
    kept = brute.remove_repeats([(r["doc_id"], r["text"]) for r in rows], 13)
    expected = {}
    for r, w in zip(rows, kept, strict=True):
        if w or not brute.words(r["text"]):
            text = r["text"] if len(w) == len(brute.words(r["text"])) else " ".join(w)
            expected[r["doc_id"]] = (r["doc_id"], text, r["lang"], r["source"], len(text))
    assert {r["doc_id"]: tuple(r) for r in cut.collect()} == expected

    mixed = run(3, cut)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(cut).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
        assert (r["lang"], r["source"]) == expected[r["doc_id"]][2:4]
    assert +got == +Counter(taken)

    packed = run(4, mixed)
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = Counter()
    for r in mixed.collect():
        ids[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    pieces, fill = Counter(), defaultdict(int)
    for p in packed.collect():
        pieces[p["doc_id"]] += p["length"]
        fill[p["sequence_id"]] += p["length"]
    assert pieces == ids
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    assert all(f.columns == columns for f in (good, single, cut, mixed))


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id at all here", "en", "a", 17),
            (3, "some words of a document that is fine", "en", None, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as score", "'x' as component_id")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert "sequence_id" in docs.columns


def test_copies_without_an_id_of_their_own(spark):
    text = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcde"]
    near = text[0].replace("a39", "z")
    rows = [(7, text[0]), (None, text[0]), (None, near), (None, text[1]), (None, text[1]),
            (None, text[1] + " more"), (3, text[2]), (3, text[2]), (3, text[3]), (4, text[3]),
            (5, text[4]), (5, text[4].replace("e39", "z")), (None, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert max(kept.values()) == 1 and (7, text[0]) in kept and (None, None) in kept and (6, "") in kept
    starts = Counter((t or "")[:2] for _, t in kept)
    assert starts == {"a0": 1, "b0": 1, "c0": 1, "d0": 1, "e0": 1, "": 2}

    shared = " ".join(f"s{i}" for i in range(20))
    apart = [(None, f"{shared} {text[0]}"), (None, f"{text[1]} {shared}"), (8, f"{shared} {text[2]}"),
             (8, f"{text[3]} {shared}")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in apart], docs.schema)
    cut = corpus_pipeline.drop_repeats(spark, docs, SF).collect()
    assert len(cut) == 4 and sum("s5" in r["text"].split() for r in cut) == 1
    assert Counter(r["doc_id"] for r in cut) == {None: 2, 8: 2}
