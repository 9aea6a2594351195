"""One query per operator, over its whole table, and SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    alignment, chat, mixing, neardup, packing, quality, rules, sharding, substring, tokenfile,
    topk, toxicity, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file that queries use; it lies at the same path on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Every word of every document with its place.
WORDS = r"""
words AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents))"""


def grams(n: int) -> str:
    """The n words from each place, null where the text ends before."""
    parts = ["w"] + [f"lead(w, {j}) OVER t" for j in range(1, n)]
    last = parts[-1] if n > 1 else "w"
    return (f"SELECT doc_id, pos, CASE WHEN {last} IS NOT NULL THEN concat_ws(' ', "
            f"{', '.join(parts)}) END AS g FROM words "
            "WINDOW t AS (PARTITION BY doc_id ORDER BY pos)")


def repeated_words(n: int) -> str:
    """Words inside n-grams that occur twice or more in their document."""
    return f"""
rep{n} AS (
  SELECT doc_id, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS r
  FROM (SELECT doc_id, pos, CASE WHEN g IS NOT NULL AND
          count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS again
        FROM ({grams(n)})))"""


_NS = sorted(rules.LIMITS)
_RULES_SQL = f"""
WITH {WORDS.strip()},
{", ".join(x.strip() for x in (repeated_words(n) for n in _NS))},
base AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
    {", ".join(f"sum(CASE WHEN rep{n}.r = 1 THEN length(w) ELSE 0 END) AS dup_chars_{n}"
               for n in _NS)},
    sum(rep5.r) AS n_repeat_words
  FROM words {" ".join(f"JOIN rep{n} USING (doc_id, pos)" for n in _NS)} GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
later AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (
  SELECT doc_id, count(*) AS n_dup_lines,
    sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS dup_line_chars
  FROM later WHERE again GROUP BY doc_id),
every AS (
  SELECT d.doc_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in (
      "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "dup_line_chars",
      *(f"dup_chars_{n}" for n in _NS)))},
    CAST(length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT)
      AS n_symbols
  FROM documents d LEFT JOIN base USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND dup_line_chars <= {rules.LINE_LIMIT} * word_chars
    {" ".join(f"AND dup_chars_{n} <= {rules.LIMITS[n]} * word_chars" for n in _NS)} AS kept
FROM every"""


@query(_RULES_SQL)
def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repetition_coverage(table(spark, sf_dir, "documents"))


@query(f"""
WITH {WORDS.strip()},
grams AS ({grams(13)}),
flagged AS (
  SELECT doc_id, pos, CASE WHEN g IS NOT NULL AND
    min(doc_id) OVER (PARTITION BY g) < doc_id THEN 1 ELSE 0 END AS again FROM grams),
cover AS (
  SELECT doc_id, pos, max(again) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM flagged)
SELECT d.doc_id, CAST(count(c.pos) AS BIGINT) AS n_words,
  CAST(coalesce(sum(c.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY c.pos) FILTER (WHERE c.gone = 0), ''))
    AS kept_sha256
FROM documents d LEFT JOIN cover c USING (doc_id) LEFT JOIN words USING (doc_id, pos)
GROUP BY d.doc_id""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept_words"), 256).alias("kept_sha256"))


#: Documents are linked on three-word shingles here; the component is closed by recursion.
_NEAR_SQL = r"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM lowered),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.node
    WHERE reach.root < sides.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id,
  d.doc_id = min(root) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON node = d.doc_id
GROUP BY d.doc_id, n"""


@query(_NEAR_SQL)
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=2048)


@query("""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank
  FROM scores) WHERE rank <= 5""")
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), k=5, every=50)


@query()
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(table(spark, sf_dir, "documents"), shards=24)


@query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_roles(table(spark, sf_dir, "conversations"))


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    tokenfile.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    return tokenfile.read_ids(spark, path)


@query()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16, scale=64)
