"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Scratch
from . import text as T

#: Bins in a band: the fewer, the more pairs meet that are not alike.
ROWS = 5
#: Most probable share of alike pairs (at exactly the threshold) that never meet in a band.
MISS = 1e-6
#: Hubs of a bucket in the first round after the star, and their growth from round to round.
HUBS = 16

_LINK = "a long, b long"
_COMPARED = "a long, b long, n_b long, common long, linked boolean, extra array<long>"
_SIGNED = ("set_a long, set_b long, n_shingles long, rep long, ids array<long>, "
           "bands array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS,
                    miss: float = MISS) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles are alike.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than
    ``width`` words has its whole sequence as its one shingle. Two documents are linked
    when ``100 * |A and B| >= percent * |A or B|``, which is confirmed on full sets.
    Returns per row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that
    links lead to), ``kept`` (it is that document).

    A null, empty or blank text has no shingles and is linked with nothing. A null id
    never names a component: such a row joins the component of an equal set, and alone it
    has none and is kept. Rows that share an id count as one document. Other columns are
    ignored; an empty table gives an empty result.

    How: each task signs its texts by one-permutation hashing with optimal densification
    and merges equal sets, so that exact copies are one row per task. Equal sets of all
    tasks become one node. Bands of ``rows`` bins, as many as ``miss`` asks for, put nodes
    into buckets. A bucket's hub is its node with the most company over all bands: among
    copies of one text the one in the middle. Each node is first compared with the hub it
    shares most buckets with: a star, never more edges than nodes. Where a bucket then
    still holds two components, all its members are compared with its hub, and what each
    has in common with it tells exactly which of them can be alike: two texts that are not
    both linked to the hub must share a shingle that the hub lacks, or share enough of
    the hub. Shared shingles make smaller buckets (only the first in hash order that a
    link needs), in which members outside the largest component serve as hubs, four times
    as many each round, until all have. So every pair that met in a band is linked,
    connected or refuted; no bucket is capped or gathered in a task, they are only
    aggregated and joined.
    """
    spark = docs.sparkSession
    bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _signed(batches, width, bands, rows)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, width, percent, False)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compared(batches, width, percent, True)

    with Scratch(spark, "near") as scratch:
        signed = scratch.table(texts.mapInArrow(T.tidy(sign), _SIGNED), kept=True)
        nodes = scratch.table(
            signed.where("n_shingles > 0 AND rep IS NOT NULL").groupBy("set_a", "set_b")
            .agg(F.min("rep").alias("node"), F.min("n_shingles").alias("n"),
                 F.first("bands").alias("bands")), kept=True)
        size = _Size(nodes.count(), bands)
        members = _members(nodes, scratch, size)
        wanted = members.select(F.col("node").alias("doc_id")).distinct()
        near = scratch.table(texts.join(wanted.hint("merge"), "doc_id", "left_semi")
                             .select(F.col("doc_id").alias("node"), "text"), size.texts)

        def compared(pairs: DataFrame, by, schema: str) -> DataFrame:
            return scratch.table(_texts(pairs, near, size.texts).mapInArrow(T.tidy(by), schema), size.texts)

        star = scratch.table(
            members.where("hub.node != node").repartition("node").groupBy("node", "n", "hub")
            .agg(F.count("*").alias("shared"))
            .groupBy("node", "n").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub")),
            size.nodes)
        tested = scratch.table(_pairs(star, "hub.node", "hub.n", "node", "n", percent), size.nodes)
        links = compared(tested, confirm, _LINK)

        # Buckets whose members are not all linked to one hub: compare all with their own hub.
        chosen = star.select("node", F.col("hub.node").alias("to")).join(
            links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(
                links.select("b", "a")), ["node", "to"]).coalesce(size.nodes)
        state = scratch.table(members.select("bucket", "node", "hub").join(
            chosen.withColumnRenamed("to", "component"), "node", "left").withColumn(
                "component", F.coalesce("component", "node")), size.placed)
        scratch.drop(members, star)
        open_ = scratch.table(
            state.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"))
            .where("p != q").select("bucket"), size.placed)
        if open_.isEmpty():
            component = components(links, scratch, size.nodes)
        else:
            seen = compared(state.join(open_, "bucket").where("hub.node != node").select(
                F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
                .coalesce(size.texts), compare, _COMPARED)
            component = _settled(seen, links, tested, compared, confirm, percent, scratch, size)
        component = scratch.table(component, size.nodes, kept=True)

    named = nodes.select("set_a", "set_b", "node").join(component, "node", "left").select(
        "set_a", "set_b", F.coalesce("component", "node").alias("component"))
    return (signed.join(named, ["set_a", "set_b"], "left")
            .select(F.explode("ids").alias("doc_id"), "n_shingles", "component")
            .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                        .otherwise(F.col("component")))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"),
                               F.col("component_id").isNull()).alias("kept")))


class _Size:
    """Tasks that tables of so many nodes need; never one alone. A stage that would have
    fewer anyway keeps its own number."""

    def __init__(self, nodes: int, bands: int):
        self.nodes, self.placed, self.texts = (
            max(8, math.ceil(rows / each)) for rows, each in (
                (nodes, 50_000), (nodes * bands, 250_000), (nodes, 5_000)))


def _members(nodes: DataFrame, scratch: Scratch, size: _Size) -> DataFrame:
    """``bucket, node, n, hub`` of all buckets that hold at least two nodes."""
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowd = scratch.table(placed.groupBy("bucket").agg(F.count("*").alias("crowd"))
                          .where("crowd > 1"), size.placed)
    company = F.sum("crowd").over(W.partitionBy("node"))  # a row per band
    met = scratch.table(placed.join(crowd, "bucket").coalesce(size.placed)
                        .withColumn("company", company).drop("crowd"), size.placed)
    hubs = scratch.table(met.groupBy("bucket").agg(
        F.max(F.struct("company", -F.col("node"), "node", "n")).alias("hub")).select(
            "bucket", F.struct("hub.company", "hub.node", "hub.n").alias("hub")), size.placed)
    members = scratch.table(met.join(hubs, "bucket"), size.placed)
    scratch.drop(crowd, met, hubs)
    return members


def _settled(seen: DataFrame, links: DataFrame, tested: DataFrame, compared, confirm, percent: int,
             scratch: Scratch, size: _Size) -> DataFrame:
    """Components once every pair that met in an open bucket is linked, connected or
    refuted; ``seen`` has each member with what it shares with its hub."""
    links = links.union(seen.where("linked").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    component = components(links, scratch, size.nodes)
    beside = scratch.table(seen.join(component.withColumnRenamed("node", "b"), "b", "left")
                           .withColumn("component", F.coalesce("component", "b")), size.texts)

    # Two that are not both linked to their hub, by what they share with it or beside it.
    direct = _enough_of_hub(beside, percent)
    # ``left``: its shingles beside the hub from this one on, in hash order.
    small = beside.select(F.posexplode("extra").alias("at", "shingle"), "a", F.col("b").alias("node"),
                          F.col("n_b").alias("n"), "common").select(
        F.xxhash64("a", "shingle").alias("bucket"), "node", "n", "common",
        (F.col("n") - F.col("common") - F.col("at")).alias("left"))
    allowed = HUBS
    while True:
        live = _unsettled(small, component, scratch, size)
        most = live.agg(F.max("minor")).first()[0] or 0
        hub = live.where(
            (F.col("component") != F.col("main"))
            & (F.pmod(F.xxhash64("bucket", "node"), F.lit(1 << 20)) * F.col("minor")
               < allowed * (1 << 20)))
        pairs = (hub.alias("h").join(live.alias("m"), (F.col("h.bucket") == F.col("m.bucket"))
                                     & (F.col("h.component") != F.col("m.component"))
                                     & _room_for_link(percent))
                 .select(F.col("h.node").alias("p"), F.col("h.n").alias("n_p"),
                         F.col("m.node").alias("q"), F.col("m.n").alias("n_q")))
        pairs = _pairs(pairs, "p", "n_p", "q", "n_q", percent)
        fresh = scratch.table(
            (pairs if direct is None else pairs.union(direct)).coalesce(size.placed).distinct()
            .coalesce(size.placed).join(tested, ["a", "b"], "left_anti"), size.texts)
        if not fresh.isEmpty():
            found = compared(fresh, confirm, _LINK)
            if not found.isEmpty():
                links = links.union(found)
                component = components(links, scratch, size.nodes)
        if most <= allowed:
            return component
        tested, direct = tested.union(fresh), None
        small = live.where(F.col("minor") > allowed).select("bucket", "node", "n", "common", "left")
        allowed *= 4


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    """Set sizes that allow a link: it needs ``percent`` of the larger set in common."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _room_for_link(percent: int) -> Column:
    """Whether members ``h`` and ``m`` of a hub can be linked with this shingle as the first
    in hash order that they share beside it: in common they have at most what each has in
    common with the hub, and what each has left beside it."""
    most = F.least("h.common", "m.common") + F.least("h.left", "m.left")
    return (100 + percent) * most >= percent * (F.col("h.n") + F.col("m.n"))


def _pairs(rows: DataFrame, p: str, n_p: str, q: str, n_q: str, percent: int) -> DataFrame:
    """``a < b`` of the pairs whose set sizes allow a link."""
    return rows.where(_sizes_fit(F.col(n_p), F.col(n_q), percent)).select(
        F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))


def _texts(pairs: DataFrame, near: DataFrame, parts: int) -> DataFrame:
    """Pairs with both texts. Texts are always met in their own order, so that a table of
    pairs small enough to be broadcast changes neither plan nor growth."""
    one, other = (near.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
                  .hint("merge") for c in ("b", "a"))
    return (pairs.join(one, "b").coalesce(parts).join(other, "a")
            .select("a", "b", "text_a", "text_b"))


def _enough_of_hub(beside: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components, compared with the same hub, that may be linked by
    what they share with the hub alone; one of them is not linked to it. They meet by size:
    what a member has in common with the hub bounds the size of its partners."""
    def level(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(1.05))

    one = beside.select("a", F.col("b").alias("p"), F.col("n_b").alias("n_p"),
                        F.col("common").alias("c_p"), F.col("component").alias("k_p"), "linked")
    low = F.ceil(percent * F.col("n_p") / 100)
    high = F.floor(F.col("c_p") * (100 + percent) / percent) - F.col("n_p")
    seekers = one.where(~F.col("linked") & (low <= high)).withColumn(
        "level", F.explode(F.sequence(level(low), level(high))))
    others = one.select("a", F.col("p").alias("q"), F.col("n_p").alias("n_q"),
                        F.col("c_p").alias("c_q"), F.col("k_p").alias("k_q"),
                        level(F.col("n_p")).alias("level"))
    shared = F.least("c_p", "c_q")
    return _pairs(seekers.alias("s").join(
        others.alias("o"), (F.col("s.a") == F.col("o.a")) & (F.col("s.level") == F.col("o.level"))
        & (F.col("k_p") != F.col("k_q"))
        & (100 * shared >= percent * (F.col("n_p") + F.col("n_q") - shared))),
        "p", "n_p", "q", "n_q", percent)


def _unsettled(members: DataFrame, component: DataFrame, scratch: Scratch,
               size: _Size) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's largest
    component and how many members are outside it."""
    state = scratch.table(members.join(component, "node", "left").withColumn(
        "component", F.coalesce("component", "node")), size.placed)
    share = state.groupBy("bucket", "component").agg(F.count("*").alias("c")).coalesce(size.placed)
    several = scratch.table(share.groupBy("bucket").agg(
        F.count("*").alias("kinds"), (F.sum("c") - F.max("c")).alias("minor"),
        F.max_by("component", F.struct("c", "component")).alias("main")).where("kinds > 1"),
        size.placed)
    live = scratch.table(state.join(several.drop("kinds"), "bucket"), size.placed)
    scratch.drop(state, several)
    return live


def components(links: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of the links
    ``a, b``: smallest labels spread along links and jump to their labels' labels."""
    both = scratch.table(links.union(links.select("b", "a")).select(
        F.col("a").alias("node"), F.col("b").alias("other")), parts)
    labels = scratch.table(both.groupBy("node").agg(
        F.least("node", F.min("other")).alias("component")), parts)
    rounds = 0
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select(
            "node", "component", F.lit(None).cast("long").alias("before"))
        spread = scratch.table(
            heard.union(labels.withColumn("before", F.col("component"))).coalesce(parts)
            .groupBy("node").agg(F.min("component").alias("component"),
                                 F.max("before").alias("before")), parts)
        scratch.drop(labels)
        labels, rounds = spread, rounds + 1
        if spread.where("component != before").isEmpty():
            scratch.drop(both)
            return spread.select("node", "component")
        if rounds > 2:  # stars are done by now; along chains labels have to jump
            labels = scratch.table(spread.alias("l").join(
                spread.select(F.col("node").alias("at"), F.col("component").alias("next")),
                F.col("l.component") == F.col("at")).select(
                    "node", F.col("next").alias("component")), parts)
            scratch.drop(spread)


# --- inside tasks ---------------------------------------------------------------------


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by (text, hash), and the text of each."""
    w = T.words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes, counts = w.hashes(), w.counts
    at = T.whole(w.offsets, width)
    found, owner = [T.rolling(hashes, width)[at]], [w.owner()[at]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        found.append(T.mixed(T.rolling(hashes[w.offsets[i]:w.offsets[i + 1]], counts[i])
                             + np.uint64(counts[i])))
        owner.append(np.array([i]))
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(found)
    small = owner[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def signatures(found: np.ndarray, owner: np.ndarray, size: int, bins: int) -> np.ndarray:
    """One-permutation signatures: the least hash of each bin, and for an empty bin the
    value of the first filled bin in a random order of its own, the same for all texts."""
    index = ((found >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    index = index.astype(np.int64)
    first = np.ones(len(found), bool)  # hashes ascend, so a bin's first is its least
    first[1:] = (index[1:] != index[:-1]) | (owner[1:] != owner[:-1])
    out, filled = np.zeros((size, bins), np.uint64), np.zeros((size, bins), bool)
    out[owner[first], index[first]] = found[first]
    filled[owner[first], index[first]] = True
    single = np.bincount(owner, minlength=size) == 1
    out[single] = out[single].max(1, keepdims=True)
    row, column = np.nonzero(~filled & ~single[:, None] & filled.any(1)[:, None])
    attempt = 0
    while len(row):
        draw = T.mixed(column.astype(np.uint64) + np.uint64(attempt * bins + 1))
        source = (draw % np.uint64(bins)).astype(np.int64)
        hit = filled[row, source]
        out[row[hit], column[hit]] = out[row[hit], source[hit]]
        row, column = row[~hit], column[~hit]
        attempt += 1
    return out


def _signed(batches: Iterator[pa.RecordBatch], width: int, bands: int,
            rows: int) -> Iterator[pa.RecordBatch]:
    index: dict[tuple[int, int], int] = {}
    ids: list[list[int | None]] = []
    sizes: list[int] = []
    keys: list[np.ndarray] = []
    for part in T.slices(batches):
        texts = T.one(part["text"])
        found, owner = shingles(texts, width)
        size = len(texts)
        count = np.bincount(owner, minlength=size)
        ends = np.cumsum(count)
        set_a, set_b = (_sums(x, ends, count) for x in (
            found, T.mixed(found ^ np.uint64(0x5851F42D4C957F2D))))
        sig = signatures(found, owner, size, bands * rows).reshape(size, bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (size, bands)).copy()
        for j in range(rows):
            key = key * T.BASE + sig[:, :, j]
        key = T.mixed(key).view(np.int64)
        for i, (doc_id, a, b) in enumerate(zip(part["doc_id"].to_pylist(), set_a.tolist(),
                                               set_b.tolist(), strict=True)):
            at = index.setdefault((a, b), len(ids))
            if at == len(ids):
                ids.append([])
                sizes.append(int(count[i]))
                keys.append(key[i] if count[i] else key[i, :0])
            ids[at].append(doc_id)
    every = list(index)
    for first in range(0, len(ids), 5000):
        s = slice(first, first + 5000)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in every[s]], pa.int64()),
             pa.array([b for _, b in every[s]], pa.int64()), pa.array(sizes[s], pa.int64()),
             pa.array([min((x for x in g if x is not None), default=None) for g in ids[s]],
                      pa.int64()),
             pa.array(ids[s], pa.list_(pa.int64())), pa.array(keys[s], pa.list_(pa.int64()))],
            ["set_a", "set_b", "n_shingles", "rep", "ids", "bands"])


def _sums(values: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[ends] - total[ends - count]).view(np.int64)


def _compared(batches: Iterator[pa.RecordBatch], width: int, percent: int,
              every: bool) -> Iterator[pa.RecordBatch]:
    """The pairs that are links by their full sets; or every pair with what the sets have
    in common and those shingles of ``b`` that ``a`` lacks. Of these only so many, in hash
    order, as another text must meet: it needs ``percent`` of ``b`` in common, and can find
    no more of that in ``a`` than ``b`` has."""
    for part in T.slices(batches, "text_b"):
        coded = pc.dictionary_encode(T.one(part["text_a"]))  # a hub's set is built once
        hubs = _sets(coded.dictionary, width)
        others = _sets(T.one(part["text_b"]), width)
        rows = []
        for i, (h, b) in enumerate(zip(coded.indices.to_pylist(), others, strict=True)):
            a = hubs[h]
            common = len(np.intersect1d(a, b, assume_unique=True))
            linked = 100 * common >= percent * (len(a) + len(b) - common)
            if every:
                extra = np.setdiff1d(b, a, assume_unique=True).view(np.int64)
                missing = -(-percent * len(b) // 100) - common
                extra = extra[:max(len(extra) - max(missing, 1) + 1, 0)]
                rows.append((i, len(b), common, linked, extra))
            elif linked:
                rows.append((i,))
        kept = part.select(["a", "b"]).take(pa.array([r[0] for r in rows], pa.int64()))
        if every:
            for k, (name, kind) in enumerate((("n_b", pa.int64()), ("common", pa.int64()),
                                              ("linked", pa.bool_()),
                                              ("extra", pa.list_(pa.int64()))), 1):
                kept = kept.append_column(name, pa.array([r[k] for r in rows], kind))
        yield from kept.combine_chunks().to_batches()


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    found, owner = shingles(texts, width)
    return np.split(found, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) \
        if len(texts) else []
