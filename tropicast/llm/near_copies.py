"""Near copies: documents whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Two sieves propose pairs, and whole sets decide. First the SimHash operator: 64-bit fingerprints of the five-word shingles, within two
bits of each other through its embedding cells. A likeness of 0.8 moves more bits than that (5 to 10 in the test tables), so a
second sieve is needed to miss nothing: ``BANDS`` keys of ``ROWS`` minima each under fixed permutations of the
shingle hashes. Two sets of likeness 0.8 share no key with a probability below 1e-9, and none is smaller for
more alike sets; equal sets are one from the start.

Each key's members are compared with the smallest of them, unless they are connected already. Members of one key that are in
different components after that are met through their rarest shingles: sets of likeness 0.8 must
share one of the first fifth of their shingles (and one more), in any order common to all sets. Ordered by rarity, these are the shingles that few
texts have, so texts that share a long passage without being near copies do not meet. No link
between components is left out.

Before whole sets travel, a pair must pass an embedding's bound: the shingles fall into ``SEGMENTS`` segments of the hash range, and
each differing shingle changes the parity of one segment's count, so the number of differing parities never exceeds the
number of differing shingles.

Defined results: words are lower-cased and separated by ASCII space; a text with fewer than five words is one
shingle; NULL and wordless texts are copies of each other; a component keeps a row of its smallest doc_id (NULL
last); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bloom_filtered, cut, drop, small_batches
from . import simhash
from .common import components

SHINGLE = 5
BANDS, ROWS = 40, 4
CHUNK = 1024
SEGMENTS = 512
WORDS = SEGMENTS // 64
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of all runs of SHINGLE words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[None, at:at + CHUNK] * FACTORS[:, None]
        part ^= SHIFTS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    minima = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(minima)], np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())], np.uint64).view(np.int64)[0])


def _fingerprint(hashes: np.ndarray) -> int:
    """Majority of the bits of the distinct shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each segment of the hash range, as WORDS longs."""
    counts = np.bincount((hashes >> np.uint64(64 - SEGMENTS.bit_length() + 1)).astype(np.int64), minlength=SEGMENTS)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        sets = [shingles(t) for t in batch]
        yield pd.DataFrame({"node": pd.Series([_node(s) for s in sets], dtype="int64"),
                            "fp": pd.Series([_fingerprint(s) for s in sets], dtype="int64"),
                            "size": pd.Series([len(s) for s in sets], dtype="int32"),
                            "parities": pd.Series([_parities(s) for s in sets], dtype=object),
                            "keys": pd.Series([band_keys(s) for s in sets], dtype=object)})


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t).view(np.int64) for t in batch], dtype=object)


def _may(a: str, b: str) -> Column:
    """Whether sizes and parities of two nodes allow a likeness of 0.8: at most a ninth of both sizes together may differ."""
    both = F.col(f"{a}.size") + F.col(f"{b}.size")
    differing = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(WORDS)), F.lit(0))
    return (9 * F.least(f"{a}.size", f"{b}.size") >= 4 * both) & (9 * differing <= both)


def possible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (u, v) that sizes and parities do not rule out."""
    p, a, b = pairs.alias("p"), marks.alias("a"), marks.alias("b")
    return p.join(a, F.col("p.u") == F.col("a.node")).join(b, F.col("p.v") == F.col("b.node")).where(_may("a", "b")).select("p.u", "p.v")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have likeness 0.8 or more."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(b, "v").join(a, "u").where(9 * common >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) of nodes with equal fingerprints, or with fingerprints linked by the SimHash operator: each with one node per fingerprint."""
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    same = nodes.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    near = simhash.links(heads.select("fp"))
    a = heads.select(F.col("fp").alias("u"), F.col("head").alias("a"))
    b = heads.select(F.col("fp").alias("v"), F.col("head").alias("b"))
    near = near.join(a, "u").join(b, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return same.unionByName(near).distinct()


def rare_places(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, node, at): the rarest shingles of every node, those that two nodes at least have; ``at`` is the place by rarity.

    Sets with a likeness of 0.8 share a shingle among the first |set| - ceil(0.8 |set|) + 1 of their shingles in any common order.
    """
    tokens = nodes.select("node").join(sets, "node").select("node", F.explode("shingles").alias("s"))
    counts = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(counts, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("t"))
    size = F.size("t")
    first = ranked.select("node", F.posexplode(F.slice("t", F.lit(1), size - F.ceil(size * 4 / 5).cast("int") + 1)).alias("at", "t"))
    return first.where("t.n > 1").select("node", "at", F.col("t.s").alias("s"))


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """(u, v) of places at one shingle, in different components and with enough of both still to come, that may be alike."""
    a, b = a.alias("a"), b.alias("b")
    left = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    meet = (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
    meet &= 9 * left >= 4 * (F.col("a.size") + F.col("b.size"))
    return a.join(b, meet & _may("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def rare_pairs(nodes: DataFrame, sets: DataFrame, marks: DataFrame) -> DataFrame:
    """(u, v) of ``nodes`` (node, root) with different roots: all that have a likeness of 0.8 are among them."""
    places = cut(rare_places(nodes, sets).join(nodes, "node").join(marks, "node"))
    return _meet(places, places).distinct()


def grouped(keyed: DataFrame) -> DataFrame:
    """(doc_id, _content, root) of every row of ``keyed``; rows of one component have the same root."""
    text = F.coalesce("text", F.lit(""))
    # a batch of whole texts and their sets stays small in the Python workers, which keep their memory for the stages that follow
    with small_batches(keyed.sparkSession):
        prints = cut(keyed.select("doc_id", "_content", F.pandas_udf(_prints, "node long, fp long, size int, parities array<long>, keys array<long>")(text).alias("p")).select(
            "doc_id", "_content", "p.node", "p.fp", "p.size", *[F.get("p.parities", F.lit(i)).alias(f"b{i}") for i in range(WORDS)], "p.keys"))
    # rows with equal sets are one node from here on
    nodes = prints.select("node", "fp", "keys").dropDuplicates(["node"])
    cells = nodes.select("node", F.explode("keys").alias("key"))
    shared = cells.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
    cells = cut(cells.join(shared, "key"))
    alike = cut(simhash_pairs(prints.select("node", "fp").dropDuplicates(["node"])))
    marks = cut(prints.select("node", "size", *[f"b{i}" for i in range(WORDS)]).dropDuplicates(["node"]))
    # the whole sets of what a sieve proposes
    met = cells.select("node").unionByName(alike.select(F.explode(F.array("u", "v")).alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    rows = cut(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_content")).alias("row")).join(
        met, "node").select("node", "met", F.col("row.doc_id").alias("_d"), F.col("row._content").alias("_c")))
    # only texts that may be among these are shuffled: Spark makes its filter from a table that is itself filtered
    texts = keyed.select("doc_id", "_content", "text").join(rows.where("met > 0"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c")))
    with small_batches(keyed.sparkSession), bloom_filtered(keyed.sparkSession):
        sets = cut(texts.dropDuplicates(["node"]).select("node", F.pandas_udf(_sets, "array<long>")(text).alias("shingles")))
    links = cut(verified(possible(alike, marks), sets))
    rooted = _rooted(cells, links)
    leaders = rooted.where("node = leader").select("key", F.col("root").alias("own"))
    open_ = rooted.join(leaders, "key").where("root <> own").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    links = cut(links.unionByName(verified(possible(open_, marks), sets)))
    rooted = cut(_rooted(cells, links))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    # pairs with the leader are settled
    apart = cut(rooted.where("node <> leader").join(mixed, "key", "left_semi").select("node", "root").distinct())
    roots = cut(components(links.unionByName(verified(rare_pairs(apart, sets, marks), sets))))
    for table in (cells, alike, marks, rows, sets, rooted, apart):
        drop(table)
    return prints.join(roots, "node", "left").select("doc_id", "_content", F.coalesce("root", "node").alias("root"))


def _rooted(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cells with the component of each node."""
    roots = cut(components(links))
    return cells.join(roots, "node", "left").select("key", "leader", "node", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies."""
    keyed = docs.withColumn("_content", F.xxhash64(*docs.columns))
    return simhash.first_rows(docs, keyed, grouped(keyed))
