"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits becomes 32 counts of set bits, one for each pair of bits. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints,
so fingerprints that differ in at most two bits lie within two of each other there. The 32
coordinates form five groups, of which at most two can
differ: every link shares the cells of some three groups. The range join meets fingerprints
in those cells, keeps pairs whose other groups are within the Manhattan radius, and
verifies the bits exactly.

Equal fingerprints collapse before the join. A cell with more than ``CELL_ROWS`` fingerprints is not
joined with itself: for its members each fingerprint names all fingerprints one bit away
and itself. Two that differ in at most two bits name a common one, no name is shared
by more than 65, and each sharer is within two bits of the others, so
connecting the sharers to the smallest of them keeps every component exactly and grows with
the rows of the cell, not with their square.

Defined results: a NULL or wordless text has fingerprint zero, which links like any other;
repeated rows are all returned; a component whose doc_ids are all NULL has component NULL; an
empty table gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import components

SHINGLE = 3
RADIUS = 2
GROUPS = 5
CELL_ROWS = 64
ODD = 0x5555555555555555


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, step = np.zeros(64, np.int64), 1 << 15
    for at in range(0, n, step):
        spans = zip(starts[at:at + step].tolist(), last[at:at + step].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, fp) of every row."""
    udf = F.pandas_udf(_fingerprints, "long")
    return docs.select("doc_id", *more, udf(F.coalesce("text", F.lit(""))).alias("fp"))


def _counts(fp: Column) -> Column:
    """The 32 pair counts, each in its own two bits."""
    one = fp.bitwiseAND(F.lit(ODD))
    other = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Distance of two vectors of pair counts: 0, 1 and 2 as 00, 01 and 11 differ in as many bits."""
    def unary(c):
        high = F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(ODD))
        return c.bitwiseOR(high)
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def _masks() -> list[int]:
    """Masks over the packed counts, one for each group of coordinates."""
    bounds = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _cells(points: DataFrame) -> DataFrame:
    """(combination, cell, fp, counts): the cells of all choices of three groups."""
    masks, keys = _masks(), []
    for i, chosen in enumerate(combinations(range(GROUPS), GROUPS - RADIUS)):
        mask = _signed(sum(masks[c] for c in chosen))
        keys.append(F.struct(F.lit(i).alias("combination"), F.col("counts").bitwiseAND(F.lit(mask)).alias("cell")))
    return points.select("fp", "counts", F.explode(F.array(*keys)).alias("k")).select("k.combination", "k.cell", "fp", "counts")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprints within two bits."""
    points = distinct.select("fp").withColumn("counts", _counts(F.col("fp")))
    cells = _cells(points)
    sizes = cells.groupBy("combination", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cut(cells.join(sizes, ["combination", "cell"]))
    small = sized.where(F.col("n") <= CELL_ROWS)
    a, b = small.alias("a"), small.alias("b")
    near = (F.col("a.combination") == F.col("b.combination")) & (F.col("a.cell") == F.col("b.cell"))
    near &= F.col("a.fp") < F.col("b.fp")
    near &= _manhattan(F.col("a.counts"), F.col("b.counts")) <= RADIUS
    near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    found = a.join(b, near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = sized.where(F.col("n") > CELL_ROWS).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    names = crowded.select("fp", F.explode(F.array("fp", *flips)).alias("name"))
    # at most 65 sharers a name
    shared = names.groupBy("name").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return found.unionByName(stars)


def grouped(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, *more, fp, root): rows of one component have the same root, its smallest fingerprint."""
    prints = cut(fingerprints(docs, *more))
    # copies of a text are one row from here on
    distinct = prints.select("fp").distinct()
    roots = cut(components(links(cut(distinct))))
    return prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "doc_id", *more, "fp", F.coalesce("root", "fp").alias("root"))


def op4_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint in hexadecimal and component of every document."""
    found = cut(grouped(docs))
    smallest = cut(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    out = found.join(smallest, "root")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (docs and ``_content``) that come first in each root of ``found`` (doc_id, _content, root)."""
    rows = found.groupBy("root", "doc_id", "_content").agg(F.count(F.lit(1)).alias("n"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_content", "n"))
    heads = cut(rows.groupBy("root").agg(head.alias("h")).select(
        F.col("h.doc_id").alias("_d"), F.col("h._content").alias("_c"), F.col("h.n").alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_content") == F.col("_c"))
    once = keyed.join(heads.where("n = 1"), same, "left_semi")
    repeated = keyed.join(heads.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_content"])
    return once.unionByName(repeated).select(*docs.columns)


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: a row of its smallest doc_id (NULL last), and of
    different rows with that id the one whose content hashes lowest.
    """
    keyed = docs.withColumn("_content", F.xxhash64(*docs.columns))
    return first_rows(docs, keyed, grouped(keyed, "_content"))
