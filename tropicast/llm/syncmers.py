"""Document fingerprints from closed syncmers.

The letters are words, hashed. A window of ``K`` words is an anchor if the smallest hash of its words stands at
one of its edges: that depends on the window alone, so the same passage gives the
same anchors in any document and at any place. ``anchors`` lists them with their word positions, to match passages by
position; a fingerprint is the set of all anchors of a text, however long, in the order of their hashes, and the likeness
of two is their exact overlap. Hashes are shortened to 32 bits: texts of n and m anchors are expected
to have n * m / 2^32 in common by chance.

Everything is SQL functions. The next document of each row is found on ids alone (ranges of ids, then
the edges of the ranges); the texts move once, and then the part and the anchors that a row needs of its
next one. A row's own anchors are made where its text arrives and do not move.

Defined results: a NULL text is empty; a text with fewer than ``K`` words, or without anchors, has one anchor
over all its words; a text without words has the empty fingerprint, like another one with 1; a NULL doc_id comes
after all others; rows that repeat a doc_id follow each other by the hash of their texts, and equal rows are one
document; a single document is its own next one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import whole_text

K = 4
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _window_anchor(h: Column, i: Column) -> Column:
    """Hash of the window at ``i`` if it is an anchor, else NULL."""
    edges = [F.get(h, i + j) for j in range(K)]
    inner = F.least(*edges[1:-1]) if K > 3 else edges[1]
    return F.when(F.least(edges[0], edges[-1]) <= inner, F.xxhash64(*edges))


def anchors(text: Column) -> Column:
    """array<struct<position, hash>> of all anchors, by word position."""
    def listed(h):
        spots = F.when(F.size(h) >= K, F.sequence(F.lit(0), F.size(h) - K)).otherwise(F.array().cast("array<int>"))
        found = F.filter(F.transform(spots, lambda i: F.struct(i.alias("position"), _window_anchor(h, i).alias("hash"))),
                         lambda a: a["hash"].isNotNull())
        return F.when((F.size(found) > 0) | (F.size(h) == 0), found).otherwise(
            F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(h).alias("hash"))))
    return _let(_hashes(text), listed)


def sketch(text: Column) -> Column:
    """All distinct anchor hashes, shortened to 32 bits, in order."""
    def distinct(h):
        spots = F.when(F.size(h) >= K, F.sequence(F.lit(0), F.size(h) - K)).otherwise(F.array().cast("array<int>"))
        def short(x):
            return F.shiftright(x, 32).cast("int")
        found = F.array_compact(F.transform(spots, lambda i: short(_window_anchor(h, i))))
        return _let(found, lambda f: F.when((F.size(f) > 0) | (F.size(h) == 0), F.sort_array(F.array_distinct(f)))
                    .otherwise(F.array(short(F.xxhash64(h)))))
    return _let(_hashes(text), distinct)


def printed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common anchors (twice the common by the sum), from 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def neighbours(ids: DataFrame) -> DataFrame:
    """For distinct (id, content, n): the row before each in descending id, wrapping around.

    Ids are sorted in ranges, and only the ranges' edges (one row each) are put in one order.
    """
    order = [F.desc("id"), F.asc("content")]
    ranged = cut(ids.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order)
    row = F.struct("id", "content", "n")
    local = ranged.withColumn("before", F.lag(row).over(inside))
    last = ranged.groupBy("range").agg(F.max_by(row, F.struct(-F.col("id").cast("decimal(20,0)"), F.col("content"))).alias("last"))
    ends = Window.orderBy("range")
    edges = last.select("range", F.coalesce(F.lag("last").over(ends), F.last("last").over(
        ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    found = local.join(edges, "range").withColumn("before", F.coalesce("before", "edge"))
    return found.select("id", "content", F.col("before.id").alias("to_id"), F.col("before.content").alias("to_content"),
                        F.floor(F.col("before.n") / 2).cast("int").alias("wanted"))


def op5_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    text = whole_text("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("id"), text.alias("text"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    listed = rows.groupBy("id", "content").agg(F.first(F.length("text")).alias("n"), F.count(F.lit(1)).alias("times"))
    listed = cut(listed)
    repeated = listed.where("times > 1").limit(1).count() > 0
    order = cut(neighbours(listed.select("id", "content", "n")))
    # the texts meet their places in the order; anchors are made there, since they would take more room on the way than time
    placed = rows.join(order, ["id", "content"]).withColumn("sketch", sketch(F.col("text")))
    # both uses take the same columns of the texts, so that these are dealt out once
    parts = placed.select("to_id", "to_content", F.left("text", F.col("wanted")).alias("part"), F.col("sketch").alias("next_sketch"),
                          F.col("doc_id").alias("next_doc_id"))
    if repeated:  # equal rows hand over one part
        parts = parts.groupBy("to_id", "to_content").agg(F.first("part").alias("part"), F.first("next_sketch").alias("next_sketch"),
                                                       F.first("next_doc_id").alias("next_doc_id"))
    n = F.length("text")
    heads = placed.select("id", "content", "doc_id", n.alias("n_chars"), "sketch",
                          F.left("text", n - F.floor(n / 2).cast("int")).alias("head"))
    met = heads.join(parts, (F.col("id") == F.col("to_id")) & (F.col("content") == F.col("to_content")))
    edited = met.withColumn("edited", F.concat("head", "part"))
    done = edited.select("doc_id", "next_doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return done.select("doc_id", "n_chars", "edited_sha256", printed(F.col("sketch")).alias("fingerprint"),
                       printed(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "next_doc_id")
