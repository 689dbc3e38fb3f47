"""Mixing sources to target weights over a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash, so the order of the blocks is a random
permutation. A source is taken as often as its target holds it whole, and once more in
part: blocks in that order as long as they fit, then single documents of one more block.
The block quotas of all sources are then split along a binary tree: each node gives
its left half a multivariate-hypergeometric draw of its quotas (one univariate draw
after the other, by inversion around the mode). A leaf is an output shard; it takes the next
blocks of each source's permutation and orders its documents by a hash.

Defined results: a NULL text has size 0; NULL sources form one source, ordered last; rows
that repeat a (source, doc_id) are one document and are drawn together; an empty table
gives an empty mix; a source of size 0 has target 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .common import WORD

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BLOCK_ROWS = 256
MAX_BLOCKS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size), the words of each text."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("source", "doc_id", count.alias("size"))


def targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, documents, source_size, target) from (source, doc_id, size).

    Weights repeat over the sources in code-point order. A target above ``max_copies`` times
    its source's size stops there, and the rest is shared anew by weight until none is above.
    """
    sizes = cut(units.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("source_size")))
    # ranks inside ranges of sources, and the sizes of the ranges before
    ranged = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    ordered = ranged.withColumn("inside", inside).join(counts.select("range", before.alias("before")), "range")
    ordered = ordered.withColumn("rank", F.col("before") + F.col("inside") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ordered = cut(ordered.withColumn("weight", weight))
    total = ordered.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * float(max_copies)
    share, stopped = 0.0, -1
    while True:
        above = F.col("weight") * share > limit
        row = ordered.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("held"),
                          F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if row["n"] == stopped or row["open"] is None:
            break
        stopped, share = row["n"], (total - (row["held"] or 0.0)) / row["open"]
    return ordered.select("source", "documents", "source_size", F.least(F.col("weight") * share, limit).alias("target"))


def _block(level: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("source"), F.col("doc_id")), F.col("blocks"))


def _take(open_units: DataFrame, wanted: DataFrame, level: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Blocks that fit into ``rest`` and the one block to look into: units with block, and (source, block, whole, rest).

    Of the blocks that do not fit, the one whose largest document is smallest is opened, so
    what stays missing is less than a small document.
    """
    n = open_units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long")
    plan = cut(wanted.join(n, wanted["source"].eqNullSafe(n["source"])).drop(n["source"]).withColumn("blocks", blocks))
    placed = open_units.join(plan.select(F.col("source").alias("_s"), "blocks"),
                             F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", _block(level, seed)).drop("_s", "blocks")
    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("total"), F.max("size").alias("largest"))
    # at most MAX_BLOCKS entries a source
    lists = sums.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("block", "total", "largest"))).alias("list"))
    both = plan.join(lists, plan["source"].eqNullSafe(lists["source"])).drop(lists["source"])
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<bigint>").alias("taken"))
    greedy = F.aggregate("list", start, lambda a, b: F.when(
        b["total"] <= a["rest"],
        F.struct((a["rest"] - b["total"]).alias("rest"), F.concat(a["taken"], F.array(b["block"])).alias("taken")),
    ).otherwise(a))
    done = cut(both.withColumn("g", greedy))
    left = F.filter("list", lambda b: ~F.array_contains("g.taken", b["block"]))
    opened = F.array_min(F.transform(left, lambda b: F.struct(b["largest"], b["block"])))["block"]
    marks = F.concat(F.transform("g.taken", lambda b: F.struct(b.alias("block"), F.lit(True).alias("whole"))),
                     F.when(opened.isNotNull(), F.array(F.struct(opened.alias("block"), F.lit(False).alias("whole"))))
                     .otherwise(F.array()))
    decided = done.select("source", F.explode(marks).alias("m"), F.col("g.rest").alias("rest"))
    return placed, cut(decided.select("source", "m.block", "m.whole", "rest"))


def _matched(units: DataFrame, decided: DataFrame) -> DataFrame:
    d = decided.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "whole", "rest")
    return units.join(d, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")


def partial_pass(units: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """Units of each source that come near its ``rest``: (source, doc_id, size, chunk).

    A block too large to be looked into at once is divided into blocks again.
    """
    spark, out, level = units.sparkSession, None, 0
    open_units = units.select("source", "doc_id", "size")
    while True:
        placed, decided = _take(open_units, wanted, level, seed)
        hit = cut(_matched(placed, decided))
        chunk = F.xxhash64(F.lit(level), "block")
        whole = hit.where("whole").select("source", "doc_id", "size", chunk.alias("chunk"))
        out = whole if out is None else out.unionByName(whole)
        opened = hit.where("NOT whole")
        most = opened.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 16 * BLOCK_ROWS:
            break
        wanted = opened.groupBy("source").agg(F.first("rest").alias("rest"))
        open_units, level = opened.select("source", "doc_id", "size"), level + 1
    # at most 16 * BLOCK_ROWS documents of one block a source, largest first
    row = F.struct("size", F.xxhash64(F.lit(seed), "doc_id").alias("h"), "doc_id")
    last = opened.groupBy("source").agg(F.first("rest").alias("rest"), F.sort_array(F.collect_list(row), asc=False).alias("list"))
    start = F.struct(F.col("rest").alias("rest"), F.array().cast("array<bigint>").alias("picked"))
    picked = F.aggregate(F.sequence(F.lit(0), F.size("list") - 1), start, lambda a, i: F.when(
        F.get("list", i)["size"] <= a["rest"],
        F.struct((a["rest"] - F.get("list", i)["size"]).alias("rest"),
                 F.concat(a["picked"], F.array(i.cast("bigint"))).alias("picked")),
    ).otherwise(a))
    rows = last.select("source", "list", F.explode(picked["picked"]).alias("i"))
    got = F.get("list", F.col("i").cast("int"))
    return out.unionByName(rows.select("source", got["doc_id"].alias("doc_id"), got["size"].alias("size"),
                                       F.xxhash64(F.lit("last")).alias("chunk")))


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Marked items among ``drawn`` of ``total``, by inversion with a uniform ``u``; probabilities start from the mode."""
    t, m, n = (c.cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(F.lit(0), drawn - (total - marked)), F.least(drawn, marked)
    mode = F.least(high, F.greatest(low, F.floor((n + 1) * (m + 1) / (t + 2)).cast("bigint")))

    def up(f, k):
        return f * (m - k) * (n - k) / ((k + 1) * (t - m - n + k + 1))

    def down(f, k):
        return f * k * (t - m - n + k) / ((m - k + 1) * (n - k + 1))

    def walk(top, bottom, at, state, aim):
        """Add probabilities upwards from the mode, then downwards; the first value at which the sum reaches the aim."""
        def step(move):
            def inner(a, k):
                done = a["s"] + a["f"]
                return F.struct(move(a["f"], k.cast("double")).alias("f"), done.alias("s"),
                                F.when((a["pick"] < 0) & (done >= aim), k).otherwise(a["pick"]).alias("pick"))
            return inner
        rise = F.aggregate(F.sequence(at, top), state, step(up))
        first = down(F.lit(1.0), at.cast("double"))
        fall = F.when(at > bottom, F.sequence(at - 1, bottom, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        return F.element_at(F.transform(F.array(rise), lambda r: F.aggregate(
            fall, F.struct(first.alias("f"), r["s"].alias("s"), r["pick"].alias("pick")), step(down))), 1)

    start = F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("s"), F.lit(-1).cast("bigint").alias("pick"))
    bounds = F.array(F.struct(low.alias("low"), high.alias("high"), mode.alias("mode")))

    def solve(b):
        whole = walk(b["high"], b["low"], b["mode"], start, F.lit(float("inf")))["s"]
        pick = F.element_at(F.transform(F.array(whole), lambda w: walk(b["high"], b["low"], b["mode"], start, u * w)["pick"]), 1)
        return F.when(pick < 0, b["mode"]).otherwise(pick)

    return F.element_at(F.transform(bounds, solve), 1)


def split_quotas(quotas: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(shard, source, quota): the quotas of all sources, halved ``depth`` times without replacement."""
    part = F.struct("source", F.col("quota").cast("bigint").alias("quota"))
    # one entry for each source at the root, for each source with blocks left further down
    nodes = quotas.where("quota > 0").groupBy().agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        F.lit(0).cast("bigint").alias("node"), "parts")
    for level in range(depth):
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["quota"])

        def draw(a, p):
            h = F.xxhash64(F.lit(seed), F.col("level"), F.col("node"), p["source"])
            u = (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            k = hypergeometric(u, a["total"], p["quota"], a["want"])
            return F.element_at(F.transform(F.array(k), lambda k: F.struct(
                (a["total"] - p["quota"]).alias("total"), (a["want"] - k).alias("want"),
                F.concat(a["got"], F.array(k)).alias("got"))), 1)

        rows = nodes.withColumn("level", F.lit(level)).withColumn("total", total).withColumn("got", F.aggregate("parts", F.struct(
            F.col("total").alias("total"), F.floor(F.col("total") / 2).alias("want"),
            F.array().cast("array<bigint>").alias("got")), draw)["got"])
        rows = cut(rows)
        left = F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), F.get("got", i).alias("quota")))
        right = F.transform("parts", lambda p, i: F.struct(p["source"].alias("source"), (p["quota"] - F.get("got", i)).alias("quota")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("parts")),
                         F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("parts")))
        nodes = rows.select(F.explode(halves).alias("h")).select(
            "h.node", F.filter("h.parts", lambda p: p["quota"] > 0).alias("parts"))
    return nodes.select(F.col("node").alias("shard"), F.explode("parts").alias("p")).select("shard", "p.source", "p.quota")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, depth: int = 6,
        seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Draw the mix of (source, doc_id, size): draws, targets and units.

    ``draws`` has (source, doc_id, size, copy, shard, place); sort a shard by ``place`` to
    shuffle it. ``units`` has the documents, with repeated rows summed.
    """
    units = cut(docs.groupBy("source", "doc_id").agg(F.sum("size").alias("size")))
    goal = cut(targets(units, weights, max_copies))
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(max_copies), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    plan = cut(goal.select("source", "documents", passes.cast("int").alias("passes"),
                           (F.col("target") - passes * F.col("source_size")).alias("rest")))
    part = partial_pass(units, plan.where("rest > 0").select("source", "rest"), seed)
    blocks = F.ceil(F.col("documents") / BLOCK_ROWS).cast("long")
    blocks = F.least(F.lit(MAX_BLOCKS).cast("long"), blocks)
    whole = plan.where("passes > 0").select(F.col("source").alias("_s"), "passes", blocks.alias("blocks"))
    full = units.join(whole, F.col("source").eqNullSafe(F.col("_s"))).withColumn("chunk", _block(-1, seed))
    full = full.select("source", "doc_id", "size", "chunk", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy"))
    drawn = cut(full.unionByName(part.withColumn("copy", F.lit(0))))
    # blocks of one pass, in the order of their hash: at most max_copies * MAX_BLOCKS and the blocks of the partial pass
    chunks = cut(drawn.select("source", "copy", "chunk").distinct())
    order = Window.partitionBy("source").orderBy("copy", F.xxhash64(F.lit(seed), "copy", "chunk"), "chunk")
    turns = chunks.withColumn("turn", F.row_number().over(order).cast("bigint"))
    quotas = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    leaves = cut(split_quotas(quotas, depth, seed))
    before = F.sum("quota").over(Window.partitionBy("source").orderBy("shard"))
    spans = leaves.withColumn("last", before).select(
        "shard", F.col("source").alias("_s"), F.explode(F.sequence(F.col("last") - F.col("quota") + 1, F.col("last"))).alias("_t"))
    dealt = turns.join(spans, F.col("source").eqNullSafe(F.col("_s")) & (F.col("turn") == F.col("_t")))
    dealt = cut(dealt.select(F.col("source").alias("_s"), F.col("copy").alias("_c"), F.col("chunk").alias("_k"), "shard"))
    draws = drawn.join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("copy") == F.col("_c")) & (F.col("chunk") == F.col("_k")))
    place = F.xxhash64(F.lit(seed), "shard", "source", "doc_id", "copy")
    return draws.select("source", "doc_id", "size", "copy", "shard", place.alias("place")), goal, units


def op6_mixing(docs: DataFrame) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    rows = sized(docs)
    draws, goal, _ = mix(rows)
    copies = draws.groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("shard").alias("first_shard"))
    goal = goal.select(F.col("source").alias("_g"), "source_size", "target")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("_g")), "left")
    out = out.join(copies, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    taken = F.coalesce(F.col("copies"), F.lit(0)) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "first_shard")


def repeat_drawn(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, source, text and others), each as often as the mix draws its document."""
    draws, _, _ = mix(sized(docs))
    copies = cut(draws.groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d")).agg(F.count(F.lit(1)).cast("int").alias("_n")))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return docs.join(copies, same).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
