"""Evolving correlation networks: links of all moving windows in one job.

Cells are hashed to a few blocks and windows are grouped in short runs. A task
gets one pair of blocks (for triangles three) and one run, multiplies them piece by piece and
emits only the links that pass, or counts of them, so neither the N x N matrix nor a whole
window ever exists in one place, and the months that neighbouring windows share travel once per
run. There are as few blocks as keep ``TILES`` tasks busy, more only where a block would pass its bound.
Where all windows fit one run, a block is packed as one row and every task fetches the blocks of its tiles, so what is
shuffled follows the nodes, however many blocks there are. With several runs a node's row is copied once
per block (for triangles per pair of blocks), as pairing all packed rows would pair those of different runs too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_date
from ..session import cut, freed_shuffles

BLOCK = 32768  # most nodes of a block in pairs, and in triples
TRIPLE_BLOCK = 16384
TILES = 72
LEAST = 64  # blocks are not made smaller than this for the sake of more tasks
ROWS, COLUMNS = 256, 2048  # piece of r that a task holds
RUN = 12
BINS = 4096
FINE = 65536  # parts of a bin
HELD = 1 << 20  # links put in order at a time where they are emitted

EDGE_SCHEMA = "window_m int, src long, dst long, r double"
HIST_SCHEMA = "window_m int, bin int, n long"
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def node_id(lat="lat", lon="lon") -> Column:
    """Stable node number of a grid cell, in thousandths of a degree."""
    la = F.round((F.col(lat) + 90.0) * 1000.0).cast("long")
    lo = F.round((F.col(lon) + 360.0) * 1000.0).cast("long")
    return la * 10_000_000 + lo


def cell_nodes(field: DataFrame) -> DataFrame:
    """Field to ``node, m, value``."""
    return field.select(node_id().alias("node"), "m", "value")


def window_runs(nodes: DataFrame, size: int, run: int = RUN) -> DataFrame:
    """``node, run, first, last, x``: the values a node needs for a run of windows.

    ``x`` covers the months of all windows in the run in order, NULL where missing;
    ``first`` is the month of its first entry and ``last`` the end of the time axis.
    """
    axis = nodes.agg(F.struct(F.min("m").alias("first"), F.max("m").alias("last")).alias("e")).scalar()
    span = run + size - 1
    k = F.col("m") - F.col("_e.first")
    last_run = F.floor((F.col("_e.last") - F.col("_e.first") - (size - 1)) / run).cast("int")
    low = F.greatest(F.ceil((k - (span - 1)) / run).cast("int"), F.lit(0))
    high = F.least(F.floor(k / run).cast("int"), last_run)
    rows = (
        nodes.where(F.col("value").isNotNull())
        .withColumn("_e", axis)
        .withColumn("run", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high)))))
    )
    first = F.col("_e.first") + F.col("run") * run
    rows = rows.select("node", "run", "value", first.alias("first"), F.col("_e.last").alias("last"),
                       (F.col("m") - first).alias("pos"))
    have = F.map_from_entries(F.collect_list(F.struct("pos", "value")))
    packed = rows.groupBy("node", "run", "first", "last").agg(have.alias("_have"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: F.try_element_at("_have", i))
    return packed.select("node", "run", "first", "last", slots.alias("x"))


def window_nodes(runs: DataFrame, size: int, run: int = RUN) -> DataFrame:
    """``window_m, node``: nodes with at least one value in the window."""
    offsets = F.sequence(F.lit(0), F.lit(run - 1))
    alive = F.filter(offsets, lambda i: (F.col("first") + i + (size - 1) <= F.col("last"))
                     & F.exists(F.slice("x", i + 1, size), lambda v: v.isNotNull()))
    return runs.select("node", "first", F.explode(alive).alias("i")).select(
        (F.col("first") + F.col("i") + (size - 1)).cast("int").alias("window_m"), "node"
    )


def _dealt(runs: DataFrame, block: int, sides: int) -> tuple[int, int]:
    """The number of runs, and of blocks that the nodes of each are dealt to."""
    with freed_shuffles(runs.sparkSession):
        n_nodes, n_runs = runs.agg(F.count_distinct("node"), F.count_distinct("run")).first()
    n_blocks = max(1, math.ceil(n_nodes / block))
    while n_runs * math.comb(n_blocks + sides - 1, sides) < TILES and n_blocks * LEAST < n_nodes:
        n_blocks += 1
    return n_runs, n_blocks


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int").alias("block")


def _tiles(runs: DataFrame, block: int, sides: int = 2, dealt: tuple[int, int] | None = None) -> tuple[DataFrame, int]:
    """Copies of each node row for every set of ``sides`` blocks it belongs to, tile by tile; and the number of blocks.

    A tile is a sorted set of blocks, repeats allowed, as the digits of a number to the base of their count.
    """
    n_runs, n_blocks = _dealt(runs, block, sides) if dealt is None else dealt
    top = F.lit(n_blocks - 1)
    others = F.transform(F.sequence(F.lit(0), top), lambda i: F.array(i))
    for _ in range(sides - 2):
        others = F.flatten(F.transform(others, lambda a: F.transform(
            F.sequence(F.element_at(a, -1), top), lambda j: F.concat(a, F.array(j)))))
    rows = runs.withColumn("block", _block(n_blocks))
    rows = rows.withColumn("_o", F.explode(others))
    blocks = F.sort_array(F.concat(F.array("block"), F.col("_o")))
    tile = F.aggregate(blocks, F.lit(0).cast("long"), lambda t, i: t * n_blocks + i)
    rows = rows.select("run", tile.alias("tile"), "block", "node", "first", "last", "x")
    # an explicit number of partitions is not coalesced again
    tiles = n_runs * math.comb(n_blocks + sides - 1, sides)
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(tiles, 20000))
    return rows.repartition(parts, "run", "tile").sortWithinPartitions("run", "tile"), n_blocks


def _packed(runs: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block of a single run: its nodes in order and their values, NaN where missing."""
    arrow = pa.schema([("block", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("node", pa.list_(pa.int64())), ("x", pa.binary())])

    def rows(batches):
        for table in _same(batches, "block"):
            node = table["node"].combine_chunks()
            order = np.argsort(node.to_numpy(zero_copy_only=False))
            nodes = pa.ListArray.from_arrays(pa.array([0, len(node)], pa.int32()), node.take(pa.array(order)))
            one = table.slice(0, 1).combine_chunks()
            cells = [one[c].combine_chunks() for c in ("block", "first", "last")]
            yield pa.RecordBatch.from_arrays([*cells, nodes, pa.array([_values(table)[order].tobytes()], pa.binary())], schema=arrow)

    found = runs.select(_block(n_blocks), F.col("first").cast("long"), F.col("last").cast("long"), "node", "x")
    found = found.repartitionById(n_blocks, "block").sortWithinPartitions("block")
    return found.mapInArrow(rows, "block int, first long, last long, node array<long>, x binary")


def _block_sets(runs: DataFrame, n_blocks: int, sides: int) -> DataFrame:
    """Every sorted set of ``sides`` packed blocks, repeats allowed, as one row.

    A task fetches the blocks of its sets from the tasks that packed them, so no block is written more than once a side.
    """
    packed = _packed(runs, n_blocks)

    def side(k: int, parts: int = n_blocks) -> DataFrame:
        dealt = packed.repartitionById(parts, "block")
        return dealt.select(*[F.col(c).alias(f"{c}{k}") for c in packed.columns])

    sets = side(sides - 1)
    for k in reversed(range(sides - 1)):
        # the first of three blocks comes in fewer parts where pairs of the others are tasks enough
        parts = n_blocks if k == sides - 2 else min(n_blocks, math.ceil(4 * TILES / math.comb(n_blocks + 1, 2)))
        sets = side(k, parts).join(sets.hint("shuffle_replicate_nl"), F.col(f"block{k}") <= F.col(f"block{k + 1}"))
    return sets


def _same(batches, *keys: str):
    """The rows with equal keys at a time, wherever the batches end; keys that are equal follow each other."""
    key, held = None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = (np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(int(c[low]) for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _values(table: pa.Table) -> np.ndarray:
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["x"].chunks])
    return x.reshape(len(table), -1)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Centred rows of length 1; rows with gaps or without spread become 0."""
    centred = x - x.mean(axis=1, keepdims=True)
    length = np.sqrt((centred * centred).sum(axis=1, keepdims=True))
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    good = np.isfinite(length) & (length > 1e-12 * np.where(np.isfinite(scale), scale, 0.0)) & (length > 0)
    return np.where(good, centred / np.where(good, length, 1.0), 0.0)


def _tile_windows(table: pa.Table, size: int, run: int, n_blocks: int, sides: int):
    """Per window of a tile: end month, and for each side its block's number, node ids in order and unit rows."""
    node, block, x = table["node"].to_numpy(), table["block"].to_numpy(), _values(table)
    tile = table["tile"][0].as_py()
    order = np.argsort(node)
    numbers = [tile // n_blocks ** k % n_blocks for k in reversed(range(sides))]
    held = {}
    for b in set(numbers):
        at = order[block[order] == b]
        held[b] = (b, node[at], x[at])
    yield from _windows(table["first"][0].as_py(), table["last"][0].as_py(), held, numbers, size, run)


def _set_windows(batches, size: int, run: int, sides: int):
    """The same for sets of packed blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            numbers, held = [batch.column(f"block{k}")[i].as_py() for k in range(sides)], {}
            for k, b in enumerate(numbers):
                node = batch.column(f"node{k}")[i].values.to_numpy(zero_copy_only=False)
                held[b] = (b, node, np.frombuffer(batch.column(f"x{k}")[i].as_buffer()).reshape(len(node), -1))
            yield from _windows(batch.column("first0")[i].as_py(), batch.column("last0")[i].as_py(), held, numbers, size, run)


def _windows(first: int, last: int, held: dict, numbers: list, size: int, run: int):
    for i in range(run):
        end = first + i + size - 1
        if end > last:
            break
        units = {b: (b, node, _unit_rows(x[:, i:i + size])) for b, (_, node, x) in held.items()}
        yield end, [units[b] for b in numbers]


def _pieces(left, right):
    """Node ids of both sides, r and the mask of real pairs (None: all), in pieces of bounded size."""
    (b1, na, za), (b2, nb, zb) = left, right
    for i in range(0, len(na), ROWS):
        for j in range(0, len(nb), COLUMNS):
            a, b = na[i:i + ROWS], nb[j:j + COLUMNS]
            if b1 == b2 and a[0] >= b[-1]:
                continue
            mask = a[:, None] < b[None, :] if b1 == b2 and a[-1] >= b[0] else None
            yield a, b, za[i:i + ROWS] @ zb[j:j + COLUMNS].T, mask


def _scan(runs: DataFrame, size: int, work, schema: str, run: int, block: int, sides: int = 2) -> DataFrame:
    """Rows that ``work(end, *sides)`` yields, as lists of columns, for every window of every tile."""
    n_runs, n_blocks = dealt = _dealt(runs, block, sides)
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def windows(batches):
        if n_runs == 1:
            yield from _set_windows(batches, size, run, sides)
        else:
            for table in _same(batches, "run", "tile"):
                yield from _tile_windows(table, size, run, n_blocks, sides)

    def rows(batches):
        for end, parts in windows(batches):
            for columns in work(end, *parts):
                if len(columns[0]):
                    month = np.full(len(columns[0]), end, dtype=np.int32)
                    arrays = [pa.array(c, f.type) for c, f in zip((month, *columns), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    tiles = _block_sets(runs, n_blocks, sides) if n_runs == 1 else _tiles(runs, block, sides, dealt)[0]
    return tiles.mapInArrow(rows, schema)


def _chosen(runs: DataFrame, size: int, choose, run: int, block: int) -> DataFrame:
    """``window_m, src, dst, r`` for the places (i, j) of each piece that ``choose(end, a, b, r, mask)`` gives.

    Up to ``HELD`` links of a tile come in order of r: equal values follow each other, which takes less room where links are written.
    """

    def links(end, left, right):
        held, n = [], 0
        for a, b, r, mask in _pieces(left, right):
            i, j = choose(end, a, b, r, mask)
            held.append((np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), r[i, j]))
            n += len(i)
            if n >= HELD:
                yield in_order(held)
                held, n = [], 0
        if n:
            yield in_order(held)

    def in_order(held):
        src, dst, r = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(r)
        return src[order], dst[order], r[order]

    return _scan(runs, size, links, EDGE_SCHEMA, run, block)


def _real(hit: np.ndarray, mask) -> np.ndarray:
    return hit if mask is None else hit & mask


def correlation_links(runs: DataFrame, size: int, keep, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``window_m, src, dst, r`` for the pairs that ``keep(r, window_m)`` selects (src < dst)."""
    return _chosen(runs, size, lambda end, a, b, r, mask: np.nonzero(_real(keep(r, end), mask)), run, block)


def correlation_histogram(runs: DataFrame, size: int, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``window_m, bin, n``: number of pairs per bin of r, bin 0 holding r = 1."""

    def counts(end, left, right):
        n = np.zeros(BINS, dtype=np.int64)
        for _, _, r, mask in _pieces(left, right):
            n += np.bincount(_bin(r if mask is None else r[mask]).ravel(), minlength=BINS)
        yield np.flatnonzero(n), n[n > 0]

    return _scan(runs, size, counts, HIST_SCHEMA, run, block).groupBy("window_m", "bin").agg(F.sum("n").alias("n"))


def _bin(r: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((1.0 - r) * (BINS / 2.0)), 0, BINS - 1).astype(np.int32)


def link_degrees(runs: DataFrame, size: int, threshold: float, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``window_m, node, degree`` of every linked node, counted in the tiles."""

    def counts(end, left, right):
        n, m = np.zeros(len(left[1]), dtype=np.int64), np.zeros(len(right[1]), dtype=np.int64)
        for a, b, r, mask in _pieces(left, right):
            hit = _real(np.abs(r) > threshold, mask)
            i, j = np.searchsorted(left[1], a[0]), np.searchsorted(right[1], b[0])
            n[i:i + len(a)] += np.count_nonzero(hit, axis=1)
            m[j:j + len(b)] += np.count_nonzero(hit, axis=0)
        yield left[1][n > 0], n[n > 0]
        yield right[1][m > 0], m[m > 0]

    found = _scan(runs, size, counts, "window_m int, node long, degree long", run, block)
    return found.groupBy("window_m", "node").agg(F.sum("degree").alias("degree"))


def link_totals(runs: DataFrame, size: int, threshold: float, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """``window_m, n_pairs, n_links, total``: number of pairs, of links with abs(r) above the threshold, and the sum of their r."""

    def counts(end, left, right):
        pairs, links, total = 0, 0, 0.0
        for _, _, r, mask in _pieces(left, right):
            real = r if mask is None else r[mask]
            held = real[np.abs(real) > threshold]
            pairs, links, total = pairs + real.size, links + held.size, total + float(held.sum())
        yield np.array([pairs]), np.array([links]), np.array([total])

    found = _scan(runs, size, counts, "window_m int, n_pairs long, n_links long, total double", run, block)
    return found.groupBy("window_m").agg(*[F.sum(c).alias(c) for c in ("n_pairs", "n_links", "total")])


def top_links(runs: DataFrame, size: int, k: int, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The ``k`` first links of each tile and window by r descending, src, dst; the first of all are among them."""

    def best(end, left, right):
        s, d, top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for a, b, r, mask in _pieces(left, right):
            i, j = np.nonzero(_real(r >= top[-1] if len(top) == k else np.ones(r.shape, dtype=bool), mask))
            if len(i) == 0:
                continue
            value = r[i, j]
            if len(i) > k:
                good = value >= np.partition(value, len(i) - k)[len(i) - k]
                i, j, value = i[good], j[good], value[good]
            s, d = np.append(s, np.minimum(a[i], b[j])), np.append(d, np.maximum(a[i], b[j]))
            top = np.append(top, value)
            order = np.lexsort((d, s, -top))[:k]
            s, d, top = s[order], d[order], top[order]
        yield s, d, top

    return _scan(runs, size, best, EDGE_SCHEMA, run, block)


def _bits(left, right, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks as bits: a row per left node over the right ones, and the other way round."""
    (b1, na, za), (b2, nb, zb) = left, right
    over = np.zeros((len(na), -(-len(nb) // 64) * 8), dtype=np.uint8)
    back = np.zeros((len(nb), -(-len(na) // 64) * 8), dtype=np.uint8)
    for i in range(0, len(na), ROWS):
        for j in range(0, len(nb), COLUMNS):
            a, b = na[i:i + ROWS], nb[j:j + COLUMNS]
            hit = np.abs(za[i:i + ROWS] @ zb[j:j + COLUMNS].T) > threshold
            if b1 == b2:
                hit &= a[:, None] < b[None, :]
            over[i:i + len(a), j // 8:j // 8 + -(-len(b) // 8)] = np.packbits(hit, axis=1)
            back[j:j + len(b), i // 8:i // 8 + -(-len(a) // 8)] = np.packbits(np.ascontiguousarray(hit.T), axis=1)
    return over.view(np.uint64), back.view(np.uint64)


def _ones(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(row.view(np.uint8)))


def link_corners(runs: DataFrame, size: int, threshold: float, run: int = RUN, block: int = TRIPLE_BLOCK) -> DataFrame:
    """``window_m, node, degree, triangles`` of every linked node, without a table of links.

    A task has three blocks u, v, w and finds their links anew from the rows, as bits. The triangles over a link
    (u, v) are the bits that its ends share over w; nodes are in order, so each triangle is met once.
    """

    held = {}

    def counts(end, u, v, w):
        pair = (end, v[0], w[0])
        if pair not in held:  # a task has its pairs of v and w in a row
            held.clear()
            held[pair] = _bits(v, w, threshold)
        (uv, vu), (uw, wu), (vw, wv) = _bits(u, v, threshold), _bits(u, w, threshold), held[pair]
        at_u, at_v, at_w = (np.zeros(len(p[1]), dtype=np.int64) for p in (u, v, w))
        for i in range(len(at_u)):
            if uw[i].any():
                ends = _ones(uv[i])
                shared = np.bitwise_count(vw[ends] & uw[i]).sum(axis=1, dtype=np.int64)
                at_u[i] += shared.sum()
                at_v[ends] += shared
        for i in range(len(at_w)):
            if wv[i].any():
                at_w[i] += np.bitwise_count(uv[_ones(wu[i])] & wv[i]).sum(dtype=np.int64)
        # the links of two blocks are counted where the last of them is repeated
        last = v[0] == w[0]
        of_u, of_v = (np.bitwise_count(t).sum(axis=1, dtype=np.int64) if last else np.zeros(len(t), np.int64) for t in (uv, vu))
        for part, links, found in ((u, of_u, at_u), (v, of_v, at_v), (w, np.zeros(len(at_w), np.int64), at_w)):
            some = (links > 0) | (found > 0)
            yield part[1][some], links[some], found[some]

    schema = "window_m int, node long, degree long, triangles long"
    found = _scan(runs, size, counts, schema, run, block, 3)
    return found.groupBy("window_m", "node").agg(F.sum("degree").alias("degree"), F.sum("triangles").alias("triangles"))


def threshold_links(runs: DataFrame, size: int, threshold: float, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Links with abs(r) above a fixed threshold."""
    return correlation_links(runs, size, lambda r, _: np.abs(r) > threshold, run, block)


def _reached(counts: DataFrame, wanted: DataFrame, *order: str) -> dict:
    """Per window the group in which the last wanted link lies: its key, the links still wanted from it, and its size.

    One row per window reaches the driver: bounded by the number of months. The copies of rows that
    the counting shuffled are deleted with it, so passes do not add up on disk.
    """
    w = Window.partitionBy("window_m").orderBy(*order)
    before = counts.withColumn("_before", F.sum("n").over(w) - F.col("n")).join(wanted, "window_m")
    group = F.struct(*order, (F.col("wanted") - F.col("_before")).alias("rest"), "n")
    with freed_shuffles(counts.sparkSession):
        edge = before.where(F.col("_before") < F.col("wanted")).groupBy("window_m").agg(F.max(group).alias("g"))
        return {row.window_m: tuple(row.g) for row in edge.collect()}


def _open(edge: dict) -> dict:
    """Windows whose last group is wanted in part."""
    return {end: group for end, group in edge.items() if group[-2] < group[-1]}


def _rest(spark, edge: dict) -> DataFrame:
    return spark.createDataFrame([(end, group[-2]) for end, group in edge.items()], "window_m int, wanted long")


def _fine(r: np.ndarray, at: int) -> np.ndarray:
    """Part of bin ``at`` that values of it lie in."""
    return np.clip(np.floor(((1.0 - r) * (BINS / 2.0) - at) * FINE), 0, FINE - 1).astype(np.int32)


def _near(r: np.ndarray, mask, at: int):
    """Places of the pairs whose bin is at most ``at``, and their bins."""
    low = 1.0 - (at + 1) / (BINS / 2.0) - 1e-9
    i, j = np.nonzero(_real(r > low if at < BINS - 1 else np.ones(r.shape, dtype=bool), mask))
    bins = _bin(r[i, j])
    good = bins <= at
    return i[good], j[good], bins[good]


def strongest_links(runs: DataFrame, size: int, wanted: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The ``wanted`` links of largest signed r per window (table ``window_m, wanted``).

    Passes of counting place the last wanted link in the order r descending, src, dst: by bins of r, by parts
    of its bin, by r and src within its part, and by dst where ties remain. A last pass emits
    exactly the links up to it, so no link is written, sorted or shuffled on the way. Every pass reads
    ``runs``: give a table, as of ``cut``.
    """
    spark = runs.sparkSession
    with freed_shuffles(spark):
        wanted = cut(wanted)
    bins = _reached(correlation_histogram(runs, size, run, block), wanted, "bin")
    split = _open(bins)

    def parts(end, left, right):
        if end not in split:
            return
        at, n = split[end][0], np.zeros(FINE, dtype=np.int64)
        for _, _, r, mask in _pieces(left, right):
            i, j, b = _near(r, mask, at)
            n += np.bincount(_fine(r[i[b == at], j[b == at]], at), minlength=FINE)
        yield np.flatnonzero(n), n[n > 0]

    fine = {}
    if split:
        found = _scan(runs, size, parts, HIST_SCHEMA, run, block).groupBy("window_m", "bin").agg(F.sum("n").alias("n"))
        fine = _reached(found, _rest(spark, split), "bin")
    tied = _open(fine)

    def inside(end, a, b, r, mask):
        """Pairs in the part of the bin that is still to be divided."""
        i, j, at = _near(r, mask, split[end][0])
        good = at == split[end][0]
        i, j = i[good], j[good]
        good = _fine(r[i, j], split[end][0]) == fine[end][0]
        i, j = i[good], j[good]
        return np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), r[i, j]

    def sources(end, left, right):
        if end not in tied:
            return
        q, s, n = np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b, r, mask in _pieces(left, right):
            src, _, value = inside(end, a, b, r, mask)
            if len(src):
                # equal (r, src) are counted at once, so many ties stay few rows
                q, s, n = np.append(q, -value), np.append(s, src), np.append(n, np.ones(len(src), np.int64))
                order = np.lexsort((s, q))
                q, s, n = q[order], s[order], n[order]
                first = np.flatnonzero(np.append(True, (np.diff(q) != 0) | (np.diff(s) != 0)))
                q, s, n = q[first], s[first], np.add.reduceat(n, first)
        yield q, s, n

    exact = {}
    if tied:
        found = _scan(runs, size, sources, "window_m int, q double, src long, n long", run, block)
        found = found.groupBy("window_m", "q", "src").agg(F.sum("n").alias("n"))
        exact = _reached(found, _rest(spark, tied), "q", "src")
    level = _open(exact)

    def ends(end, left, right):
        if end not in level:
            return
        q, s = level[end][:2]
        for a, b, r, mask in _pieces(left, right):
            src, dst, value = inside(end, a, b, r, mask)
            hit = dst[(value == -q) & (src == s)]
            yield hit, np.ones(len(hit), np.int64)

    last = {}
    if level:
        last = _reached(_scan(runs, size, ends, "window_m int, dst long, n long", run, block), _rest(spark, level), "dst")

    def choose(end, a, b, r, mask):
        if end not in bins:
            return np.empty(0, int), np.empty(0, int)
        at = bins[end][0]
        i, j, near = _near(r, mask, at)
        if end not in fine:
            return i, j
        part = np.where(near < at, -1, _fine(r[i, j], at))
        good = part <= fine[end][0]
        if end in exact:
            q, s = exact[end][:2]
            src, dst = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            same = (src == s) & (dst <= last[end][0]) if end in last else src == s
            good &= (part < fine[end][0]) | (-r[i, j] < q) | ((-r[i, j] == q) & ((src < s) | same))
        return i[good], j[good]

    return _chosen(runs, size, choose, run, block)


def density_links(runs: DataFrame, size: int, density: float, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The int(density * N (N - 1) / 2) links of largest signed r per window."""
    with freed_shuffles(runs.sparkSession):
        runs = cut(runs)
    return strongest_links(runs, size, wanted_links(window_nodes(runs, size, run), density), run, block)


def wanted_links(nodes: DataFrame, density: float) -> DataFrame:
    n = F.col("_n")
    counts = nodes.groupBy("window_m").agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("window_m", F.floor(density * (n * (n - 1) / 2)).cast("long").alias("wanted"))


def first_links(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exactly ``wanted`` links per window in the order r descending, src, dst.

    Settled level by level (coarse bin of r, fine bin, r with src, dst): groups wholly
    inside the limit are kept from counts alone, only the group on the limit goes on.
    """
    r = F.col("r")
    current = links.withColumns({
        "_l0": F.floor((1.0 - r) * (BINS / 2.0)).cast("long"),
        "_l1": F.floor((1.0 - r) * (BINS / 2.0) * 65536.0).cast("long"),
        "_l2": F.struct((-r).alias("a"), F.col("src").alias("b")),
        "_l3": F.col("dst"),
    }).join(wanted, "window_m")
    kept = None
    for level in ("_l0", "_l1", "_l2", "_l3"):
        sizes = current.groupBy("window_m", level).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("window_m").orderBy(level)
        sizes = sizes.withColumn("_upto", F.sum("_n").over(w))
        joined = current.join(sizes, ["window_m", level])
        part = joined.where(F.col("_upto") <= F.col("wanted")).select("window_m", "src", "dst", "r")
        kept = part if kept is None else kept.unionByName(part)
        before = F.col("_upto") - F.col("_n")
        current = joined.where((F.col("_upto") > F.col("wanted")) & (before < F.col("wanted"))).withColumn(
            "wanted", F.col("wanted") - before
        ).drop("_n", "_upto")
    return kept


def network_links(runs: DataFrame, size: int, threshold: float | None = None, edge_density: float | None = None,
                  run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Links by threshold or by edge density; exactly one of the two must be given."""
    if (threshold is None) == (edge_density is None):
        raise ValueError("give either a threshold or an edge density")
    if threshold is not None:
        return threshold_links(runs, size, threshold, run, block)
    return density_links(runs, size, edge_density, run, block)


def network_metrics(nodes: DataFrame, size: int = 12, threshold: float | None = None, edge_density: float | None = None,
                    run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Eleven network metrics per moving window, stamped with the window's last month."""
    from . import graph

    runs = cut(window_runs(nodes, size, run))
    links = cut(network_links(runs, size, threshold, edge_density, run, block))
    present = cut(window_nodes(runs, size, run))
    counts = cut(graph.node_counts(present))
    corner = graph.corners(links)
    out = (
        graph.transitivity(links, counts, corner)
        .join(graph.local_clustering(links, counts, corner), "window_m")
        .join(graph.cluster_fractions(graph.components(links, present), counts), "window_m")
        .join(graph.average_path_length(links, present), "window_m", "left")
        .join(graph.hamming(links, counts), "window_m")
        .join(graph.edge_density(links, counts), "window_m")
    )
    if threshold is not None:
        out = out.withColumn("threshold", F.lit(float(threshold)))
    else:
        out = out.join(links.groupBy("window_m").agg(F.min("r").alias("threshold")), "window_m", "left")
    return out.select(month_date("window_m").alias("time"), "global_transitivity", "avelocal_transmissivity",
                      "fraction_clusters_size_2", "fraction_clusters_size_3", "fraction_clusters_size_5",
                      "fraction_giant_component", "average_path_length", "hamming_distance",
                      "corrected_hamming_distance", "threshold", "edge_density")
