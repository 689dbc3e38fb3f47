"""Correlation links against brute force, graph metrics against a hand-computed fixture."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.operators import graph, network
from tropicast.session import cut

W1 = [(1, 2), (2, 3), (1, 3), (3, 4), (5, 6)]
W2 = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]


@pytest.fixture(scope="module")
def net(spark):
    links = spark.createDataFrame([(w, s, d) for w, e in ((10, W1), (11, W2)) for s, d in e], "window_m int, src long, dst long")
    nodes = spark.createDataFrame([(w, n) for w in (10, 11) for n in range(1, 8)], "window_m int, node long")
    return links, nodes, graph.node_counts(nodes)


def first(df, name):
    return df.where("window_m = 10").first()[name]


def test_counts(net):
    links, nodes, counts = net
    assert first(graph.edge_density(links, counts), "edge_density") == pytest.approx(5 / 21)
    assert first(graph.transitivity(links, counts), "global_transitivity") == pytest.approx(0.6)
    assert first(graph.local_clustering(links, counts), "avelocal_transmissivity") == pytest.approx((1 + 1 + 1 / 3) / 7)


def test_components(net):
    links, nodes, counts = net
    row = graph.cluster_fractions(graph.components(links, nodes), counts).where("window_m = 10").first()
    assert row.fraction_clusters_size_2 == pytest.approx(1 / 7)
    assert row.fraction_clusters_size_3 == 0 and row.fraction_clusters_size_5 == 0
    assert row.fraction_giant_component == pytest.approx(4 / 7)


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(60)], "window_m int, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in range(61)], "window_m int, node long")
    assert graph.components(links, nodes).select("component").distinct().count() == 1


def test_paths(net):
    links, nodes, _ = net
    assert first(graph.average_path_length(links, nodes), "average_path_length") == pytest.approx(9 / 7)


def test_paths_with_many_sources(spark):
    """More sources than one word and more than one bucket."""
    n = 150
    rows = [(1, i, i + 1) for i in range(n - 1)]
    links = spark.createDataFrame(rows + [(1, 0, n - 1)], "window_m int, src long, dst long")
    nodes = spark.createDataFrame([(1, i) for i in range(n)], "window_m int, node long")
    got = graph.average_path_length(links.where("dst - src = 1 or src = 0"), nodes, bucket=70)
    want = sum(min(d, n - d) for d in range(1, n)) / (n - 1)
    assert first(got.withColumn("window_m", F.lit(10)), "average_path_length") == pytest.approx(want)


def test_hamming(net):
    links, _, counts = net
    rows = {r.window_m: r for r in graph.hamming(links, counts).collect()}
    assert rows[10].hamming_distance == 0 and rows[10].corrected_hamming_distance == 0
    assert rows[11].hamming_distance == pytest.approx(2 / 21)
    assert rows[11].corrected_hamming_distance == pytest.approx(2 / 21)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    common = rng.normal(size=30)
    x = np.array([common * rng.uniform(0, 1.5) + rng.normal(size=30) for _ in range(40)])
    x[4, 10] = np.nan
    x[5] = 1.0
    x[6] = np.nan
    rows = [(n, 100 + t, float(x[n, t])) for n in range(40) for t in range(30) if not np.isnan(x[n, t])]
    return x, spark.createDataFrame(rows, "node long, m int, value double")


def brute(x, size):
    for end in range(size - 1, x.shape[1]):
        z = x[:, end - size + 1:end + 1]
        with np.errstate(all="ignore"):
            r = np.corrcoef(z)
        yield 100 + end, np.nan_to_num(r), np.isfinite(z).any(axis=1)


@pytest.mark.parametrize("block, run", [(512, 12), (7, 5), (16, 1)])
def test_threshold_links(data, block, run):
    x, df = data
    runs = network.window_runs(df, 12, run)
    got = {(r.window_m, r.src, r.dst): r.r for r in network.threshold_links(runs, 12, 0.6, run, block).collect()}
    want = {(w, i, j): r[i, j] for w, r, _ in brute(x, 12) for i in range(40) for j in range(i + 1, 40) if abs(r[i, j]) > 0.6}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    alive = {(r.window_m, r.node) for r in network.window_nodes(runs, 12, run).collect()}
    assert alive == {(w, n) for w, _, ok in brute(x, 12) for n in range(40) if ok[n]}


def test_density_links(data):
    x, df = data
    runs = network.window_runs(df, 12)
    got = {}
    for r in network.density_links(runs, 12, 0.05, block=16).collect():
        got.setdefault(r.window_m, set()).add((r.src, r.dst))
    for w, r, alive in brute(x, 12):
        n = int(alive.sum())
        k = int(0.05 * n * (n - 1) / 2)
        order = sorted((-r[i, j], i, j) for i in range(40) for j in range(i + 1, 40) if alive[i] and alive[j])
        assert got[w] == {(i, j) for _, i, j in order[:k]}


def test_first_links_with_ties(spark):
    rows = [(1, i, j, 1.0) for i in range(20) for j in range(i + 1, 20)]
    links = spark.createDataFrame(rows, "window_m int, src long, dst long, r double")
    wanted = spark.createDataFrame([(1, 33)], "window_m int, wanted long")
    got = {(r.src, r.dst) for r in network.first_links(links, wanted).collect()}
    assert got == {(i, j) for _, i, j, _ in sorted(rows)[:33]}


def test_one_rule_only(data):
    with pytest.raises(ValueError):
        network.network_links(data[1], 12)


def test_metric_series(spark, data):
    _, df = data
    table = network.network_metrics(df.where("m < 116"), 12, threshold=0.6, block=16)
    rows = table.orderBy("time").collect()
    assert len(rows) == 5 and len(table.columns) == 12
    assert rows[0].hamming_distance == 0
    assert all(r.corrected_hamming_distance <= r.hamming_distance + 1e-12 for r in rows)


@pytest.mark.parametrize("words, bucket", [(1, 4096), (2, 100)])
def test_metrics_of_random_networks_by_brute_force(spark, words, bucket):
    """Sparse, dense, cyclic and unconnected networks side by side; some nodes have no link."""
    rng = np.random.default_rng(7)
    links, nodes, want = [], [], {}
    for window, (n, share) in enumerate([(200, 0.012), (40, 0.5), (90, 0.03), (12, 0.0)], start=1):
        near = np.triu(rng.random((n, n)) < share, 1)
        if window == 3:
            near[np.arange(n - 1), np.arange(1, n)] = True  # one long path with shortcuts
        links += [(window, int(a), int(b)) for a, b in np.argwhere(near)]
        nodes += [(window, i) for i in range(n)]
        both = (near | near.T).astype(np.int64)
        depth, walk, at = np.where(both > 0, 1, 0), both, 1
        np.fill_diagonal(depth, -1)
        while True:
            at, walk = at + 1, ((walk @ both) > 0).astype(np.int64)
            fresh = (walk > 0) & (depth == 0)
            if at > n or not (walk > 0).any():
                break
            depth[fresh] = at
        deg, tri = both.sum(0), np.diag(both @ both @ both) / 2
        triples = deg * (deg - 1) / 2
        local = np.divide(tri, triples, out=np.zeros(n), where=triples > 0).mean()
        want[window] = (depth[depth > 0].mean() if (depth > 0).any() else None, tri.sum() / triples.sum() if triples.sum() else None, local)
    links = spark.createDataFrame(links, "window_m int, src long, dst long")
    nodes = spark.createDataFrame(nodes, "window_m int, node long")
    counts, corner = graph.node_counts(nodes), graph.corners(links)
    got = graph.transitivity(links, counts, corner).join(graph.local_clustering(links, counts, corner), "window_m").join(
        graph.average_path_length(links, nodes, bucket, words), "window_m", "left")
    found = {r.window_m: (r.average_path_length, r.global_transitivity, r.avelocal_transmissivity) for r in got.collect()}
    assert found.keys() == want.keys()
    for window, values in want.items():
        assert found[window] == tuple(None if v is None else pytest.approx(v) for v in values)


def test_rows_dealt_follow_the_nodes(spark):
    """Four times the nodes are four times the rows that tiles read, not sixteen times."""
    copies = []
    for n in (1200, 4800):
        runs = spark.range(n).selectExpr("id AS node", "0 AS run", "0 AS first", "3 AS last", "array(1d, id, 2d, 0d) AS x")
        copies.append(network._tiles(runs, network.BLOCK)[0].count() / n)
    assert copies[0] == copies[1]


@pytest.fixture(scope="module")
def copied(spark):
    """Two windows of 60 nodes, of which 25 are copies of one and some have no spread."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)).round(1)
    x[10:35] = x[3]
    x[50:53] = 2.0
    rows = [(n, 100 + t, float(x[n, t])) for n in range(60) for t in range(7)]
    return network.window_runs(spark.createDataFrame(rows, "node long, m int, value double"), 6)


def in_order(runs, block):
    every = network.correlation_links(runs, 6, lambda r, _: r > -2, block=block).collect()
    for w in (105, 106):
        yield w, sorted((-r.r, r.src, r.dst) for r in every if r.window_m == w)


@pytest.mark.parametrize("block", [9, 32768])
def test_top_links(copied, block):
    got = [(r.window_m, -r.r, r.src, r.dst) for r in network.top_links(copied, 6, 20, block=block).collect()]
    for w, order in in_order(copied, block):
        assert sorted(row[1:] for row in got if row[0] == w)[:20] == order[:20]


@pytest.mark.parametrize("key, dropped", [("l2", "strongest_links"), ("n6", "correlation_links"), ("n3", "first_links"), ("n7", "correlation_links"), ("n4", "correlation_links"), ("n5", "correlation_links"), ("j6", "correlation_links")])
def test_no_links_are_written(spark, monkeypatch, key, dropped):
    from __spark_entry__ import SMOKE_DIR, queries

    def refuse(*_, **__):
        raise AssertionError("a table of links")

    monkeypatch.setattr(network, dropped, refuse)
    assert queries()[key](spark, SMOKE_DIR).count() > 0


@pytest.mark.parametrize("block", [9, 30, 16384])
def test_corners_without_links(copied, block):
    got = {(r.window_m, r.node): (r.degree, r.triangles) for r in network.link_corners(copied, 6, 0.5, block=block).collect()}
    want = {}
    for w, order in in_order(copied, block):
        near = np.zeros((60, 60), dtype=np.int64)
        for q, s, d in order:
            near[s, d] = near[d, s] = abs(q) > 0.5
        around = np.diag(near @ near @ near) // 2
        want |= {(w, n): (near[n].sum(), around[n]) for n in range(60) if near[n].any()}
    assert got == want


@pytest.mark.parametrize("block", [9, 32768])
@pytest.mark.parametrize("k", [1, 37, 290, 305, 5000])
def test_strongest_links_with_ties(spark, copied, block, k):
    """The last wanted link lies among the pairs of 26 copies, after them, or beyond all pairs."""
    wanted = spark.createDataFrame([(105, k), (106, k // 2)], "window_m int, wanted long")
    got = [(r.window_m, -r.r, r.src, r.dst) for r in network.strongest_links(copied, 6, wanted, block=block).collect()]
    for w, order in in_order(copied, block):
        assert sorted(row[1:] for row in got if row[0] == w) == order[:k if w == 105 else k // 2]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_counting_leaves_no_shuffles(spark, copied):
    """All four passes of counting are needed here; the rows they shuffled are gone before the links are made."""
    runs = cut(copied)
    wanted = spark.createDataFrame([(105, 290), (106, 145)], "window_m int, wanted long")
    before = shuffle_files(spark)
    links = network.strongest_links(runs, 6, wanted)
    until = time.time() + 10  # files are deleted in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert links.count() == 435 and links.count() == 435


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


@pytest.mark.parametrize("key, step", [("n7", "link_corners"), ("n6", "link_corners"), ("n3", "strongest_links")])
def test_more_blocks_shuffle_no_more(spark, monkeypatch, tmp_path, key, step):
    """More blocks of fewer nodes give the same rows and do not copy them more often."""
    from __spark_entry__ import queries

    x = np.random.default_rng(8).normal(size=(300, 64)).round(2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    whole, sizes, rows = getattr(network, step), [], []
    for block in (300, 25):
        monkeypatch.setattr(network, step, lambda *a, block=block, **k: whole(*a[:3], run=1, block=block))
        before = shuffle_bytes(spark)
        frame = queries()[key](spark, str(tmp_path))
        rows.append(sorted(tuple(r) for r in frame.collect()))
        sizes.append(sum(n for name, n in shuffle_bytes(spark).items() if name not in before))
    assert rows[0] == rows[1] and len(rows[0]) == (2242 if key == "n3" else 1)
    assert sizes[1] < 1.6 * sizes[0]


def test_links_of_a_tile_come_in_order(spark, copied):
    """Equal values follow each other, so a table of links takes less room."""
    wanted = spark.createDataFrame([(105, 400), (106, 0)], "window_m int, wanted long")
    r = [row.r for row in network.strongest_links(cut(copied), 6, wanted).collect()]
    assert len(r) == 400 and r == sorted(r)
