"""Near copies in a large group of texts just below the threshold, and the bounds that rule pairs out."""

import numpy as np
import pytest
from tropicast.llm import near_copies

SCHEMA = "doc_id bigint, text string, lang string, node string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "n", "k") for i, t in rows], SCHEMA)


def likeness(a, b):
    return len(a & b) / max(len(a | b), 1)


def crowd(n, seed):
    """Texts that share most words, likeness about 0.6 to 0.9, few of the pairs at 0.8 or more."""
    rng = np.random.default_rng(seed)
    base = [f"w{int(i)}" for i in rng.integers(0, 500, 120)]
    texts = []
    for _ in range(n):
        words = list(base)
        for i in rng.choice(120, int(rng.integers(2, 6)), replace=False):
            words[i] = f"v{int(rng.integers(0, 40))}"
        texts.append(" ".join(words))
    return texts


def test_crowd_against_all_pairs(spark, monkeypatch):
    texts = crowd(260, 1) + crowd(90, 2)
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    close = 0
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
                close += 1
    want = sorted(i for i in range(len(texts)) if find(i) == i)
    assert 5 < len(want) < len(texts) - 5 and 0 < close < 0.3 * len(texts) ** 2 / 2
    compared = []
    verified = near_copies.verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "verified", counted)
    kept = near_copies.keep_first(table(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert sum(compared) < 0.1 * len(texts) ** 2


def test_parities_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(0, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)]))
        differing = sum(int(x ^ y).bit_count() for x, y in zip(near_copies._parities(a).view(np.uint64), near_copies._parities(b).view(np.uint64), strict=True))
        assert differing <= len(set(a.tolist()) ^ set(b.tolist()))


@pytest.mark.parametrize("size", [1, 4, 9, 10, 60])
def test_first_shingles_suffice(spark, size):
    """Any two sets of likeness 0.8 or more share one of their first shingles."""
    rng = np.random.default_rng(size)
    sets = [frozenset(rng.choice(size + size // 4 + 1, size, replace=False).tolist()) for _ in range(30)]
    nodes = spark.createDataFrame([(i, [int(v) for v in s]) for i, s in enumerate(sets)], "node long, shingles array<long>")
    places = {}
    for r in near_copies.rare_places(nodes.select("node"), nodes).collect():
        places.setdefault(r["node"], set()).add(r["s"])
    for i in range(30):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                assert places[i] & places[j]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (None, "one two"), (None, None), (6, "one two three four five six"),
            (6, "one two three four five six"), (7, "x" * 200_000)]
    kept = near_copies.keep_first(table(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "7"]
    assert near_copies.keep_first(table(spark, [])).count() == 0


def test_python_gets_small_batches(spark, monkeypatch):
    """Workers keep the memory of their largest batch, so whole texts come at most 1000 at a time."""
    from collections.abc import Iterator

    import pandas as pd

    from tropicast.llm import near_copies

    def watched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            if len(batch) > 1000:
                raise ValueError("a large batch")
            yield from prints(iter([batch]))

    prints, key = near_copies._prints, "spark.sql.execution.arrow.maxRecordsPerBatch"
    watched.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    monkeypatch.setattr(near_copies, "_prints", watched)
    before = spark.conf.get(key)
    docs = spark.range(1500).coalesce(1).selectExpr("id AS doc_id", "concat('one two three four ', id) AS text")
    assert near_copies.keep_first(docs).count() == 1500
    assert spark.conf.get(key) == before


def test_only_texts_that_meet_are_shuffled(spark, monkeypatch, tmp_path):
    """Whole texts are shuffled for their sets only where a filter of the proposed rows lets them through."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"{w}x{i}" for w in words)) for i in range(300)]
    rows += [(i + 300, rows[i][1].rsplit(" ", 1)[0]) for i in range(20)]
    table(spark, rows).write.parquet(f"{tmp_path}/docs")
    settings = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")}
    plans, cut = [], near_copies.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(near_copies, "cut", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_copies.keep_first(spark.read.parquet(f"{tmp_path}/docs"))
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", settings["spark.sql.autoBroadcastJoinThreshold"])
    assert ["might_contain" in p for p in plans if "_sets(" in p] == [True]
    assert {k: spark.conf.get(k) for k in settings} == settings
