"""The filter audit against a walk through every document, order and coalition."""

import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tropicast.llm import filter_audit

DOCS = "doc_id bigint, text string, lang string, source string, quality int, mask string, part string"
LABELS = "doc_id bigint, quality int, toxic int, part string"


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and i > least[t]:
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in rows}:
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                shares[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, order, step), v in out.items():
            if p == part:
                v[6] = shares[v[6]]
    return out


def spread(rows):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}


def prose(rng, n, kinds):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, kinds, n))


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(5)
    docs = [(None, None, None), (None, "a", "en"), (1, None, "en"), (2, "", None), (3, " \t\n", "de"), (4, "x" * 5, ""), (5, prose(rng, 250, 500), "en"),
            (5, prose(rng, 250, 500), "en"), (6, prose(rng, 9000, 200), "fr"), (7, "ABC def", "en"), (8, "ABC def", None), (7, "ABC def", "de")]
    for i in range(20, 120):
        text = prose(rng, int(rng.integers(150, 300)), int(rng.integers(40, 900)))
        text += " #" * int(rng.random() < 0.3) + " UPPER" * int(rng.integers(0, 30) * (rng.random() < 0.4))
        docs.append((i, text, ("en", "de", None)[i % 3]))
        docs += [(i + 1000 * int(k), text, "en") for k in range(1, int(rng.integers(1, 4)))]
    docs += [(5000 + i, "same", ("en", "de")[i % 2]) for i in range(60)]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 90, 2)] + [(7, None, 1), (7, 1, 0), (None, 1, 1), (8, 0, None), (5050, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame([(i, t, g, "s", 9, "m", "p") for i, t, g in docs], DOCS),
            spark.createDataFrame([(i, q, t, "p") for i, q, t in labels], LABELS))


def test_against_a_walk(spark, case):
    got = filter_audit.op13_filter_audit(*frames(spark, *case)).collect()
    assert spread(r.asDict() for r in got) == brute(*case)
    assert len(got) == len({g or "" for _, _, g in case[0]}) * 600


def test_sql(spark, case):
    docs, labels = (f.toArrow() for f in frames(spark, *case))
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("labels", labels)
    got = con.sql(filter_audit.ORACLE)
    rows = [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]
    assert spread(rows) == brute(*case)


def test_empty(spark, case):
    docs, labels = frames(spark, *case)
    assert filter_audit.op13_filter_audit(docs.where("false"), labels).count() == 0
    got = spread(r.asDict() for r in filter_audit.op13_filter_audit(docs, labels.where("false")).collect())
    assert got == brute(case[0], [])


def test_potentials(spark):
    """Weights of a coalition game: the potential of all less that of four is the mean over the orders."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 32)
    counts[0] = 7
    cells = spark.createDataFrame([("p", int(m), 0, 0, int(n)) for m, n in enumerate(counts)], "part string, mask int, good int, toxic int, n long")
    row = filter_audit.removal_games(cells).withColumn("p", filter_audit.potentials(filter_audit.F.col("all"))).first()
    values = [sum(int(n) for m, n in enumerate(counts) if m & s) for s in range(32)]
    assert row["all"] == values and row["total"] == counts.sum()
    for i in range(5):
        want = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[:order.index(i)])
            want += values[before | 1 << i] - values[before]
        assert row["p"][31] - row["p"][31 ^ 1 << i] == want
