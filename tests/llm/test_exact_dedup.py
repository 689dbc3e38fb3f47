"""Exact duplicates against plain grouping, the tries against a dictionary."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tropicast.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, lang string, first string, kind string, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "f", "k", "r") for i, t in rows], SCHEMA)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for body, members in groups.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        for place, (_, none, i) in enumerate(members):
            out.append((None if none else i, keep, len(members), place == 0, hashlib.sha256(body.encode()).hexdigest()))
    return Counter(out)


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    long = " ".join(f"w{int(k)}" for k in rng.integers(0, 999, 30000))
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "one"), (5, "o n e"), (6, "one "), (7, "on"), (8, "o"), (9, long), (10, long + "\n"), (11, long + "x"),
            (None, "one"), (None, "alone"), (12, "Ünï çödé 日本 🎉"), (13, "Ünïçödé日本🎉"), (14, "a\x1cb"), (15, "a b"), (15, "a b"), (15, "a b"), (16, "a b"), (17, "\x00"), (18, "\x00\x00")]
    for i in range(100, 400):
        text = " ".join(f"t{int(k)}" for k in rng.integers(0, 3, int(rng.integers(1, 6))))
        rows.append((i, text + " " * int(rng.integers(0, 3))))
    return rows + [(1000 + i, "hot text " * 40) for i in range(300)]


def test_against_grouping(spark, odd):
    assert found(exact_dedup.op12_exact_dedup(table(spark, odd).repartition(7))) == brute(odd)


def test_spills_and_hot_texts(spark, odd, monkeypatch):
    """Tries of a few texts, so that subtrees leave in every pass, and salted merging of what many tasks share."""
    docs = table(spark, odd).repartition(12)
    got = exact_dedup.owners(docs, memory=6000, hot=2)
    rows = got.collect()
    assert len(rows) == len(odd) == len({r["row"] for r in rows})
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["row"] == r["keep_row"], r["sha"]) for r in rows) == brute(odd)


def test_empty_and_all_alike(spark):
    assert exact_dedup.op12_exact_dedup(table(spark, [])).count() == 0
    alike = [(i % 5, "x y") for i in range(40)]
    assert found(exact_dedup.op12_exact_dedup(table(spark, alike))) == brute(alike)


def test_sql(spark, odd):
    rows = [(i, t) for i, t in odd if t is None or "\x00" not in t]
    con = duckdb.connect()
    con.register("documents", table(spark, rows).toArrow())
    got = con.sql(exact_dedup.ORACLE)
    names = got.columns
    assert Counter(tuple(dict(zip(names, r, strict=True))[n] for n in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got.fetchall()) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=60), st.integers(0, 59))
def test_trie(texts, at):
    """Terminals are the distinct texts; what a spill cuts off is gone and the rest stays."""
    trie = exact_dedup.Trie()
    for i, text in enumerate(texts):
        node = trie.terminal(text)
        if node.owner is None:
            node.owner, node.first, node.size = (i,), i, 0
        node.size += 1
    held = dict(trie.terminals(trie.root))
    assert {t: n.size for t, n in held.items()} == Counter(texts)
    assert trie.bytes == trie._weight(trie.root) - exact_dedup.NODE_BYTES
    gone = [t for t, _ in trie.spill()]
    rest = dict(trie.terminals(trie.root))
    assert set(gone) | set(rest) == set(texts) and not set(gone) & set(rest)
    assert len(set(texts)) < 2 or gone and rest
    for text in gone:
        assert trie.terminal(text) is None
    assert trie.bytes == trie._weight(trie.root) - exact_dedup.NODE_BYTES
    trie.forget()
    for text in gone:
        assert trie.terminal(text).owner is None
