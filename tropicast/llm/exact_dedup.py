"""Exact duplicates by Patricia tries: equal normalised texts end in one terminal node, which holds their owner.

A text is normalised by deleting its ASCII white space. Every task enters the normalised bytes of its rows in a
compressed radix trie; a row then carries the number of its terminal node, and the node the
smallest identifier of its rows (most code points of the original text, then smallest doc_id) and their number. So
the copies within a task are one text before anything is shuffled. The terminals are dealt out by length and
content hash, and the full byte strings that meet are entered in tries again. The hashes only choose the task; equality is that of the
bytes.

Memory: a trie that outgrows ``MEMORY`` spills by subtree. The largest subtree below its first branch is cut
off and its terminals leave the task as rows. A text that comes later begins a terminal anew in the first pass; in a pass by length and hash it
follows its subtree out, and all rows of the subtree go through another pass with four times the tasks. A
subtree is cut only beside another that stays, so every pass settles some of the texts. A length and
hash with terminals from more than ``HOT`` tasks is merged in salted parts first.

Defined results: NULL counts as empty, and texts of white space only equal it; of rows alike in length and
doc_id (repeated rows) one is kept; a NULL doc_id comes after all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

DELETED = b" \t\n\x0b\x0c\r"
MEMORY = 48 << 20
NODE_BYTES = 400
TASK_BYTES = 24 << 20
HOT, SALTS = 256, 64
ROWS_OUT = 2000

# an owner is (-code points, doc_id is NULL, doc_id or 0, row): the smallest stays
LIGHT = [("row", pa.int64()), ("first", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string())]
TERMINAL = [("first", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("size", pa.int64()),
            ("own_chars", pa.int64()), ("own_id", pa.int64()), ("own_row", pa.int64())]
LINK = [("first", pa.int64()), ("head", pa.int64())]
DONE = [("first", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]


def _ddl(kind: str, *tables: list) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    seen = {n: names[t] for table in tables for n, t in table}
    return f"{kind} int, " + ", ".join(f"{n} {t}" for n, t in seen.items())


class Node:
    """An edge's bytes and what hangs below: children by first byte, and the owner of the text that ends here."""

    __slots__ = ("label", "children", "owner", "first", "size", "members", "gone")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.gone = label, None, None, False


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` share, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over bytes."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def terminal(self, text: bytes) -> Node | None:
        """The node where ``text`` ends, made if need be; None if its subtree has been cut off."""
        node, at, end = self.root, 0, len(text)
        while not node.gone:
            if at == end:
                return node
            child = node.children.get(text[at]) if node.children else None
            if child is None:
                return self._hang(node, text[at:])
            label = child.label
            if not text.startswith(label, at):
                shared = _common(label, text, at)
                child = self._split(node, child, shared)
                label = child.label
            node, at = child, at + len(label)
        return None

    def _hang(self, node: Node, label: bytes) -> Node:
        if node.children is None:
            node.children = {}
        child = node.children[label[0]] = Node(label)
        self.bytes += len(label) + NODE_BYTES
        return child

    def _split(self, node: Node, child: Node, shared: int) -> Node:
        """A new node in the edge to ``child``, after ``shared`` bytes."""
        middle = Node(child.label[:shared])
        node.children[middle.label[0]] = middle
        child.label = child.label[shared:]
        middle.children = {child.label[0]: child}
        self.bytes += NODE_BYTES
        return middle

    def terminals(self, node: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """(text, node) of all texts that end at or below ``node``, whose own text is ``prefix``."""
        stack = [(node, prefix)]
        while stack:
            node, text = stack.pop()
            if node.owner is not None:
                yield text, node
            if node.children:
                stack += [(c, text + c.label) for c in node.children.values()]

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            if node.children:
                stack += node.children.values()
        return total

    def spill(self) -> list[tuple[bytes, Node]]:
        """Cut off the largest subtree below the first branch; its texts. Empty where all is one branch."""
        node, prefix = self.root, b""
        while True:
            open_ = [c for c in (node.children or {}).values() if not c.gone]
            if len(open_) > 1 or node.owner is not None and open_:
                break
            if not open_:
                return []
            node, prefix = open_[0], prefix + open_[0].label
        largest = max(open_, key=self._weight)
        self.bytes -= self._weight(largest)
        out = list(self.terminals(largest, prefix + largest.label))
        # the edge stays, so that later texts find it cut off
        stub = node.children[largest.label[0]] = Node(largest.label)
        stub.gone = True
        self.bytes += len(stub.label) + NODE_BYTES
        return out

    def forget(self) -> None:
        """Make cut subtrees open to new texts."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            for key, child in list((node.children or {}).items()):
                if child.gone:
                    del node.children[key]
                    self.bytes -= len(child.label) + NODE_BYTES
                else:
                    stack.append(child)


def _batches(rows: Iterator[tuple[int, dict]], schema: str, tables: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, values) as record batches of all columns, NULL where a kind has no such column."""
    fields = {n: t for table in tables.values() for n, t in table}
    names = list(fields)

    def batch(found: list) -> pa.RecordBatch:
        columns = [pa.array([k for k, _ in found], pa.int32())]
        columns += [pa.array([v.get(n) for _, v in found], fields[n]) for n in names]
        return pa.RecordBatch.from_arrays(columns, ["kind", *names])

    found, weight = [], 0
    for row in rows:
        found.append(row)
        weight += len(row[1].get("body") or b"")
        if len(found) >= ROWS_OUT or weight >= 4 << 20:
            yield batch(found)
            found, weight = [], 0
    if found:
        yield batch(found)


def _terminal_row(text: bytes, node: Node) -> dict:
    chars, no_id, doc, row = node.owner
    digest = xxhash.xxh64_intdigest(text)
    return {"first": node.first, "length": len(text), "hash": digest - (digest >> 63 << 64), "body": text, "size": node.size,
            "own_chars": -chars, "own_id": None if no_id else doc, "own_row": row}


def _enter(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[tuple[int, dict]]:
    """First pass: a light row for each document (kind 0), a terminal row for each text of a trie (kind 1)."""
    trie, row = Trie(), (TaskContext.get().partitionId() << 40) - 1
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row += 1
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            body = raw.translate(None, DELETED)
            # continuation bytes are 10xxxxxx
            chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "surrogatepass"))
            node = trie.terminal(body)
            owner = (-chars, doc is None, doc or 0, row)
            if node.owner is None:
                node.owner, node.first, node.size = owner, row, 1
            else:
                node.owner, node.size = min(node.owner, owner), node.size + 1
            yield 0, {"row": row, "first": node.first, "doc_id": doc, "sha": hashlib.sha256(body).hexdigest()}
            while trie.bytes > memory:
                cut_off = trie.spill()
                trie.forget()
                yield from ((1, _terminal_row(*x)) for x in cut_off)
                if not cut_off:
                    break
    yield from ((1, _terminal_row(*x)) for x in trie.terminals(trie.root))


def _merge(batches: Iterator[pa.RecordBatch], memory: int, last: bool) -> Iterator[tuple[int, dict]]:
    """A pass over terminals: links to a head (kind 0), terminals that go on (kind 1), settled texts (kind 2).

    Where not ``last``, all terminals go on, merged.
    """
    trie = Trie()

    def settled(text: bytes, node: Node) -> Iterator[tuple[int, dict]]:
        if last:
            _, no_id, doc, row = node.owner
            for first in node.members:
                yield 2, {"first": first, "keep_row": row, "keep_id": None if no_id else doc, "group_size": node.size}
        else:
            yield from going(text, node)

    def going(text: bytes, node: Node) -> Iterator[tuple[int, dict]]:
        for first in node.members:
            yield 0, {"first": first, "head": node.first}
        yield 1, _terminal_row(text, node)

    for batch in batches:
        for r in batch.to_pylist():
            owner = (-r["own_chars"], r["own_id"] is None, r["own_id"] or 0, r["own_row"])
            node = trie.terminal(r["body"])
            if node is None:  # its subtree has left
                yield 0, {"first": r["first"], "head": r["first"]}
                yield 1, r
            elif node.owner is None:
                node.owner, node.first, node.size, node.members = owner, r["first"], r["size"], [r["first"]]
            else:
                node.owner, node.size = min(node.owner, owner), node.size + r["size"]
                node.members.append(r["first"])
                trie.bytes += 40
            while trie.bytes > memory:
                cut_off = trie.spill()
                for text, gone in cut_off:
                    trie.bytes -= 40 * (len(gone.members) - 1)
                    yield from going(text, gone)
                if not cut_off:
                    break
    for text, node in trie.terminals(trie.root):
        yield from settled(text, node)


def _pass(df: DataFrame, rows, columns: list, tables: dict[int, list]) -> DataFrame:
    schema = _ddl("kind", *tables.values())
    return cut(df.select(*columns).mapInArrow(lambda batches: _batches(rows(batches), schema, tables), schema))


def _of(table: DataFrame, kind: int, fields: list) -> DataFrame:
    return table.where(F.col("kind") == kind).select(*[n for n, _ in fields])


def owners(docs: DataFrame, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """(row, doc_id, sha, keep_row, keep_id, group_size) of every row of ``docs`` (doc_id, text); ``row`` is unique."""
    names = [n for n, _ in TERMINAL]
    entered = _pass(docs, lambda b: _enter(b, memory), ["doc_id", "text"], {0: LIGHT, 1: TERMINAL})
    open_ = _of(entered, 1, TERMINAL)
    cells = open_.groupBy("length", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    crowded = cut(cells.where(F.col("n") > hot).select("length", "hash", F.lit(True).alias("_hot")))
    volume = open_.agg(F.sum(F.col("length") + NODE_BYTES)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / TASK_BYTES))
    kinds = {0: LINK, 1: TERMINAL, 2: DONE}
    links, done = [], None
    if not crowded.isEmpty():
        marked = open_.join(crowded, ["length", "hash"], "left")
        salt = F.pmod(F.xxhash64("first"), F.lit(SALTS))
        salted = marked.where("_hot").repartition(parts, "length", "hash", salt)
        merged = _pass(salted, lambda b: _merge(b, memory, False), names, kinds)
        links.append(_of(merged, 0, LINK))
        open_ = marked.where("_hot is null").select(*names).unionByName(_of(merged, 1, TERMINAL))
    while True:
        table = _pass(open_.repartition(parts, "length", "hash"), lambda b: _merge(b, memory, True), names, kinds)
        settled = _of(table, 2, DONE)
        done = settled if done is None else done.unionByName(settled)
        open_, parts = _of(table, 1, TERMINAL), parts * 4
        if open_.isEmpty():
            break
        links.append(_of(table, 0, LINK))
    # a link leads from a terminal to the one that went on for it
    for step in reversed(links):
        found = done.withColumnRenamed("first", "head")
        later = step.join(found, "head").select(*[n for n, _ in DONE])
        done = done.join(step.select("first"), "first", "left_anti").unionByName(later)
    light = _of(entered, 0, LIGHT)
    return light.join(done, "first").select("row", "doc_id", "sha", "keep_row", "keep_id", "group_size")


def op12_exact_dedup(docs: DataFrame) -> DataFrame:
    """Owner and size of the group of equal normalised texts of every document."""
    found = owners(docs)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                        F.col("sha").alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
o AS (SELECT doc_id, body, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
    FROM t WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM o
"""
