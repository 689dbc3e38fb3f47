"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds reference text of the training split. A text is parsed
from left to right into the longest pieces that the automaton knows; a language in which few
pieces, each worth the logarithm of the reference's length, cover the text is a likely one. The language with the
fewest bits wins, ties going to the smaller name.

Every letter of the references is a symbol of its own, whatever the script; a letter that no reference
holds is a piece of its own in all languages. The automata keep the ``DENSE`` most frequent symbols as columns of a
table and the edges of all others in sorted arrays, so their size follows the reference and not the alphabet.

The reference is a bounded sample of whole texts: of each language the training documents with the lowest hash
of their id, texts beyond ``LONG`` characters last, at most ``DOCUMENTS`` of them and as many as fit into
``CHARACTERS`` characters (of one text at least: if the first is longer, its words up to there). Texts to be identified are parsed
whole, in blocks of ``BLOCK`` symbols that advance together, so a block costs each language
at most one piece more.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; rows with a NULL lang
teach nothing; a NULL doc_id is in the training split; without any language all texts are ``und``; an empty table gives no
rows. Columns other than id, text and lang are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remainder

FOLDS, HELD_OUT = 4, 2
DOCUMENTS = 64
CHARACTERS = 40_000
LONG = 4_000
BLOCK = 512
DENSE = 64  # symbols with columns of their own
CHUNK_BLOCKS = 8192


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def alphabet(references: dict[str, str]) -> np.ndarray:
    """Symbol of each code point: 0 separates words, 1 is a letter of no reference, then the references' letters by frequency."""
    letters = letter_table()
    lookup = letters.astype(np.int32)
    codes, tally = np.unique(np.concatenate([points(t) for t in references.values()] or [points("")]), return_counts=True)
    seen = letters[codes]
    codes, tally = codes[seen], tally[seen]
    lookup[codes[np.argsort(-tally, kind="stable")]] = np.arange(2, 2 + len(codes), dtype=np.int32)
    return lookup


def symbols(text: str, lookup: np.ndarray) -> np.ndarray:
    """Symbols of a text; a run of anything but letters is one separator."""
    out = lookup[points(text)]
    if not len(out):
        return out
    keep = (out != 0) | np.concatenate([[True], out[:-1] != 0])
    return out[keep]


class Automaton(NamedTuple):
    """Transitions of a suffix automaton; state 0 is the start."""

    dense: np.ndarray  # (state, symbol below DENSE) to state, -1 where there is none
    keys: np.ndarray  # sorted state * size + symbol of the other edges
    ends: np.ndarray  # where these lead
    root: np.ndarray  # symbol to state from the start, 0 where there is none

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        rare = symbol >= DENSE
        to = self.dense.ravel()[state * DENSE + np.where(rare, 0, symbol)]
        spots = np.flatnonzero(rare)
        if len(spots):
            key = state[spots].astype(np.int64) * len(self.root) + symbol[spots]
            at = np.searchsorted(self.keys, key)
            found = self.keys.take(at, mode="clip") == key if len(self.keys) else np.zeros(len(key), bool)
            to[spots] = -1
            to[spots[found]] = self.ends[at[found]]
        return to


def suffix_automaton(text: np.ndarray, size: int) -> Automaton:
    """The suffix automaton of a text of symbols below ``size``."""
    link, length = [-1], [0]
    edges: list[dict[int, int]] = [{}]
    last = 0
    for symbol in text.tolist():
        state = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in edges[p]:
            edges[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = edges[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(symbol) == q:
                    edges[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    dense = np.full((len(edges), DENSE), -1, np.int32)
    rest: list[tuple[int, int]] = []
    for state, out in enumerate(edges):
        for symbol, to in out.items():
            if symbol < DENSE:
                dense[state, symbol] = to
            else:
                rest.append((state * size + symbol, to))
    rest.sort()
    root = np.zeros(size, np.int32)
    for symbol, to in edges[0].items():
        root[symbol] = to
    return Automaton(dense, np.array([k for k, _ in rest], np.int64), np.array([to for _, to in rest], np.int32), root)


def phrases(blocks: np.ndarray, sizes: np.ndarray, go: Automaton) -> np.ndarray:
    """Pieces of each row of ``blocks`` (its first ``sizes`` symbols); rows advance together, longest first."""
    state = np.zeros(len(blocks), np.int32)
    out = (sizes > 0).astype(np.int64)
    live = np.searchsorted(-sizes, -np.arange(blocks.shape[1]), side="left")  # rows with more than t symbols
    for t in range(blocks.shape[1]):
        n = int(live[t])
        if not n:
            break
        c = blocks[:n, t]
        to = go.follow(state[:n], c)
        broken = to < 0
        # a piece ends before this symbol, unless it is still empty
        out[:n] += broken & (state[:n] > 0)
        state[:n] = np.where(broken, go.root[c], to)
        # a symbol the reference lacks is a piece of its own
        out[:n] += broken & (state[:n] == 0)
    # behind such a symbol at the end no piece follows
    return out - ((sizes > 0) & (state == 0))


class Identifier:
    def __init__(self, references: dict[str, str]):
        self.names = sorted(references)
        self.lookup = alphabet(references)
        coded = [symbols(references[n], self.lookup) for n in self.names]
        size = int(self.lookup.max()) + 1
        self.tables = [suffix_automaton(c, size) for c in coded]
        self.bits = np.array([np.log2(max(2, len(c))) for c in coded])

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits of each text in each language."""
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
        total = np.zeros((len(texts), len(self.names)))
        pieces = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
        for at in range(0, len(pieces), CHUNK_BLOCKS):
            part = pieces[at:at + CHUNK_BLOCKS]
            sizes = np.array([len(x) for x in part])
            order = np.argsort(-sizes, kind="stable")
            matrix = np.zeros((len(part), BLOCK), np.int32)
            for row, i in enumerate(order.tolist()):
                matrix[row, :sizes[i]] = part[i]
            matrix = np.asfortranarray(matrix)
            for k, go in enumerate(self.tables):
                np.add.at(total[:, k], owner[at:at + CHUNK_BLOCKS][order], phrases(matrix, sizes[order], go))
        return total * self.bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
        coded = [symbols(t, self.lookup) if ok else np.zeros(0, np.int32) for t, ok in zip(texts, letters, strict=True)]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.costs(coded)
        best = cost.argmin(1)
        rest = np.exp2(-np.minimum(cost - cost.min(1, keepdims=True), 60.0))
        sure = 1 / rest.sum(1)
        return ([self.names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
                [float(s) if ok else 0.0 for s, ok in zip(sure, letters, strict=True)])


_made: dict[int, Identifier] = {}


def identifier(references: dict[str, str]) -> Identifier:
    """The worker's automata; they are built once, not for each task."""
    key = hash(tuple(sorted(references.items())))
    if key not in _made:
        _made.clear()
        _made[key] = Identifier(references)
    return _made[key]


def learn(docs: DataFrame) -> dict[str, str]:
    """Reference text of each language: a bounded sample of the rows of (doc_id, text, lang)."""
    order = Window.partitionBy("lang").orderBy(F.length("text") > LONG, F.xxhash64(F.lit("reference"), "doc_id"), "doc_id", "text")
    rows = docs.where("lang IS NOT NULL AND length(text) > 0").select("lang", "doc_id", "text")
    # the group limit leaves few rows of each language in every task
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DOCUMENTS)
    so_far = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("n"))
    # of a single longer text the words that end within the bound; without such an end, all characters up to it
    head = F.left("text", F.lit(CHARACTERS))
    words = F.regexp_replace(head, r"\S+$", "")
    bounded = F.when(F.length("text") <= CHARACTERS, F.col("text")).when(F.trim(words) != "", words).otherwise(head)
    chosen = (first.withColumn("so_far", so_far).where((F.col("so_far") <= CHARACTERS) | (F.col("n") == 1))
              .withColumn("text", bounded).collect())
    out: dict[str, str] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["n"])):
        out[row["lang"]] = out.get(row["lang"], "") + " " + row["text"]
    return out


def identify(docs: DataFrame, references: dict[str, str]) -> DataFrame:
    """Add lang_pred and score to (doc_id, text)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, sure = identifier(references).predict([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.array(sure, float)})

    found = F.pandas_udf(run, "lang_pred string, score double")("text")
    return docs.withColumn("_f", found).select(*docs.columns, "_f.lang_pred", "_f.score")


def op10_language(docs: DataFrame) -> DataFrame:
    """Language of every document."""
    held = F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    references = learn(rows.where("NOT held_out"))
    return identify(rows.select("doc_id", "held_out", "text"), references).drop("text")
