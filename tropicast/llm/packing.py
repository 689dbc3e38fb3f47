"""Best-fit packing by a configuration linear program over the histogram of piece lengths.

Documents become token ids; those longer than a sequence are cut, the first piece being the
shorter one. Only the histogram of piece lengths (at most ``capacity`` counts) reaches
the driver. There the covering program over all fillings of a sequence is solved by
multiplicative weights: lengths that are not yet covered gain weight, and a knapsack
dynamic program over the pieces that are there finds the fillings of largest weight. The average of the
fillings is the fractional solution. It is rounded, and the program solved again for what is left, until
a few sequences remain, which best fit packs, largest first, still on counts.

Pieces of a length are numbered in parallel (salted groups with offsets) and mapped to the places
that the plan has for that length. The plan has as many rows as fillings, whatever the
number of documents.

Defined results: a NULL or empty text is the single end id; rows that repeat a document are
packed as often as they occur; an empty table gives no rows. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

CAPACITY = 1024
END = 2
CACHE = 800_000
SALT_ROWS = 2_000
ROUNDS = 12
LAST = 16

# White space other than single spaces and line feeds between words.
_UNEVEN = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]|[\x1c-\x1f]")
# A word with the space or line feed before it, a run of white space without its last character, or that character
_UNIT = re.compile(r"[ \n]?\S+|\s+(?!\S)|\s")
_CONTROL = re.compile("[\x1c-\x1f]")


class _Encoder(dict):
    """Token ids of whole texts as little-endian 32-bit bytes.

    The pattern that splits a text before byte pairs are merged always breaks before a single
    space or line feed between words, so words can be encoded one by one, and those seen before
    are looked up. Keys are words without the space before them. The vocabulary is that
    of the tokenizer file, whose ids are the order of its merges; texts that spell
    a special token go through the file's own tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(special)
        # bytes stand in the file as printable characters: those that are printable, then the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        if set(byte) != set(ByteLevel.alphabet()):
            raise ValueError(f"{path} is not a byte-level vocabulary")
        vocabulary = self.tokenizer.get_vocab()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.merge = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _encoded(self, text: str) -> bytes:
        return array("I", self.merge.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = self._encoded(word if word[:1] == "\n" else " " + word)
        return ids

    def __call__(self, text: str) -> bytes:
        if any(mark in text for mark in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not _UNEVEN.search(text):
            words = text.replace("\n", " \n").split(" ")
            return self._encoded(words[0]) + b"".join(map(self.__getitem__, words[1:]))
        if _CONTROL.search(text):
            return self._encoded(text)
        known, out = self.__getitem__, []
        for unit in _UNIT.findall(text):
            # only a word behind a space or line feed has a key
            out.append(known(unit[1:]) if unit[0] == " " and unit[1:2].strip() else
                       known(unit) if unit[0] == "\n" and unit[1:2].strip() else self._encoded(unit))
        return b"".join(out)


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """The worker's encoder of a file; it keeps what it has seen from task to task."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, tail = encoder(tokenizer_path), array("I", [end]).tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], map(encode, batch["text"]), strict=True):
                ids += tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                begins = [0, *range(first, n, capacity)]
                for piece, (a, b) in enumerate(zip(begins, [*begins[1:], n], strict=True)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


# array("I") writes ids in the machine's own order
assert array("I", [1]).tobytes() == b"\x01\0\0\0"


def _knapsack(value: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Most valuable fillings of every capacity from lengths that are there ``counts`` times.

    Lengths enter longest first in bundles of 1, 2, 4, ... copies. last[i, c] is the last of the first
    i bundles that the best filling of c uses, 0 for none.
    """
    bundles = []
    for size in np.flatnonzero(value > 0)[::-1].tolist():
        left, k = min(int(counts[size]), capacity // size), 1
        while left:
            k = min(k, left)
            bundles.append((size, k))
            left -= k
            k *= 2
    best = np.zeros(capacity + 1)
    last = np.zeros((len(bundles) + 1, capacity + 1), np.int32)
    for i, (size, k) in enumerate(bundles, 1):
        with_it = best[:capacity + 1 - k * size] + k * value[size]
        better = with_it > best[k * size:] * (1 + 1e-12)
        last[i] = last[i - 1]
        last[i, k * size:][better] = i
        best[k * size:][better] = with_it[better]
    return bundles, last


def _held(filling: dict[int, int]) -> int:
    return sum(size * n for size, n in filling.items())


def _filling(size: int, bundles: list[tuple[int, int]], last: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable filling that contains ``size``."""
    counts, c, i = {size: 1}, capacity - size, len(bundles)
    while i := last.item(i, c):
        at, k = bundles[i - 1]
        counts[at] = counts.get(at, 0) + k
        c -= k * at
        i -= 1
    return counts


def fractional(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = 0.1,
               slack: float = 0.02, pull: float = 3.0) -> list[tuple[dict[int, int], float]]:
    """Fillings and how often each is used to cover the lengths once on average: multiplicative weights.

    A length's price is its share of the sequence, lowered exponentially as it is covered. Long pieces
    are worth up to 1 + ``pull`` times their share: of the many full fillings the program then uses those of
    few long pieces, and short pieces, which fit anywhere, remain for the end. One dynamic program prices all
    fillings of a round: for each length the best filling with it, used if no more than ``slack`` of
    the sequence stays empty and none of its lengths has had its step.
    """
    demand = histogram.astype(float)
    sizes = np.flatnonzero(histogram)[::-1]  # the long ones choose first
    used: dict[tuple, float] = {}
    covered = np.zeros(capacity + 1)
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        lowered = np.exp(slack * (covered[sizes].min() - covered[sizes]) / step)
        value[sizes] = sizes / capacity * (1 + pull * sizes / capacity) * lowered
        bundles, last = _knapsack(value, histogram, capacity)
        gained = np.zeros(capacity + 1)
        for size in sizes[np.argsort(covered[sizes], kind="stable")].tolist():
            if gained[size] >= step:
                continue
            filling = _filling(size, bundles, last, capacity)
            if _held(filling) < (1 - slack) * capacity:
                continue
            if any(gained[s] >= step or n > histogram[s] for s, n in filling.items()):
                continue
            amount = step * min(demand[s] / n for s, n in filling.items())
            for s, n in filling.items():
                gained[s] += amount * n / demand[s]
            key = tuple(sorted(filling.items()))
            used[key] = used.get(key, 0.0) + amount
        covered += gained
        if not gained.any():
            break
    return [(dict(f), amount / covered[sizes].mean()) for f, amount in used.items()]


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on counts: fillings and their numbers."""
    open_bins: dict[int, dict[tuple, int]] = {}
    for size in range(capacity, 0, -1):
        left = int(histogram[size])
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                k = capacity // size
                bins, rest = divmod(left, k)
                for count, per in ((bins, k), (1 if rest else 0, rest)):
                    if count:
                        at = open_bins.setdefault(capacity - per * size, {})
                        at[((size, per),)] = at.get(((size, per),), 0) + count
                break
            filling, count = next(iter(open_bins[room].items()))
            per = min(room // size, left)
            bins = min(count, left // per)
            left -= bins * per
            if bins == count:
                del open_bins[room][filling]
            else:
                open_bins[room][filling] = count - bins
            if not open_bins[room]:
                del open_bins[room]
            at = open_bins.setdefault(room - per * size, {})
            key = (*filling, (size, per))
            at[key] = at.get(key, 0) + bins
    out = []
    for group in open_bins.values():
        for filling, count in group.items():
            counts = np.zeros(capacity + 1, np.int64)
            for size, per in filling:
                counts[size] += per
            out.append((counts, count))
    return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Fillings with their numbers that hold every piece exactly once, the program's first."""
    out, left = rounded(histogram, capacity)
    return out + best_fit(left, capacity)


def rounded(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole fillings of the program, solved again for what they leave, and the histogram of the rest.

    Of each solution the whole parts are taken, then single fillings as long as their pieces are there:
    those of the longest piece first, then of fewest pieces, then of largest remainder. Fillings may be
    short of a sequence by ``waste``, which grows from 0 only when nothing of a solution could be
    taken. The rest is at most ``LAST`` sequences, or what no solution covers.
    """
    left = histogram.astype(np.int64)
    lengths = np.arange(capacity + 1)
    out: list[tuple[np.ndarray, int]] = []
    waste = 0
    while lengths @ left > LAST * capacity and waste < capacity:
        solution = [(f, amount) for f, amount in fractional(left, capacity) if _held(f) >= capacity - waste]
        # the whole parts of all come before any remainder
        turns = [(f, int(amount)) for f, amount in solution]
        turns += [(f, 1) for f, _ in sorted(solution, key=lambda x: (-max(x[0]), sum(x[0].values()), int(x[1]) - x[1]))]
        before = left.sum()
        for filling, times in turns:
            times = min(times, *(int(left[s]) // n for s, n in filling.items()))
            if times:
                counts = np.zeros(capacity + 1, np.int64)
                counts[list(filling)] = list(filling.values())
                out.append((counts, times))
                left -= times * counts
        if left.sum() == before:
            waste = 2 * waste + 1
    return out, left


def _places(fillings: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which a run of places begins, their first sequence and their offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for counts, number in fillings:
        offset = 0
        for size in np.flatnonzero(counts)[::-1].tolist():
            for _ in range(int(counts[size])):
                at = filled.get(size, 0)
                runs.setdefault(size, []).append((at, first, offset))
                filled[size] = at + number
                offset += size
        first += number
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, length, ...) rows that a table holds."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["n"]
    places = _places(plan(histogram, capacity))
    salts = max(1, int(histogram.max()) // SALT_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")
    offsets = cut(sizes.select("length", "_salt", before.alias("before")))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank).join(offsets, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("before")).cast("long"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            for size in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == size)
                begins, firsts, offsets = places[size]
                run = np.searchsorted(begins, ranks[rows], side="right") - 1
                sequence[rows] = firsts[run] + ranks[rows] - begins[run]
                offset[rows] = offsets[run]
            yield batch[names].assign(sequence_id=sequence, offset=offset).astype(kinds)

    names = pieces.columns
    kinds = {"doc_id": "Int64"} if "doc_id" in names else {}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "_rank").mapInPandas(place, schema)


def op3_packing(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut(cut_pieces(docs, path)))
