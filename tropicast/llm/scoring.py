"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Token counts of the whole training split are taken first. The most frequent words are classes of their own, all
others fall into classes by their last bytes. The model predicts the class of the next word from
the two before it: the context vectors, each turned by the matrix of its position, add up to the
predicted vector, and its products with the class vectors give scores. It is
trained in numpy against noise classes, first on a bounded sample of documents in one task, then in
every task on all training texts; the tasks' parameters are averaged by their tokens.

All contexts are then scored by batched matrix products, which gives the exact normaliser of
each. A word's probability is that of its class times its share of the class by counts. Each class keeps
a share for words never seen (as many as were seen once), and their sum over the classes is
the probability of an unknown word. So the probabilities of all known words and the unknown one
add up to 1 in every context.

Counts of the ``SHORTLIST`` (at most) most frequent words travel with the tasks; the rest of a document's
words, each once with its sums, meet the vocabulary in a join.

Defined results: a NULL text is empty and has only its end; a NULL doc_id is not in the training split and counts
as held out; repeated rows are counted and scored each; without training tokens every word is unknown; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import remainder

FOLDS = 10
SHORTLIST = 100_000
WORDS = 190
BINS = 64
CLASSES = 2 + WORDS + BINS  # 0: before the text, 1: end, words, bins by ending
WIDTH = 32
NOISE = 64
BATCH = 4096
SAMPLE_DOCS = 2_000
SMOOTH = 0.1
END = b""
FLUSH = 200_000
SLICE = 500
PARTS = ("vectors", "first", "second", "output", "bias")


def tokens(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered; the end is not included."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of few texts, as their words take much more memory than they do."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at:at + SLICE]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, c) over all texts, their ends included; a task adds up what it has read first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                tally.update(tokens(text))
                tally[END] += 1
                if len(tally) > FLUSH:
                    yield pd.DataFrame({"token": list(tally), "n": list(tally.values())})
                    tally.clear()
        if tally:
            yield pd.DataFrame({"token": list(tally), "n": list(tally.values())})

    return docs.select("text").mapInPandas(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("c"))


def _bin(token: Column) -> Column:
    return (F.crc32(F.substring(token, -3, 3)) % BINS + (2 + WORDS)).cast("int")


def bin_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS + 2 + WORDS


class Vocabulary:
    """What of the counts a task needs: the shortlist and the sums over everything."""

    def __init__(self, counts: DataFrame):
        row = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n, self.v = int(row["n"] or 0), int(row["v"])
        # the lowest level of counts above which at most SHORTLIST tokens lie; there are at most a few thousand levels
        level = F.floor(F.log2("c") * 64)
        levels = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        held, lowest = 0, None
        for l, n in levels:
            held += n
            if held > SHORTLIST:
                break
            lowest = l
        top = [] if lowest is None else counts.where(level >= lowest).collect()
        top.sort(key=lambda r: (-r["c"], bytes(r["token"])))
        self.words = {bytes(r["token"]): i for i, r in enumerate(top)}
        self.counts = np.array([r["c"] for r in top], float)
        own = [bytes(r["token"]) for r in top if bytes(r["token"]) != END][:WORDS]
        own_class = {w: i + 2 for i, w in enumerate(own)} | {END: 1}
        self.classes = np.array([own_class.get(w) or bin_of(w) for w in self.words], np.int32)
        mass = np.full(CLASSES, SMOOTH)
        seen, once = np.zeros(CLASSES), np.zeros(CLASSES)
        rest = counts.where(~F.col("token").isin([bytearray(w) for w in own_class]))
        bins = rest.groupBy(_bin(F.col("token")).alias("k")).agg(
            F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()
        for r in bins:
            seen[r["k"]], once[r["k"]] = r["c"], r["once"]
            mass[r["k"]] = r["c"] + SMOOTH * r["v"]
        for w, k in own_class.items():
            if w in self.words:
                seen[k] = self.counts[self.words[w]]
                mass[k] = seen[k] + SMOOTH
        self.mass = mass
        # share of a class kept for unknown words; a class of one word keeps nothing
        self.unseen = np.where(np.arange(CLASSES) >= 2 + WORDS, (once + SMOOTH) / (np.maximum(seen, once) + 1.0), 0.0)
        self.unseen[0] = 1.0
        self.noise = (seen + 1.0) / (seen + 1.0).sum()

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def classes_of(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        out = self.classes[ids] if len(self.classes) else np.zeros(len(ids), np.int32)
        for i in np.flatnonzero(ids < 0).tolist():
            out[i] = bin_of(words[i])
        return out


def initial(vocabulary: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"vectors": rng.normal(0, 0.1, (CLASSES, WIDTH)), "first": np.eye(WIDTH) * 0.7, "second": np.eye(WIDTH) * 0.3,
         "output": rng.normal(0, 0.1, (CLASSES, WIDTH)), "bias": np.log(vocabulary.noise)[:, None]}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _summed(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    order = np.argsort(index, kind="stable")
    keys, begins = np.unique(index[order], return_index=True)
    out = np.zeros((CLASSES, rows.shape[1]), np.float32)
    out[keys] = np.add.reduceat(rows[order], begins, axis=0)
    return out


def nce_step(p: dict, squares: dict, before: np.ndarray, last: np.ndarray, target: np.ndarray, log_noise: np.ndarray,
             noise: np.ndarray, rate: float) -> None:
    """One step of noise-contrastive estimation: targets against noise classes that the batch shares."""
    n, k = len(target), len(noise)
    r1, r2 = p["vectors"][last], p["vectors"][before]
    predicted = r1 @ p["first"] + r2 @ p["second"]
    true = (predicted * p["output"][target]).sum(1) + p["bias"][target, 0]
    false = predicted @ p["output"][noise].T + p["bias"][noise, 0]
    shift = np.float32(np.log(k))
    pull = (1 / (1 + np.exp(-np.clip(true - shift - log_noise[target], -30, 30))) - 1)[:, None] / n
    push = 1 / (1 + np.exp(-np.clip(false - shift - log_noise[noise], -30, 30))) / n
    back = pull * p["output"][target] + push @ p["output"][noise]
    grads = {
        "output": _summed(pull * predicted, target) + _summed(push.T @ predicted, noise),
        "bias": _summed(pull, target) + _summed(push.sum(0)[:, None], noise),
        "vectors": _summed(back @ p["first"].T, last) + _summed(back @ p["second"].T, before),
        "first": r1.T @ back, "second": r2.T @ back,
    }
    for name, g in grads.items():
        squares[name] += g * g
        p[name] -= np.float32(rate) * g / np.sqrt(squares[name] + 1e-7)


def train_task(vocabulary: Vocabulary, start: dict, rate: float, epochs: int):
    """Function for mapInPandas: trains on all texts of the task, returns its parameters times its tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = {k: v.copy() for k, v in start.items()}
        squares = {k: np.zeros_like(v) for k, v in p.items()}
        rng, log_noise, seen = np.random.default_rng(11), np.log(vocabulary.noise).astype(np.float32), 0
        for batch in _slices(batches):
            classes = []
            for text in batch["text"]:
                words = tokens(text)
                classes += [np.zeros(2, np.int32), vocabulary.classes_of(words, vocabulary.ids(words)), np.ones(1, np.int32)]
            stream = np.concatenate(classes)
            at = np.flatnonzero(stream[2:] != 0) + 2
            seen += len(at)
            for _ in range(epochs):
                rng.shuffle(at)
                for i in range(0, len(at), BATCH):
                    j = at[i:i + BATCH]
                    noise = rng.choice(CLASSES, NOISE, p=vocabulary.noise)
                    nce_step(p, squares, stream[j - 2], stream[j - 1], stream[j], log_noise, noise, rate)
        if seen:
            for part, name in enumerate(PARTS):
                rows = p[name].astype(float) * seen
                wide = np.zeros((len(rows), WIDTH))
                wide[:, :rows.shape[1]] = rows
                yield pd.DataFrame({"part": part, "row": np.arange(len(rows)), "weight": float(seen)} | {
                    f"x{i}": wide[:, i] for i in range(WIDTH)})

    return run


def train_round(docs: DataFrame, vocabulary: Vocabulary, start: dict, rate: float, epochs: int = 1) -> dict:
    """Train in every task and average by tokens: one row for each class or matrix row comes back."""
    columns = [f"x{i}" for i in range(WIDTH)]
    schema = "part int, row bigint, weight double, " + ", ".join(f"{c} double" for c in columns)
    rows = docs.select("text").mapInPandas(train_task(vocabulary, start, rate, epochs), schema)
    means = rows.groupBy("part", "row").agg(*[(F.sum(c) / F.sum("weight")).alias(c) for c in columns]).toPandas()
    out = {k: v.copy() for k, v in start.items()}
    for part, name in enumerate(PARTS):
        mine = means[means["part"] == part].sort_values("row")
        if len(mine):
            out[name] = mine[columns].to_numpy(np.float32)[:, :start[name].shape[1]]
    return out


class Scorer:
    """Log-probabilities (base 10) of classes after two classes, and of an unknown word."""

    def __init__(self, p: dict, vocabulary: Vocabulary):
        first, second = p["vectors"] @ p["first"], p["vectors"] @ p["second"]
        self.by_last = first @ p["output"].T + p["bias"][:, 0]
        self.by_before = second @ p["output"].T
        self.by_last[:, 0] = -60.0  # no word has the class before the text
        self.unknown = np.zeros((CLASSES, CLASSES), np.float32)
        self.norm = np.zeros((CLASSES, CLASSES), np.float32)
        for before in range(CLASSES):
            scores = self.by_last + self.by_before[before]
            top = scores.max(1, keepdims=True)
            e = np.exp(scores - top)
            self.norm[before] = (top[:, 0] + np.log(e.sum(1))) / np.log(10)
            self.unknown[before] = np.log10(e @ vocabulary.unseen / e.sum(1))
        self.by_last, self.by_before = self.by_last / np.log(10), self.by_before / np.log(10)
        # of a known word beyond its class and its count
        self.share = np.log10(np.maximum(1 - vocabulary.unseen, 1e-30)) - np.log10(vocabulary.mass)

    def classes(self, before: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.by_last[last, target] + self.by_before[before, target] - self.norm[before, last]).astype(float)


SCORED = ("doc_id bigint, in_training boolean, n_tokens bigint, n_known bigint, logs double, score double, "
          "tail array<binary>, times array<int>, as_known array<double>, as_unknown array<double>")


def score_task(vocabulary: Vocabulary, scorer: Scorer):
    """Function for mapInPandas: scores what the shortlist knows and lists the other words of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log_counts = np.log10(vocabulary.counts + SMOOTH)
        for batch in _slices(batches):
            rows = []
            for doc, inside, text in zip(batch["doc_id"], batch["in_training"], batch["text"], strict=True):
                words = tokens(text) + [END]
                ids = vocabulary.ids(words)
                target = vocabulary.classes_of(words, ids)
                if ids[-1] < 0:
                    target[-1] = 1
                last = np.concatenate([[0], target[:-1]])
                before = np.concatenate([[0], last[:-1]])
                whole = scorer.classes(before, last, target) + scorer.share[target]
                known = ids >= 0
                logs = log_counts[ids[known]]
                tail: dict[bytes, list] = {}
                for i in np.flatnonzero(~known).tolist():
                    seen = tail.setdefault(words[i], [0, 0.0, 0.0])
                    seen[0] += 1
                    seen[1] += float(whole[i])
                    seen[2] += float(scorer.unknown[before[i], last[i]])
                sums = list(tail.values())
                rows.append((doc, inside, len(words), int(known.sum()), float(logs.sum()), float(whole[known].sum() + logs.sum()),
                             list(tail), [s[0] for s in sums], [s[1] for s in sums], [s[2] for s in sums]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCORED.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    return run


def train(docs: DataFrame) -> tuple[DataFrame, Vocabulary, Scorer]:
    """Counts, vocabulary and model of the (doc_id, text) rows of a training split."""
    counts = cut(count_tokens(docs))
    vocabulary = Vocabulary(counts)
    documents = docs.count()
    turn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = docs.where(turn < SAMPLE_DOCS / max(1, documents)).coalesce(1)
    p = train_round(sample, vocabulary, initial(vocabulary), 0.1, epochs=10)
    return counts, vocabulary, Scorer(train_round(docs, vocabulary, p, 0.03), vocabulary)


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, scorer: Scorer) -> DataFrame:
    """Add up every text of (doc_id, in_training, text): base and model scores."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "in_training", F.coalesce("text", F.lit("")).alias("text"))
    first = cut(rows.mapInPandas(score_task(vocabulary, scorer), SCORED).withColumn("row", F.monotonically_increasing_id()))
    listed = first.select("row", F.explode(F.arrays_zip("tail", "times", "as_known", "as_unknown")).alias("t"))
    listed = listed.select("row", F.col("t.tail").alias("token"), "t.times", "t.as_known", "t.as_unknown")
    met = listed.join(counts, "token", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    there = F.col("c").isNotNull()
    sums = met.groupBy("row").agg(
        F.sum(F.when(there, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * log).alias("more_logs"),
        F.sum(F.when(there, F.col("as_known") + F.col("times") * log).otherwise(F.col("as_unknown"))).alias("more_score"))
    total = float(np.log10(vocabulary.n + SMOOTH * (vocabulary.v + 1)))
    none = F.lit(0.0)
    return first.drop("tail", "times", "as_known", "as_unknown").join(sums, "row", "left").select(
        "doc_id", "in_training", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", none) - F.col("n_tokens") * total).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", none)).alias("score"))


def op1_scoring(docs: DataFrame) -> DataFrame:
    """Base and model score of every document."""
    inside = F.coalesce(remainder("doc_id", FOLDS) != 0, F.lit(False))
    rows = docs.select("doc_id", "text", inside.alias("in_training"))
    counts, vocabulary, scorer = train(rows.where("in_training").select("doc_id", "text"))
    out = score(rows, counts, vocabulary, scorer)
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
