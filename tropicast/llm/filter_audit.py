"""How five filters interact: step counts of all 120 orders and Shapley shares, from one game of 32 coalitions.

A document fails a set of the filters A to E, so a table is 32 counts for each part. The removal game
gives a coalition of filters the number of documents that fail one of them at least. Its Hart-Mas-Colell
potential follows coalition by coalition: the potential of a coalition is its value plus the potentials
of the coalitions with one filter less, divided by its size. A filter's Shapley value is the
potential of all five less that of the other four; 120 times the potential is a whole number, so the
recursion stays in integers. What a filter removes at a step is the value of the coalition with it
less that without it, and the same differences in the games of good and of toxic documents give what is lost.

Rows meet twice, without their texts: by document to find their labels and by the digest of the text to find
copies. They are counted before either, so a text that a third of the rows share is
a few counts by then.

Defined results: a NULL text is empty (it fails A, and E as a copy of smaller empty ones; it passes B, C and D); a NULL doc_id has no
smaller one, is smaller than none and has no label; repeated rows count each, and none of them is a copy of its equal in id; of several
label rows of a document one with 1 is enough, NULL is 0; the part of a NULL language is the empty string; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import whole_text

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
GAMES = ("all", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    # a leading or trailing empty piece is no word
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)]
    return sum(bits[1:], bits[0])


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters."""
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), failures(text).alias("mask"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("copies"))
    marks = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    nobody = rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    every = known.select(*rows.columns, *flags).unionByName(nobody)
    # per text at most four rows a part; the smallest id comes with the number of its rows
    low = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "copies")))
    groups = every.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("copies").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("copies"))), F.lit(0)).alias("named"), low.alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    own = F.when(F.col("low.doc_id") == F.col("first"), F.col("low.copies")).otherwise(0)
    kinds = groups.withColumn("first", first).withColumn("later", F.col("named") - own)
    both = F.explode(F.array(F.struct((F.col("mask").bitwiseOR(F.lit(16))).alias("mask"), F.col("later").alias("n")),
                             F.struct(F.col("mask"), (F.col("n") - F.col("later")).alias("n"))))
    return kinds.select("part", "good", "toxic", both.alias("k")).groupBy("part", F.col("k.mask").alias("mask"), "good", "toxic").agg(
        F.sum("k.n").alias("n"))


def removal_games(counts: DataFrame) -> DataFrame:
    """(part, all, good, toxic): the value of every coalition as an array; ``total`` documents of the part."""
    sums = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    # 32 masks a part
    table = sums.groupBy("part").agg(F.collect_list(F.struct("mask", *GAMES)).alias("cells"), F.sum("all").alias("total"))

    def values(game: str) -> Column:
        def value(coalition: Column) -> Column:
            return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"].bitwiseAND(coalition) != 0, c[game]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), value)

    return table.select("part", "total", *[values(g).alias(g) for g in GAMES])


def potentials(values: Column) -> Column:
    """120 times the potential of every coalition of a game, each after all coalitions that it contains."""
    def add(known: Column, coalition: Column) -> Column:
        without = [F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, coalition.bitwiseXOR(F.lit(1 << i)))).otherwise(0)
                   for i in range(len(FILTERS))]
        whole = F.lit(120) * F.get(values, coalition) + sum(without[1:], without[0])
        # leaves no rest: the least common multiple of the sizes divides 120
        return F.concat(known, F.array(F.call_function("div", whole, F.bit_count(coalition).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), add)


def steps(games: DataFrame) -> DataFrame:
    """A row per part, order and step from the games of ``removal_games``."""
    rows = games.withColumn("potential", potentials(F.col("all")))
    rows = rows.select("*", F.explode(F.lit(ORDERS)).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def coalition(letters: Column) -> Column:
        bits = [F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)]
        return sum(bits[1:], bits[0])

    own = coalition(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    after = coalition(F.substring(F.col("filter_order"), F.lit(1), F.col("step")))
    rows = rows.withColumns({"own": own, "after": after})
    before, others = F.col("after").bitwiseXOR(F.col("own")), F.lit(ALL).bitwiseXOR(F.col("own"))

    def step_of(game: str) -> Column:
        return F.get(game, F.col("after")) - F.get(game, before)

    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("all", F.col("after"))).alias("kept"), step_of("all").alias("removed"),
        (F.get("all", F.col("own")) - step_of("all")).alias("redundant"),
        (F.get("all", F.lit(ALL)) - F.get("all", others)).alias("unique_fails"),
        step_of("good").alias("good_lost"), step_of("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(ALL)) - F.get("potential", others)).alias("shapley"))


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Step counts of the five filters in every order, by language."""
    return steps(removal_games(cut(masked(docs, labels))))


# masks by words and by a window over whole texts, each order walked by itself, Shapley shares as sums over the orders
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)} AS fails
    FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END,
    CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT concat(a.c, b.c, d.c, e.c, g.c) AS filter_order FROM x a, x b, x d, x e, x g
    WHERE b.c <> a.c AND d.c NOT IN (a.c, b.c) AND e.c NOT IN (a.c, b.c, d.c) AND g.c NOT IN (a.c, b.c, d.c, e.c)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
k AS (SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS hit, translate(failed, before, '') = failed AS open, failed = own AS only_own
    FROM s, m),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN open AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN open AND hit THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND NOT open THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN open AND hit THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN open AND hit THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
