"""Features, folds, candidates and learners (M, V1 to V6, R, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..operators import ensemble, eof, features, folds, lagged, learners, quantiles, search, skewed, tuning, verify, windows
from ..session import cut, scratch_path
from ..sources.models import ModelRegistry
from .fields import anomalies
from .registry import query, r, rounded
from .views import EDGES, LEADS, Views

PREDICTORS = ["oni", "wwv", "iod"]


def feature_table(v: Views, **options):
    options = {"leads": LEADS, "n_lags": 3, "step": 3, "cycle": False, **options}
    return features.features(v.series, "oni", PREDICTORS, **options)


# standardised predictors (ddof 0) of the months all three series have
Z_SQL = """SELECT m, time, oni AS value, (oni - avg(oni) OVER ()) / stddev_pop(oni) OVER () AS z0, (wwv - avg(wwv) OVER ()) / stddev_pop(wwv) OVER () AS z1,
    (iod - avg(iod) OVER ()) / stddev_pop(iod) OVER () AS z2 FROM (SELECT a.m, a.time, a.value AS oni, b.value AS wwv, c.value AS iod FROM idx a JOIN idx2 b ON a.m = b.m JOIN idx3 c ON a.m = c.m)"""
FEAT_SQL = f"""SELECT m, time, value, [z0, z1, z2, lag(z0, 3) OVER w, lag(z1, 3) OVER w, lag(z2, 3) OVER w, lag(z0, 6) OVER w, lag(z1, 6) OVER w, lag(z2, 6) OVER w] AS x,
    row_number() OVER w AS i FROM ({Z_SQL}) WINDOW w AS (ORDER BY m)"""
LEAD_SQL = "(SELECT unnest([0,3,6,9,12,15,18,21])::INT AS lead) l"
M1_SQL = f"""SELECT lead, f.m, (f.m + lead + 3)::INT AS m_target, f.x AS x, t.value AS y, f.value AS y_persistence FROM ({FEAT_SQL}) f, {LEAD_SQL}, ({FEAT_SQL}) t
    WHERE f.i > 9 AND t.i > 9 AND t.m = f.m + lead + 3"""


def _plain(table):
    return table.select("lead", "m", "m_target", F.transform("x", lambda x: r(x)).alias("x"), "y", "y_persistence")


def _round_x(sql: str) -> str:
    return sql.replace(" f.x AS x,", " list_transform(f.x, lambda q: round(q, 6) + 0e0) AS x,")


@query("m1", _round_x(M1_SQL))
def m1(v: Views):
    return _plain(feature_table(v))


@query("m2", """WITH s AS (SELECT lat, lon, m, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS v FROM fld WINDOW w AS (PARTITION BY lat, lon ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT lead, a.lat, a.lon, a.m, b.m AS m_target, round(a.v, 6) + 0e0 AS x, round(b.v, 6) + 0e0 AS y FROM s a, (SELECT unnest([0,3,6,9,12,15,18,21])::INT AS lead) l, s b WHERE a.lat = b.lat AND a.lon = b.lon AND b.m = a.m + lead + 3 AND a.v IS NOT NULL AND b.v IS NOT NULL""")
def m2(v: Views):
    return rounded(features.field_features(v.fld, LEADS), "x", "y")


@query("m3", _round_x(f"""SELECT lead, f.m, (f.m + lead + 3)::INT AS m_target, f.x AS x, t.value AS y, f.value AS y_persistence FROM ({FEAT_SQL}) f CROSS JOIN {LEAD_SQL} LEFT JOIN ({FEAT_SQL}) t
    ON t.m = f.m + lead + 3 AND t.i > 9 WHERE f.i > 9 AND t.value IS NULL"""))
def m3(v: Views):
    return _plain(feature_table(v, keep_future=True).where("y is null"))


U_SQL = "('0x' || substr(md5({0}), 1, 12))::UBIGINT::DOUBLE / 281474976710656e0"


@query("m4", f"""WITH t AS (SELECT lead, m_target AS m, y, CASE WHEN m_target // 12 - 13 + 17 BETWEEN 1982 AND 2001 THEN 'elnino-like' ELSE 'lanina-like' END AS regime FROM ({M1_SQL})),
    k AS (SELECT *, row_number() OVER (PARTITION BY lead, regime ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY lead, regime) AS n FROM t),
    d AS (SELECT lead, regime, draw, floor({U_SQL.format("concat_ws('|', '3', lead, regime, draw)")} * n)::INT AS i FROM (SELECT DISTINCT lead, regime, n FROM k), (SELECT unnest(range(0, 1000)) AS draw))
    SELECT d.lead, d.regime, count(*) AS n, round(avg(y), 6) + 0e0 AS mean FROM d JOIN k ON k.lead = d.lead AND k.regime = d.regime AND k.i = d.i GROUP BY 1, 2""")
def m4(v: Views):
    table = feature_table(v).select("lead", F.col("m_target").alias("m"), "y")
    # years are shifted so that both regimes occur
    table = table.withColumn("year", F.floor(F.col("m") / 12) - 13 + 17)
    draws = features.balanced_sample(table, 1000, seed=3)
    return draws.groupBy("lead", "regime").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("mean"))


FOLD_SQL = """CASE WHEN m_target // 12 >= 1995 AND m_target // 12 < 1997 THEN 1995 WHEN m_target // 12 >= 1997 AND m_target // 12 < 1999 THEN 1997
    WHEN m_target // 12 >= 1999 AND m_target // 12 < 2001 THEN 1999 WHEN m_target // 12 >= 2001 AND m_target // 12 < 2002 THEN 2001 END"""


@query("v1", f"""WITH t AS (SELECT lead, {FOLD_SQL} AS fold FROM ({M1_SQL}))
    SELECT lead, fold, count(*) AS n_test, (SELECT count(*) FROM t u WHERE u.lead = t.lead) - count(*) AS n_train FROM t WHERE fold IS NOT NULL GROUP BY 1, 2""")
def v1(v: Views):
    return folds.fold_sizes(feature_table(v).withColumn("year", F.floor(F.col("m_target") / 12)), EDGES)


@query("v2", f"""WITH t AS (SELECT lead, row_number() OVER (PARTITION BY lead ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY lead) AS n FROM ({M1_SQL}))
    SELECT lead, segment, member, max(n) - count(*) AS n_train, count(*) AS n_val FROM (SELECT lead, (i // (n // 5))::INT AS segment, n FROM t), (SELECT unnest([0, 1, 2])::INT AS member)
    WHERE segment < 5 GROUP BY 1, 2, 3""")
def v2(v: Views):
    return folds.member_sizes(feature_table(v), 5, 3, ("lead",))


SPACE = {
    "layers": (1, 4),
    "neurons": ((8, 4), (64, 16)),
    "dropout": (0.0, 0.5),
    "l1": (0.001, 1.0, "log"),
    "batch": (2, (3, 7), "exp"),
}


def _u(*parts: str, seed: int = 0) -> str:
    return U_SQL.format("concat_ws('|', " + ", ".join([f"'{seed}'", *parts]) + ")")


@query("v3", f"""SELECT lead, candidate, (1 + floor({_u('lead', 'candidate', "'layers'")} * 4))::INT AS layers,
    [(8 + floor({_u('lead', 'candidate', "'neurons'", "0")} * 57))::INT, (4 + floor({_u('lead', 'candidate', "'neurons'", "1")} * 13))::INT] AS neurons,
    round({_u('lead', 'candidate', "'dropout'")} * 0.5e0, 8) + 0e0 AS dropout,
    round(pow(10e0, -3e0 + floor({_u('lead', 'candidate', "'l1'")} * 100) * (3e0 / 99)), 8) + 0e0 AS l1,
    pow(2e0, 3 + floor({_u('lead', 'candidate', "'batch'")} * 5)) AS batch
    FROM (SELECT DISTINCT lead FROM ({M1_SQL})), (SELECT unnest(range(0, 50))::INT AS candidate)""")
def v3(v: Views):
    leads = feature_table(v).select("lead").distinct()
    return rounded(search.random_candidates(leads, SPACE, 50), "dropout", "l1", digits=8)


DAMP_SPACE = {"damping": (0.0, 1.2), "shrink": (0.0, 1.0)}


def damped_losses(v: Views, n: int):
    """Validation loss per fold of damped-persistence candidates, from sums per fold."""
    rows = learners.with_fold(feature_table(v), EDGES).where("fold is not null")
    y, p = F.col("y"), F.col("y_persistence")
    sums = rows.groupBy("lead", "fold").agg(
        F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.sum(y * y).alias("yy"),
        F.sum(y * p).alias("yp"), F.sum(p * p).alias("pp"))
    candidates = search.random_candidates(sums.select("lead").distinct(), DAMP_SPACE, n)
    a, c = F.col("damping"), F.col("shrink")
    loss = (F.col("yy") + a * a * F.col("pp") + c * c * F.col("n") - 2.0 * a * F.col("yp") - 2.0 * c * F.col("sy") + 2.0 * a * c * F.col("sp")) / F.col("n")
    return candidates.join(sums, "lead").select("lead", "fold", "candidate", "damping", "shrink", loss.alias("loss"))


def damped_history(v: Views, n: int):
    return damped_losses(v, n).groupBy("lead", "candidate", "damping", "shrink").agg(F.avg("loss").alias("loss"))


@query("v4", f"""WITH t AS (SELECT lead, {FOLD_SQL} AS fold, y, y_persistence AS p FROM ({M1_SQL})),
    c AS (SELECT lead, candidate, {_u('lead', 'candidate', "'damping'")} * 1.2e0 AS a, {_u('lead', 'candidate', "'shrink'")} AS c FROM (SELECT DISTINCT lead FROM t), (SELECT unnest(range(0, 60))::INT AS candidate)),
    s AS (SELECT c.lead, candidate, fold, avg((y - a * p - c)^2) AS loss FROM t JOIN c ON c.lead = t.lead WHERE fold IS NOT NULL GROUP BY 1, 2, 3),
    h AS (SELECT lead, candidate, avg(loss) AS loss FROM s GROUP BY 1, 2)
    SELECT lead, min_by(candidate, loss) AS candidate, round(min(loss), 6) + 0e0 AS loss FROM h GROUP BY 1""")
def v4(v: Views):
    history = search.score_candidates(damped_losses(v, 60), ("lead",))
    return rounded(search.best_candidate(history, ("lead",)), "loss")


@query("v4_search")
def v4_search(v: Views):
    """Random search over inputs and penalties per lead and fold, refitted and scored on the decades left out."""
    table = cut(feature_table(v))
    space = {"inputs": (list(range(3 * len(PREDICTORS))), 4), "ridge": (0.01, 100.0, "log")}
    _, models = tuning.random_search(table, space, 40, 5, EDGES)
    hindcast = tuning.ensemble_hindcast(table, models, EDGES)
    scored = hindcast.groupBy("lead").agg(F.count("y").alias("n"), verify.rmse().alias("rmse"), pearson("y", "mean").alias("r"))
    return rounded(scored, "rmse", "r")


# each segment's ridge regression on the other segments of the training years, one predictor
SEGMENTS_SQL = f"""t AS (SELECT lead, m, m_target, {FOLD_SQL} AS own, y, y_persistence AS x FROM ({M1_SQL})),
    e AS (SELECT unnest([1995, 1997, 1999, 2001])::INT AS fold),
    n AS (SELECT t.*, e.fold, row_number() OVER (PARTITION BY lead, fold ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY lead, fold) AS n FROM t, e WHERE own IS NULL OR own <> fold),
    g AS (SELECT *, CASE WHEN i // (n // 5) < 5 THEN (i // (n // 5))::INT END AS seg FROM n),
    k AS (SELECT unnest([0, 1, 2, 3, 4])::INT AS segment)"""


@query("v4_refit", f"""WITH {SEGMENTS_SQL},
    s AS (SELECT lead, fold, segment, covar_pop(y, x) * count(*) AS xy, var_pop(x) * count(*) AS xx, avg(x) AS mx, avg(y) AS my FROM g, k WHERE seg IS NULL OR seg <> segment GROUP BY 1, 2, 3),
    c AS (SELECT lead, fold, candidate, {_u('lead', 'fold', 'candidate', "'ridge'")} * 200e0 AS ridge FROM (SELECT DISTINCT lead, fold FROM g), (SELECT unnest(range(0, 30))::INT AS candidate)),
    b AS (SELECT s.lead, s.fold, segment, candidate, xy / (xx + ridge) AS b, my - xy / (xx + ridge) * mx AS a FROM s JOIN c ON c.lead = s.lead AND c.fold = s.fold),
    l AS (SELECT b.lead, b.fold, candidate, segment, avg((y - a - b * x)^2) AS loss FROM b JOIN g ON g.lead = b.lead AND g.fold = b.fold AND g.seg = b.segment GROUP BY 1, 2, 3, 4),
    h AS (SELECT lead, fold, min_by(candidate, loss) AS candidate FROM (SELECT lead, fold, candidate, avg(loss) AS loss FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT t.lead, t.own AS fold, h.candidate, t.m_target AS m, any_value(y) AS y, round(avg(a + b * x), 6) + 0e0 AS mean
    FROM t JOIN h ON h.lead = t.lead AND h.fold = t.own JOIN b ON b.lead = h.lead AND b.fold = h.fold AND b.candidate = h.candidate GROUP BY 1, 2, 3, 4""")
def v4_refit(v: Views):
    """Search of the penalty on one predictor; the best candidate's members, fitted again, forecast their decade."""
    table = cut(feature_table(v).withColumn("x", F.array("y_persistence")))
    _, models = tuning.random_search(table, {"ridge": (0.0, 200.0)}, 30, 5, EDGES)
    best = models.select("lead", "fold", "candidate").distinct()
    out = tuning.ensemble_hindcast(table, models, EDGES).join(best, ["lead", "fold"])
    return out.select("lead", "fold", "candidate", "m", "y", r("mean").alias("mean"))


GENES = {"inputs": (PREDICTORS, 2), "lag": (0, 2), "ridge": (0.0, 20.0)}
SURVIVORS, OFFSPRING, NEWCOMERS = 10, 12, 8
IDS = {"clone": 0, "offspring": SURVIVORS, "new": SURVIVORS + OFFSPRING}


def _random_genes(seed: int, *ids: str) -> str:
    """Columns of random genes, as SQL."""
    items = ", ".join(f"{{'u': {_u(*ids, repr('inputs'), repr(str(i)), seed=seed)}, 'v': '{p}'}}" for i, p in enumerate(PREDICTORS))
    return (f"list_transform(list_sort([{items}])[1:2], lambda s: s.v) AS inputs, floor({_u(*ids, repr('lag'), seed=seed)} * 3)::INT AS lag, "
            f"{_u(*ids, repr('ridge'), seed=seed)} * 20e0 AS ridge")


def _mutated(seed: int, *ids: str) -> str:
    """Columns of mutated genes, as SQL: one input swapped, lag and ridge moved by up to a fiftieth of their range and clamped."""
    swap = f"list_filter({PREDICTORS}, lambda p: NOT list_contains(inputs, p))[1]"
    at = f"floor({_u(*ids, repr('inputs'), repr('at'), seed=seed)} * 2)::INT"
    moved = {name: f"{name} + {width}e0 * 0.02e0 * (2e0 * {_u(*ids, repr(name), seed=seed)} - 1e0)" for name, width in (("lag", 2), ("ridge", 20))}
    return (f"CASE WHEN {at} = 0 THEN [{swap}, inputs[2]] ELSE [inputs[1], {swap}] END AS inputs, "
            f"least(greatest(trunc({moved['lag']})::INT, 0), 2) AS lag, least(greatest({moved['ridge']}, 0e0), 20e0) AS ridge")


def _rated(population: str) -> str:
    """A population with the mean squared error of its ridge regressions on two inputs, by lead, as SQL."""
    place = "list_position(['oni', 'wwv', 'iod'], inputs[{0}]) + 3 * lag"
    return f"""SELECT lead, id, any_value(inputs) AS inputs, any_value(lag) AS lag, any_value(ridge) AS ridge, avg(loss) AS score FROM (
        SELECT f.lead, f.id, f.fold, any_value(f.inputs) AS inputs, any_value(f.lag) AS lag, any_value(f.ridge) AS ridge, avg((y - my - b1 * (x1 - m1) - b2 * (x2 - m2))^2) AS loss
        FROM (SELECT lead, id, fold, inputs, lag, ridge, m1, m2, my, ((c22 + ridge) * c1 - c12 * c2) / ((c11 + ridge) * (c22 + ridge) - c12 * c12) AS b1,
                ((c11 + ridge) * c2 - c12 * c1) / ((c11 + ridge) * (c22 + ridge) - c12 * c12) AS b2
            FROM (SELECT p.lead, id, e.fold, any_value(inputs) AS inputs, any_value(lag) AS lag, any_value(ridge) AS ridge, avg(x[{place.format(1)}]) AS m1, avg(x[{place.format(2)}]) AS m2, avg(y) AS my,
                    var_pop(x[{place.format(1)}]) * count(*) AS c11, var_pop(x[{place.format(2)}]) * count(*) AS c22, covar_pop(x[{place.format(1)}], x[{place.format(2)}]) * count(*) AS c12,
                    covar_pop(x[{place.format(1)}], y) * count(*) AS c1, covar_pop(x[{place.format(2)}], y) * count(*) AS c2
                FROM {population} p JOIN t ON t.lead = p.lead, e WHERE t.own IS NULL OR t.own <> e.fold GROUP BY 1, 2, 3)) f
        JOIN (SELECT t.lead, t.own, y, id, x[{place.format(1)}] AS x1, x[{place.format(2)}] AS x2 FROM {population} p JOIN t ON t.lead = p.lead) h ON h.lead = f.lead AND h.id = f.id AND h.own = f.fold
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def _bred(population: str, generation: int) -> str:
    """Clones, offspring and newcomers of a rated population, as SQL."""
    size = SURVIVORS + OFFSPRING + NEWCOMERS
    parent = {g: f"floor({_u('lead', repr('offspring'), 'i', repr(g), repr('parent'), seed=generation)} * {SURVIVORS})::INT" for g in GENES}
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY lead ORDER BY score, id) - 1 AS rank FROM {population})"
    joins = " ".join(f"JOIN {ranked} j_{g} ON j_{g}.lead = o.lead AND j_{g}.rank = o.p_{g}" for g in GENES)
    return f"""SELECT lead, (i + {generation * size})::INT AS id, {_mutated(generation, 'lead', "'clone'", 'i')} FROM (SELECT *, rank AS i FROM {ranked} WHERE rank < {SURVIVORS})
        UNION ALL SELECT lead, (i + {generation * size + IDS['offspring']})::INT, {_mutated(generation, 'lead', "'offspring'", 'i')} FROM (
            SELECT o.lead, i, {', '.join(f'j_{g}.{g}' for g in GENES)} FROM (SELECT lead, i, {', '.join(f'{p} AS p_{g}' for g, p in parent.items())}
                FROM (SELECT DISTINCT lead FROM t), (SELECT unnest(range(0, {OFFSPRING}))::INT AS i)) o {joins})
        UNION ALL SELECT lead, (i + {generation * size + IDS['new']})::INT, {_random_genes(generation, 'lead', "'new'", 'i')} FROM (SELECT DISTINCT lead FROM t), (SELECT unnest(range(0, {NEWCOMERS}))::INT AS i)"""


@query("v5", f"""WITH t AS MATERIALIZED (SELECT lead, {FOLD_SQL} AS own, x, y FROM ({M1_SQL})), e AS (SELECT unnest([1995, 1997, 1999, 2001])::INT AS fold),
    p0 AS MATERIALIZED (SELECT lead, id, {_random_genes(0, 'lead', 'id')} FROM (SELECT DISTINCT lead FROM t), (SELECT unnest(range(0, 30))::INT AS id)), s0 AS MATERIALIZED ({_rated('p0')}),
    p1 AS MATERIALIZED ({_bred('s0', 1)}), s1 AS MATERIALIZED ({_rated('p1')}), p2 AS MATERIALIZED ({_bred('s1', 2)})
    SELECT lead, id, array_to_string(inputs, ',') AS inputs, lag, round(ridge, 6) + 0e0 AS ridge, round(score, 6) + 0e0 AS score FROM ({_rated('p2')})""")
def v5(v: Views):
    """Two generations of an evolutionary search per lead, over inputs, their lag and the penalty, rated on the folds."""
    products = tuning.fold_products(feature_table(v), EDGES)
    names = F.array(*[F.lit(p) for p in PREDICTORS])
    inputs = F.transform("inputs", lambda p: (F.array_position(names, p) - 1 + len(PREDICTORS) * F.col("lag")).cast("int"))
    out = tuning.evolve(products, GENES, inputs, SURVIVORS, OFFSPRING, NEWCOMERS, 2)
    return rounded(out.select("lead", "id", F.concat_ws(",", "inputs").alias("inputs"), "lag", "ridge", "score"), "ridge", "score")


@query("v6", f"""SELECT DISTINCT lead, fold FROM (SELECT lead, {FOLD_SQL} AS fold FROM ({M1_SQL})) WHERE fold IS NOT NULL AND NOT (lead <= 6 AND fold = 1997)""")
def v6(v: Views):
    tasks = learners.with_fold(feature_table(v), EDGES).where("fold is not null").select("lead", "fold").distinct()
    registry = tasks.where("lead <= 6 and fold = 1997")
    return folds.open_tasks(tasks, registry)


# learners ------------------------------------------------------------------------------


@query("r1")
def r1(v: Views):
    """Lasso per lead, fold and penalty, chosen by validation loss, scored on its hindcast."""
    table = cut(feature_table(v))
    models = cut(learners.lasso_models(table, (0.0, 0.01, 0.05, 0.2), EDGES))
    history = learners.lasso_validation(table, models, EDGES)
    best = search.best_candidate(search.score_candidates(history.withColumnRenamed("alpha", "candidate"), ("lead",)), ("lead",))
    chosen = models.join(best.select("lead", F.col("candidate").alias("alpha")), ["lead", "alpha"])
    hindcast = learners.hindcast(table, chosen, EDGES)
    return rounded(lagged.correlate(hindcast, "mean", "y", ["lead", "alpha"]), "r", "p")


@query("r2")
def r2(v: Views):
    """Members of a mean-forecast ensemble, averaged and scored."""
    table = cut(feature_table(v))
    members = learners.predict_members(table, learners.mean_ensemble(table, 5, edges=EDGES), EDGES)
    mean = ensemble.plain_mean(members, ["mean", "y"], ("lead", "m"))
    return rounded(lagged.correlate(mean, "mean", "y", ["lead"]), "r", "p")


@query("r2_members", f"""WITH {SEGMENTS_SQL},
    w AS (SELECT g.*, member, CASE WHEN member = 0 THEN 1e0 ELSE -ln(1e0 - {_u('fold', 'member', 'm')}) END AS w FROM g, (SELECT unnest([0, 1, 2])::INT AS member)),
    s AS (SELECT lead, fold, segment, member, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my
        FROM w, k WHERE seg IS NULL OR seg <> segment GROUP BY 1, 2, 3, 4)
    SELECT t.lead, t.m_target AS m, count(*) AS members, any_value(y) AS y, round(avg(my + b * (x - mx)), 6) + 0e0 AS mean FROM t JOIN s ON s.lead = t.lead AND s.fold = t.own GROUP BY 1, 2""")
def r2_members(v: Views):
    """Three members per segment left out, each with its own weights, averaged."""
    table = cut(feature_table(v).withColumn("x", F.array("y_persistence")))
    members = learners.predict_members(table, learners.mean_ensemble(table, 5, 0.0, EDGES, n_members=3), EDGES)
    mean = members.groupBy("lead", "m").agg(F.count("mean").alias("members"), F.first("y").alias("y"), r(F.avg("mean")).alias("mean"))
    return mean.select("lead", "m", "members", "y", "mean")


def gaussian_hindcast(v: Views):
    table = cut(feature_table(v))
    members = learners.predict_members(table, learners.gaussian_ensemble(table, 5, edges=EDGES), EDGES)
    mixed = ensemble.gaussian_mixture(members, ("lead", "m", "target_season"))
    return verify.match(mixed.withColumn("model", F.lit("ensemble")), v.idx)


@query("r3")
def r3(v: Views):
    scored = gaussian_hindcast(v).groupBy("model", "lead").agg(*verify.score_columns())
    return rounded(scored, "r", "rmse", "srmse", "nll", "inside1")


@query("r3_skewed")
def r3_skewed(v: Views):
    """Skewed-Gaussian members per lead, decade and segment; their mixture scored on the decades left out."""
    table = cut(feature_table(v))
    members = cut(skewed.predict(table, skewed.ensemble(table, 5, 1, EDGES, ridge=2.0), EDGES))
    mixed = verify.match(skewed.mixture(members).withColumn("model", F.lit("skewed")), v.idx)
    columns = [c for c in verify.score_columns()] + [F.avg(verify.nll_skewed("y", "location", "scale", "shape")).alias("nll_skewed")]
    return rounded(mixed.groupBy("model", "lead").agg(*columns), "r", "rmse", "srmse", "nll", "inside1", "nll_skewed", digits=4)


@query("r4")
def r4(v: Views):
    """Quantile models per lead and fold; pinball loss of their hindcast."""
    table = cut(feature_table(v))
    models = learners.quantile_models(table, (0.16, 0.84), EDGES)
    rows = learners.with_fold(table, EDGES).join(models, ["lead", "fold"])
    loss = verify.pinball("y", learners.linear(), F.col("q"))
    return rows.groupBy("lead", "q").agg(F.count(F.lit(1)).alias("n"), r(F.avg(loss), 4).alias("qs"))


@query("r5")
def r5(v: Views):
    """Joint quantile models per lead and fold: a median and increments that cannot be negative."""
    table, levels = cut(feature_table(v)), (0.025, 0.5, 0.975)
    out = quantiles.predict_joint(table, quantiles.joint_models(table, levels, EDGES), levels, EDGES)
    return out.select("lead", "m", "target_season", *[r(F.get("forecast", F.lit(i)), 4).alias(n) for i, n in enumerate(("low", "mid", "high"))])


@query("r6")
def r6(v: Views):
    """Interval-probability forecast of the decades held out, and its summary."""
    table = cut(feature_table(v))
    probs = learners.interval_hindcast(table, learners.interval_models(table, edges=EDGES), EDGES)
    summary = verify.distribution_summary(probs.withColumn("model", F.lit("classifier")))
    return summary.select("model", "lead", "target_season", "mode_class", "median_class")


@query("r7")
def r7(v: Views):
    """Fields of the decades left out, through patterns and regressions that have not seen them."""
    out = learners.field_hindcast(anomalies(v).select("lat", "lon", "m", "value"), LEADS, k=3, edges=EDGES)
    obs = anomalies(v).select("lat", "lon", "m", F.col("value").alias("y"))
    both = out.join(obs, ["lat", "lon", "m"])
    return both.groupBy("lead", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), r(verify.rmse("y", "value"), 4).alias("rmse"))


@query("r9", f"""WITH t AS (SELECT lead, m_target AS m, y, y_persistence AS p, {FOLD_SQL} AS fold FROM ({M1_SQL})),
    s AS (SELECT f.lead, f.fold, regr_slope(t.y, t.p) AS a, regr_intercept(t.y, t.p) AS b FROM (SELECT DISTINCT lead, fold FROM t WHERE fold IS NOT NULL) f JOIN t ON t.lead = f.lead AND (t.fold IS NULL OR t.fold <> f.fold) GROUP BY 1, 2)
    SELECT t.lead, t.fold, t.m, y, round(a * p + b, 6) + 0e0 AS mean FROM t JOIN s ON s.lead = t.lead AND s.fold = t.fold""")
def r9(v: Views):
    """Hindcast of a regression on persistence, each decade from the other decades."""
    table = feature_table(v).withColumn("x", F.array("y_persistence"))
    products = cut(learners.cross_products(learners.with_fold(table, EDGES), ["lead", "fold"]))
    models = learners.solve(learners.others(products, "fold", ["lead"]))
    out = learners.hindcast(table, models, EDGES)
    return out.select("lead", "fold", "m", "y", r("mean").alias("mean"))


@query("r9_registry", f"""WITH t AS (SELECT lead, m_target AS m, y, y_persistence AS p, {FOLD_SQL} AS fold FROM ({M1_SQL})),
    s AS (SELECT f.lead, f.fold, regr_slope(t.y, t.p) AS a, regr_intercept(t.y, t.p) AS b FROM (SELECT DISTINCT lead, fold FROM t WHERE fold IS NOT NULL) f JOIN t ON t.lead = f.lead AND (t.fold IS NULL OR t.fold <> f.fold) GROUP BY 1, 2),
    n AS (SELECT count(*) FILTER (WHERE lead < 9) AS n1, count(*) FILTER (WHERE lead >= 9) AS n2 FROM s)
    SELECT t.lead, t.fold, CASE WHEN t.lead < 9 THEN n1 ELSE n2 END AS trained, t.m, y, round(a * p + b, 6) + 0e0 AS mean FROM t JOIN s ON s.lead = t.lead AND s.fold = t.fold, n""")
def r9_registry(v: Views):
    """A training that ends after some leads, its resumption, and the hindcast from the stored models.

    ``trained`` is the number of tasks of the run that trained the model.
    """
    table = cut(feature_table(v).withColumn("x", F.array("y_persistence")))
    products = tuning.fold_products(table, EDGES)
    registry = ModelRegistry(v.spark, scratch_path(v.spark, "models"))

    def learner(tasks):
        return tuning.solved(products.join(tasks, ["lead", "fold"]), tasks).select("lead", "fold", "coef")

    tasks = products.select("lead", "fold")
    first = registry.train(tasks, "persistence", learner, [lead for lead in LEADS if lead < 9])
    second = registry.train(tasks, "persistence", learner, LEADS)
    out = learners.hindcast(table, registry.models("persistence").select("lead", "fold", "coef"), EDGES)
    trained = F.when(F.col("lead") < 9, F.lit(first)).otherwise(F.lit(second)).cast("long")
    return out.select("lead", "fold", trained.alias("trained"), "m", "y", r("mean").alias("mean"))


@query("r10", "SELECT l.lead, a.m + l.lead + 3 AS m, b.value AS y, a.value AS mean FROM idx a, (SELECT unnest([0,3,6,9,12,15,18,21])::INT AS lead) l, idx b WHERE b.m = a.m + l.lead + 3")
def r10(v: Views):
    out = windows.labels(v.idx, LEADS)
    return out.select("lead", F.col("m_target").alias("m"), "y", F.col("y_persistence").alias("mean"))


@query("r11")
def r11(v: Views):
    table = cut(feature_table(v))
    return rounded(learners.relevance(learners.mean_ensemble(table, 5, edges=EDGES), len(PREDICTORS)), "weight")


# extension points ----------------------------------------------------------------------


@query("u1", f"SELECT lead, count(*) AS n, round(avg(y), 6) + 0e0 AS y, round(avg(y_persistence), 6) + 0e0 AS p FROM ({M1_SQL}) WHERE lead IN (0, 6) GROUP BY 1")
def u1(v: Views):
    """Any callable that returns a feature table for a lead can feed the models."""
    def features_for(lead):
        return feature_table(v, leads=(lead,))

    table = features_for(0).unionByName(features_for(6))
    return table.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), r(F.avg("y")).alias("y"), r(F.avg("y_persistence")).alias("p"))


@query("u2", f"""WITH t AS (SELECT m_target AS m, y, y_persistence AS p FROM ({M1_SQL}) WHERE lead = 3)
    SELECT m, round(regr_slope(y, p) OVER () * p + regr_intercept(y, p) OVER (), 6) + 0e0 AS mean FROM t""")
def u2(v: Views):
    """The model contract: fit, save, load, predict with named outputs."""
    table = cut(feature_table(v, leads=(3,)).withColumn("x", F.array("y_persistence")))
    path = scratch_path(v.spark, "model")
    learners.LinearForecast(ridge=0.0).fit(table).save(path)
    model = learners.LinearForecastModel.load(path)
    return model.transform(table).select(F.col("m_target").alias("m"), r("mean").alias("mean"))


@query("u2_outputs", f"""WITH t AS (SELECT m, m_target, y, y * y AS q, y_persistence AS p FROM ({M1_SQL}) WHERE lead = 6),
    g AS (SELECT *, CASE WHEN i // (n // 5) < 5 THEN i // (n // 5) END AS seg FROM (SELECT *, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM t)),
    c AS (SELECT candidate, {_u("0", 'candidate', "'ridge'")} * 100e0 AS ridge FROM (SELECT unnest(range(0, 20))::INT AS candidate)),
    s AS (SELECT segment, covar_pop(y, p) * count(*) AS yp, covar_pop(q, p) * count(*) AS qp, var_pop(p) * count(*) AS pp, avg(p) AS mp, avg(y) AS my, avg(q) AS mq
        FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS segment) WHERE seg IS NULL OR seg <> segment GROUP BY 1),
    l AS (SELECT candidate, ridge, segment, avg(((y - my - yp / (pp + ridge) * (p - mp))^2 + (q - mq - qp / (pp + ridge) * (p - mp))^2) / 2e0) AS loss FROM g JOIN s ON g.seg = s.segment, c GROUP BY 1, 2, 3),
    b AS (SELECT min_by(ridge, loss) AS ridge, min(loss) AS loss FROM (SELECT candidate, ridge, avg(loss) AS loss FROM l GROUP BY 1, 2)),
    f AS (SELECT ridge, loss, covar_pop(y, p) * count(*) / (var_pop(p) * count(*) + ridge) AS cy, covar_pop(q, p) * count(*) / (var_pop(p) * count(*) + ridge) AS cq, avg(p) AS mp, avg(y) AS my, avg(q) AS mq FROM t, b GROUP BY 1, 2)
    SELECT m_target AS m, round(my + cy * (p - mp), 6) + 0e0 AS mean, round(mq + cq * (p - mp), 6) + 0e0 AS square, round(loss, 6) + 0e0 AS mean_val_loss FROM t, f""")
def u2_outputs(v: Views):
    """Two outputs from one solve, the penalty searched in a range; saved, loaded and applied."""
    table = cut(feature_table(v, leads=(6,)).withColumns({"x": F.array("y_persistence"), "q": F.col("y") * F.col("y")}))
    path = scratch_path(v.spark, "model")
    estimator = learners.LinearForecast(ridge=(0.0, 100.0), labelCols=["y", "q"], outputNames=["mean", "square"], nIter=20)
    estimator.fit(table).save(path)
    model = learners.LinearForecastModel.load(path)
    return model.predict(table).select(F.col("m_target").alias("m"), r("mean").alias("mean"), r("square").alias("square"),
                                       r(F.lit(model.mean_val_loss)).alias("mean_val_loss"))
