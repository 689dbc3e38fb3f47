"""Pieces of DuckDB SQL shared by the oracle queries."""

from __future__ import annotations


def corr(x: str, y: str) -> str:
    """Pearson r, NULL where undefined."""
    ok = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"(covar_pop({y}, {x}) {ok} / nullif(stddev_pop({x}) {ok} * stddev_pop({y}) {ok}, 0))"


def p_value(r: str, n: str) -> str:
    """Two-sided p of r from n pairs: closed-form series terms through the gamma function."""
    df, c2 = f"({n} - 2)", f"greatest(1 - ({r}) * ({r}), 1e-300)"
    even = (f"coalesce(list_sum(list_transform(range(1, ({df} - 2) // 2 + 1), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1.0) - lgamma(0.5) + k * ln({c2})))), 0)")
    odd = (f"coalesce(list_sum(list_transform(range(1, ({df} - 3) // 2 + 1), lambda k: "
           f"exp(lgamma(1.5) + lgamma(k + 1.0) - lgamma(k + 1.5) + k * ln({c2})))), 0)")
    s = f"least(abs({r}), 1.0)"
    return (f"(CASE WHEN {r} IS NULL OR {df} < 1 THEN NULL WHEN {df} = 1 THEN 1 - 2 / pi() * asin({s}) "
            f"WHEN {df} % 2 = 1 THEN greatest(1 - 2 / pi() * (asin({s}) + {s} * sqrt({c2}) * (1 + {odd})), 0.0) "
            f"ELSE greatest(1 - {s} * (1 + {even}), 0.0) END)")


def normal_cdf(z: str) -> str:
    u = f"(abs({z}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.3275911e0 * {u}))"
    poly = f"((((1.061405429e0 * {t} - 1.453152027e0) * {t} + 1.421413741e0) * {t} - 0.284496736e0) * {t} + 0.254829592e0) * {t}"
    return f"(0.5e0 * (1e0 + sign({z}) * (1e0 - {poly} * exp(-{u} * {u}))))"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


def date(m: str) -> str:
    return f"make_date(({m}) // 12, ({m}) % 12 + 1, 1)"
