"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; floating results are rounded to ``digits`` places."""

    def wrap(fn: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; adding 0.0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def r(expr: str, alias: str, digits: int = 6) -> str:
    """SQL counterpart of ``rounded`` for one expression."""
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def binomial_sql(source: str, ids: str, p: str) -> str:
    """CTEs ``ci(ids, lower, upper)`` by bisection and ``pv(ids, p_value)`` by enumeration from (ids, n, hits)."""
    pmf = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q}) + (n - i) * ln(1 - {q}))"
    tail = lambda a, b, q: f"(SELECT coalesce(sum({pmf.format(q=q)}), 0) FROM (SELECT unnest(range({a}, {b})) AS i))"
    ml, mu = "((lo + hi) / 2)", "((lo2 + hi2) / 2)"
    return f"""bis AS (SELECT *, 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, CAST(0 AS DOUBLE) AS lo2, CAST(1 AS DOUBLE) AS hi2 FROM (SELECT {ids}, n, hits FROM {source})
     UNION ALL SELECT {ids}, n, hits, step + 1, CASE WHEN {tail('hits', 'n + 1', ml)} < 0.025 THEN {ml} ELSE lo END, CASE WHEN {tail('hits', 'n + 1', ml)} < 0.025 THEN hi ELSE {ml} END,
       CASE WHEN {tail('0', 'hits + 1', mu)} > 0.025 THEN {mu} ELSE lo2 END, CASE WHEN {tail('0', 'hits + 1', mu)} > 0.025 THEN hi2 ELSE {mu} END FROM bis WHERE step < 45),
   ci AS (SELECT {ids}, CASE WHEN hits = 0 THEN 0 ELSE (lo + hi) / 2 END AS lower, CASE WHEN hits = n THEN 1 ELSE (lo2 + hi2) / 2 END AS upper FROM bis WHERE step = 45),
   pm AS (SELECT {ids}, n, hits, i, {pmf.format(q=p)} AS f FROM (SELECT {ids}, n, hits, unnest(range(0, n + 1)) AS i FROM {source})),
   pv AS (SELECT {ids}, least(1.0, sum(f) FILTER (f <= bar * (1 + 1e-7))) AS p_value FROM pm JOIN (SELECT {ids}, f AS bar FROM pm WHERE i = hits) USING ({ids}) GROUP BY {ids})"""


def normal_cdf_sql(z: str) -> str:
    """Normal CDF by its all-positive series in |z|."""
    half = f"""exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 400), lambda k: exp((2 * k + 1) * ln(abs({z})) + k * ln(2.0::DOUBLE) + lgamma(k + 1) - lgamma(2 * k + 2))))"""
    return f"(0.5 + sign({z}) * ({half}))"


def rs(names: str, digits: int = 6) -> str:
    """Rounded select list for plain columns, e.g. ``rs("rmse mae")``."""
    return ", ".join(r(n, n, digits) for n in names.split())
