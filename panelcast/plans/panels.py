"""Shared inputs of the registered queries and their SQL counterparts.

Each panel is one scan with a map-side combined aggregation to (entity, quarter); everything downstream
works on that calendar-sized table. Values are scaled by a prime so that averages are never exact
decimal ties, which two engines may round differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.calendar import q_idx, restrict_dates
from panelcast.operators import backtest as bt
from panelcast.operators import intervals as iv
from panelcast.operators import rules
from panelcast.operators.align import over_time

K = ["entity"]
HORIZONS = [1, 2, 3, 4]
INITIAL = 8
MODELS = ["seasonal_naive", "last_value", "long_run_mean"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_sql(date: str) -> str:
    return f"CAST(year({date}) * 4 + quarter({date}) - 1 AS INTEGER)"


def label_sql(idx: str) -> str:
    return f"concat({idx} // 4, 'Q', {idx} % 4 + 1)"


def order_panel(spark: SparkSession, sf_dir: str, first_q: int | None = None, last_q: int | None = None) -> DataFrame:
    """Per order priority and quarter: mean price (thousands) and number of orders, of a range of quarters."""
    o = restrict_dates(table(spark, sf_dir, "orders"), "o_orderdate", first_q, last_q)
    return o.groupBy(F.col("o_orderpriority").alias("entity"), q_idx("o_orderdate").alias("q_idx")).agg(
        (F.avg("o_totalprice") / 997).alias("value"), F.count(F.lit(1)).alias("n_orders")
    )


PANEL = f"""panel AS (
  SELECT o_orderpriority AS entity, {q_sql('o_orderdate')} AS q_idx,
         avg(o_totalprice) / 997 AS value, count(*) AS n_orders
  FROM orders GROUP BY 1, 2)"""


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order panel with a column that has gaps and one that starts late."""
    return order_panel(spark, sf_dir).withColumns(
        {
            "gappy": F.when(F.col("n_orders") % 3 != 0, F.col("value")),
            "late": F.when(F.col("q_idx") >= 1997 * 4, F.col("value")),
        }
    )


SPARSE = f"""{PANEL}, sparse AS (
  SELECT *, CASE WHEN n_orders % 3 <> 0 THEN value END AS gappy,
         CASE WHEN q_idx >= 1997 * 4 THEN value END AS late FROM panel)"""


def line_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (return flag, line status) and ship quarter: mean price, quantity, discount, tax and rows."""
    li = table(spark, sf_dir, "lineitem")
    avg = lambda c, k: F.avg(c) * k / F.lit(0.997)
    return li.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("entity"), q_idx("l_shipdate").alias("q_idx")
    ).agg(
        (F.avg("l_extendedprice") / 997).alias("price"), avg("l_quantity", 1).alias("quantity"),
        avg("l_discount", 100).alias("discount"), avg("l_tax", 100).alias("tax"), F.count(F.lit(1)).alias("n_lines"),
    )


LINE = f"""line AS (
  SELECT l_returnflag || l_linestatus AS entity, {q_sql('l_shipdate')} AS q_idx,
         avg(l_extendedprice) / 997 AS price, avg(l_quantity) * 1 / CAST(0.997 AS DOUBLE) AS quantity,
         avg(l_discount) * 100 / CAST(0.997 AS DOUBLE) AS discount, avg(l_tax) * 100 / CAST(0.997 AS DOUBLE) AS tax,
         count(*) AS n_lines
  FROM lineitem GROUP BY 1, 2)"""

DRIVERS = ["quantity", "discount", "tax"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward predictions of three expression forecasters on the order panel."""
    p = order_panel(spark, sf_dir)
    return bt.walk_forward(
        p, K, "value", INITIAL, HORIZONS,
        {
            "seasonal_naive": bt.seasonal_naive("value", K), "last_value": bt.last_value("value", K),
            "long_run_mean": bt.long_run_mean("value", K),
        },
    )


SEQ = f"""{PANEL}, seq AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY q_idx) AS rn,
         count(*) OVER (PARTITION BY entity) AS n,
         avg(value) OVER (PARTITION BY entity ORDER BY q_idx ROWS UNBOUNDED PRECEDING) AS mean_so_far
  FROM panel)"""

PRED = f"""{SEQ}, grid AS (
  SELECT o.entity, o.q_idx AS origin_q, o.rn, CAST(h AS INTEGER) AS horizon, t.q_idx AS target_q,
         t.value AS actual, o.value AS at_origin, o.mean_so_far
  FROM seq o CROSS JOIN range(1, 5) AS g(h) JOIN seq t ON t.entity = o.entity AND t.rn = o.rn + h
  WHERE o.rn >= {INITIAL} AND o.rn <= o.n - 4),
forecasts AS (
  SELECT g.*, 'seasonal_naive' AS model, s.value AS forecast
  FROM grid g JOIN seq s ON s.entity = g.entity AND s.rn = g.rn - 3 + (g.horizon - 1) % 4
  UNION ALL SELECT g.*, 'last_value', at_origin FROM grid g
  UNION ALL SELECT g.*, 'long_run_mean', mean_so_far FROM grid g),
pred AS (
  SELECT entity, model, origin_q, target_q, horizon, actual, forecast, actual - forecast AS error
  FROM forecasts)"""


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of paired draws per origin and horizon: past changes added to the last value, past levels.

    Past values are collected over the origin's own history only, one entry per stored quarter.
    """
    p = order_panel(spark, sf_dir)
    w = over_time(K)
    past = w.rowsBetween(W.unboundedPreceding, 0)
    cells = []
    for h in HORIZONS:
        change = F.col("value") - F.lag("value", h).over(w)
        cells.append((h, F.when(change.isNotNull(), F.struct(
            F.col("q_idx").alias("draw_id"), change.alias("change"), F.col("value").alias("level")))))
    marked = p.withColumns(
        {"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(W.partitionBy(*K)),
         **{f"_c{h}": c for h, c in cells}}
    ).withColumns({f"_d{h}": F.collect_list(f"_c{h}").over(past) for h in HORIZONS})
    rows = marked.where((F.col("_rn") >= INITIAL) & (F.col("_rn") <= F.col("_n") - max(HORIZONS)))
    long = rows.select(
        "entity", F.col("q_idx").alias("origin_q"), "value",
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_d{h}").alias("d")) for h in HORIZONS])).alias("c"),
    ).select("entity", "origin_q", "value", "c.horizon", F.explode("c.d").alias("d"))
    kinds = F.array(
        F.struct(F.lit("history").alias("model"), (F.col("value") + F.col("d.change")).alias("value")),
        F.struct(F.lit("level").alias("model"), F.col("d.level").alias("value")),
    )
    return long.select("entity", "origin_q", "horizon", "d.draw_id", F.explode(kinds).alias("k")).select(
        "entity", "k.model", "origin_q", "draw_id", "horizon", "k.value"
    )


DRAWS = f"""{SEQ}, draws AS (
  SELECT o.entity, m.model, o.q_idx AS origin_q, s.q_idx AS draw_id, CAST(h AS INTEGER) AS horizon,
         CASE WHEN m.model = 'history' THEN o.value + (s.value - p.value) ELSE s.value END AS value
  FROM seq o CROSS JOIN range(1, 5) AS g(h) CROSS JOIN (VALUES ('history'), ('level')) AS m(model)
  JOIN seq s ON s.entity = o.entity AND s.rn <= o.rn
  JOIN seq p ON p.entity = s.entity AND p.rn = s.rn - h
  WHERE o.rn >= {INITIAL} AND o.rn <= o.n - 4)"""


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_panel(spark, sf_dir).select("entity", F.col("q_idx").alias("target_q"), F.col("value").alias("actual"))


def interval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.score_intervals(draws(spark, sf_dir), actuals(spark, sf_dir), K, 0.1, 0.9, bounded=True)


IVL = f"""{DRAWS}, raw_ivl AS (
  SELECT d.entity, d.model, d.origin_q, d.horizon, d.origin_q + d.horizon AS target_q, a.value AS actual,
         quantile_cont(d.value, 0.1) AS interval_lower, quantile_cont(d.value, 0.5) AS point_forecast,
         quantile_cont(d.value, 0.9) AS interval_upper
  FROM draws d JOIN panel a ON a.entity = d.entity AND a.q_idx = d.origin_q + d.horizon
  GROUP BY 1, 2, 3, 4, 5, 6),
ivl AS (
  SELECT *, interval_lower <= actual AND actual <= interval_upper AS hit,
         interval_upper - interval_lower AS interval_width,
         CASE WHEN actual = point_forecast THEN 0.0
              WHEN (CASE WHEN actual < point_forecast THEN point_forecast - interval_lower
                         ELSE interval_upper - point_forecast END) <= 1e-12 THEN CAST('inf' AS DOUBLE)
              ELSE abs(actual - point_forecast)
                   / (CASE WHEN actual < point_forecast THEN point_forecast - interval_lower
                           ELSE interval_upper - point_forecast END) END AS nonconformity_score
  FROM raw_ivl)"""


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision sample on the line panel: a headline around the target band, a rate, an activity change."""
    w = over_time(K)
    p = line_panel(spark, sf_dir).select(
        "entity", "q_idx", (F.col("quantity") - 23).alias("headline"),
        F.round("discount", 1).alias("rate"), "tax",
    )
    p = p.withColumns(
        {"rate_lag1": F.lag("rate").over(w), "activity": F.col("tax") - F.lag("tax").over(w)}
    )
    p = p.withColumn("rate_change", F.round(F.col("rate") - F.col("rate_lag1"), 4))
    p = p.withColumn("actual_action", rules.label_change(F.col("rate_change")))
    return p.drop("tax").dropna(subset=["rate_lag1", "activity"])


POLICY = f"""{LINE}, policy0 AS (
  SELECT entity, q_idx, quantity - 23 AS headline, round(discount, 1) AS rate,
         lag(round(discount, 1)) OVER w AS rate_lag1, tax - lag(tax) OVER w AS activity
  FROM line WINDOW w AS (PARTITION BY entity ORDER BY q_idx)),
policy AS (
  SELECT *, round(rate - rate_lag1, 4) AS rate_change,
         CASE WHEN round(rate - rate_lag1, 4) < 0 THEN 'cut' WHEN round(rate - rate_lag1, 4) = 0 THEN 'hold'
              ELSE 'hike' END AS actual_action
  FROM policy0 WHERE rate_lag1 IS NOT NULL AND activity IS NOT NULL)"""
