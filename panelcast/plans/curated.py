"""The curated build: from raw orders to the published table and its quality table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import curated as cu
from panelcast.operators.backtest import order_by_model
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r
from panelcast.sources import series, sinks, stage

K = pn.K
RECIPE = cu.Recipe(
    series=["F", "O", "P"], growth={"F": "F_growth", "O": "O_growth"}, lags={"F": [1, 2], "P": [1]}, squares=["F_growth"], products=[("F_lag1", "P_lag1")],
)
CONTRACT = T.StructType([T.StructField("q_idx", T.IntegerType(), False), T.StructField("F", T.DoubleType()), T.StructField("absent", T.DoubleType())])


def raw_orders(spark, d):
    o = pn.table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("entity"), F.col("o_orderstatus").alias("series_id"), "o_orderdate", (F.col("o_totalprice") / 997).alias("price"))


def busy_quarters(spark, d):
    """Event table: quarters that begin an even year."""
    q = pn.order_panel(spark, d).select("q_idx").distinct().where("q_idx % 8 = 0")
    return q.select("q_idx", F.lit("even_year").alias("dummy_name"), F.lit(1).alias("lead_quarters"))


CURATED = f"""m AS (SELECT o_orderpriority AS entity, {pn.q_sql('o_orderdate')} AS q_idx, avg(o_totalprice / 997) FILTER (o_orderstatus = 'F') AS f,
     avg(o_totalprice / 997) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice / 997) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1, 2),
  cur AS (SELECT entity, q_idx, f, o, p, (f - lag(f) OVER w) / nullif(lag(f) OVER w, 0) * 100 AS fg, (o - lag(o) OVER w) / nullif(lag(o) OVER w, 0) * 100 AS og,
     lag(f) OVER w AS f1, lag(f, 2) OVER w AS f2, lag(p) OVER w AS p1, CASE WHEN q_idx % 8 = 0 THEN 1 ELSE 0 END AS e FROM m WINDOW w AS (PARTITION BY entity ORDER BY q_idx))"""


@query(
    "curated_build",
    f"""WITH {CURATED} SELECT entity, q_idx, {pn.label_sql('q_idx')} AS quarter, {r('f', 'F')}, {r('o', 'O')}, {r('p', 'P')}, {r('fg', 'F_growth')}, {r('og', 'O_growth')}, {r('f1', 'F_lag1')}, {r('f2', 'F_lag2')},
        {r('p1', 'P_lag1')}, {r('fg * fg', 'F_growth_sq', 4)}, {r('f1 * p1', 'F_lag1_x_P_lag1')}, e AS even_year_lag1 FROM cur""",
)
def curated_build(spark, d):
    """Resample, merge, growth, lags, products, dummies, checks, gate and publish; the table read back."""
    raw = raw_orders(spark, d)
    daily = raw.groupBy("entity", "series_id", "o_orderdate").agg(F.sum("price").alias("_s"), F.count(F.lit(1)).alias("_n"))
    out = cu.curate(raw, K, "o_orderdate", "price", RECIPE, busy_quarters(spark, d))
    # one row per day in the source report: an order date occurs in many orders
    check = lambda staged: cu.quality_table(daily.withColumn("price", F.col("_s") / F.col("_n")), staged, K, "o_orderdate", "price", "F", ["q_idx", "F"], 1)
    folder = stage.fresh_folder(spark)
    sinks.publish_if_clean(out, check, folder)
    return sinks.read_published(spark, folder).withColumn("F_growth_sq", F.round("F_growth_sq", 4))


COLS = ["F", "O", "P", "F_growth", "O_growth", "F_lag1", "F_lag2", "P_lag1", "F_growth_sq", "F_lag1_x_P_lag1", "even_year_lag1"]
EXPR = ["f", "o", "p", "fg", "og", "f1", "f2", "p1", "fg * fg", "f1 * p1", "e"]


@query(
    "curated_quality",
    f"""WITH {CURATED}, src AS (SELECT o_orderpriority AS entity, concat('source:', o_orderstatus) AS dataset, count(*) AS n, count(*) - count(DISTINCT CAST(o_orderdate AS DATE)) AS dup,
            min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1, 2),
        c AS (SELECT entity, count(*) AS n, min(q_idx) AS a, max(q_idx) AS b, count(f) AS use, {' + '.join(f'count(*) - count({e})' for e in EXPR)} AS miss FROM cur GROUP BY 1),
        u AS (SELECT entity, x.name, count(x.v) AS n, count(*) - count(x.v) AS miss, (count(*) - count(x.v)) / count(*) AS share FROM cur, LATERAL (VALUES {', '.join(f"('{n}', CAST({e} AS DOUBLE))" for n, e in zip(COLS, EXPR))}) AS x(name, v) GROUP BY 1, 2)
        SELECT entity, dataset, CASE WHEN dup > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS rows, CAST(2 AS BIGINT) AS columns, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date,
               CAST(0 AS BIGINT) AS missing_values, dup AS duplicate_dates, CASE WHEN dup > 0 THEN concat(dup, ' duplicate dates') ELSE 'ok' END AS notes FROM src
        UNION ALL SELECT entity, 'curated', CASE WHEN use < 8 THEN 'FAIL' WHEN b - a + 1 > n THEN 'WARNING' ELSE 'PASS' END, n, CAST({len(COLS) + 2} AS BIGINT), {pn.label_sql('a')}, {pn.label_sql('b')}, miss, 0,
               coalesce(nullif(concat_ws('; ', CASE WHEN use < 8 THEN 'F usable rows below minimum 8' END, CASE WHEN b - a + 1 > n THEN concat(b - a + 1 - n, ' missing quarters in date range') END), ''), 'ok') FROM c
        UNION ALL SELECT entity, concat('column:', name), CASE WHEN share > 0.5 THEN 'WARNING' ELSE 'PASS' END, n, 1, '', '', miss, 0, CASE WHEN share > 0.5 THEN concat(printf('%.1f', share * 100), '% missing after quarterly merge') ELSE 'ok' END FROM u
        UNION ALL SELECT NULL, concat('contract:', name), s, (SELECT count(*) FROM cur), 1, '', '', 0, 0, t FROM (VALUES ('q_idx', 'PASS', 'ok'), ('F', 'PASS', 'ok'), ('absent', 'FAIL', 'column is absent')) AS v(name, s, t)""",
)
def curated_quality(spark, d):
    """Nine-field records of every source series, the curated table, its columns and its contract, stacked."""
    raw = raw_orders(spark, d)
    out = cu.curate(raw, K, "o_orderdate", "price", RECIPE, busy_quarters(spark, d))
    return cu.quality_table(raw, out, K, "o_orderdate", "price", "F", ["q_idx", "F"], 8, contract=CONTRACT)


@query(
    "label_quality",
    """WITH t AS (SELECT o_orderpriority AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 't' WHEN o_orderkey % 3 = 1 THEN 't+2' WHEN o_orderpriority = '2-HIGH' THEN 'T - 1' WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS label FROM orders)
       SELECT entity, 'labels' AS dataset, CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS rows, CAST(1 AS BIGINT) AS columns, '' AS start_date, '' AS end_date, miss AS missing_values, CAST(0 AS BIGINT) AS duplicate_dates,
              CASE WHEN bad > 0 THEN concat(bad, ' unreadable horizon labels') ELSE 'ok' END AS notes
       FROM (SELECT entity, count(*) AS n, count(*) - count(label) AS miss, count(*) FILTER (label IN ('F', 'O', 'P')) AS bad FROM t GROUP BY 1)""",
)
def label_quality(spark, d):
    """Horizon labels that cannot be read give FAIL records for the gate."""
    o, k = pn.table(spark, d, "orders"), F.col("o_orderkey") % 3
    label = F.when(k == 0, "t").when(k == 1, "t+2").when(F.col("o_orderpriority") == "2-HIGH", "T - 1").when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    return cu.label_records(o.select(F.col("o_orderpriority").alias("entity"), label.alias("label")), K, "label", "labels")


@query(
    "undated_source",
    """SELECT o_orderpriority AS entity, 'FAIL' AS status, count(*) AS rows, CAST(1 AS BIGINT) AS columns, '' AS start_date, '' AS end_date, CAST(0 AS BIGINT) AS missing_values, CAST(0 AS BIGINT) AS duplicate_dates,
       'missing date column: date' AS notes FROM orders GROUP BY 1""",
)
def undated_source(spark, d):
    """A source without its date column gives a FAIL record, not an exception."""
    from panelcast.operators.quality import check_series

    return check_series(pn.table(spark, d, "orders").select(F.col("o_orderpriority").alias("entity"), "o_totalprice"), K, "date", ["o_totalprice"])


@query(
    "newest_downloads",
    f"""WITH l AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END AS series, {pn.q_sql('o_orderdate')} AS q_idx, max(year(o_orderdate)) OVER (PARTITION BY CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE 'open' END) AS last, year(o_orderdate) AS y, o_totalprice / 997 AS v FROM orders)
        SELECT series, q_idx, count(*) AS n, {r('sum(v)', 'total', 3)} FROM l WHERE y = last GROUP BY 1, 2""", digits=3,
)
def newest_downloads(spark, d):
    """Yearly files of two series written to a directory; only the newest of each is read back."""
    o = pn.table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "filled").otherwise("open")
    rows = o.groupBy(kind.alias("series"), F.year("o_orderdate").alias("y"), pn.q_idx("o_orderdate").alias("q_idx")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") / 997).alias("total"))
    folder, rows = stage.fresh_folder(spark), stage.staged(rows)
    names = [(r.series, r.y) for r in rows.select("series", "y").distinct().collect()]  # one folder of files per series and year
    for s, y in names:
        rows.where((F.col("series") == s) & (F.col("y") == y)).select("q_idx", "n", "total").coalesce(1).write.option("header", True).csv(f"{folder}/{s}_1992_{y}.csv")
    out = series.read_latest(spark, folder, "q_idx int, n bigint, total double", folders=True)
    return out.select("series", "q_idx", "n", "total")


@query(
    "saved_tables",
    f"""WITH {pn.SPARSE} SELECT 'table:panel' AS dataset, 'PASS' AS status, count(*) AS rows, CAST(6 AS BIGINT) AS columns, 2 * count(*) - count(gappy) - count(late) AS missing_values, 'ok' AS notes FROM sparse""",
)
def saved_tables(spark, d):
    """The panel saved to a database of the session's warehouse, with its load record."""
    folder = stage.fresh_folder(spark)
    name = "curated_" + folder.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return sinks.publish_tables({"panel": pn.sparse_panel(spark, d)}, name)


@query(
    "models_in_order",
    f"""WITH {pn.PRED}, n AS (SELECT entity, model, CAST(horizon AS INTEGER) AS horizon, count(*) AS n FROM pred GROUP BY 1, 2, 3)
        SELECT entity, model, horizon, n, row_number() OVER (ORDER BY entity, model, horizon) - 1 AS place FROM n""",
)
def models_in_order(spark, d):
    """A metric table in the order of a report: keys, model, horizon; the place is read from the ordered rows."""
    counts = pn.predictions(spark, d).groupBy("entity", "model", "horizon").agg(F.count(F.lit(1)).alias("n"))
    ordered = order_by_model(counts, K).coalesce(1)  # a report of entities x models x horizons
    return ordered.withColumn("place", F.monotonically_increasing_id())
