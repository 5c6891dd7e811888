"""Calendar, projection and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.functions import numeric as nm
from panelcast.operators import align, backtest, features
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs

K = pn.K
Q_ORD = pn.q_sql("o_orderdate")
Q_LABEL = pn.label_sql("q_idx")


def _resampled(how):
    def run(spark, d):
        o = pn.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "entity")
        return align.resample(o, K, "o_orderdate", "o_totalprice", how)

    return run


query(
    "quarterly_mean",
    f"""SELECT o_orderpriority AS entity, {Q_ORD} AS q_idx, {r('avg(o_totalprice)', 'value', 4)},
        {pn.label_sql(Q_ORD)} AS quarter FROM orders GROUP BY 1, 2, 4""", digits=4,
)(_resampled("mean"))

query(
    "quarterly_last",
    f"""WITH ranked AS (SELECT o_orderpriority AS entity, {Q_ORD} AS q_idx, o_totalprice AS value,
          row_number() OVER (PARTITION BY o_orderpriority, {Q_ORD}
                             ORDER BY o_orderdate DESC, o_totalprice DESC) AS k FROM orders)
        SELECT entity, q_idx, {r('value', 'value')}, {Q_LABEL} AS quarter FROM ranked WHERE k = 1""",
)(_resampled("last"))

query(
    "quarterly_sum",
    f"""SELECT o_orderpriority AS entity, {Q_ORD} AS q_idx, {r('sum(o_totalprice)', 'value', 2)},
        {pn.label_sql(Q_ORD)} AS quarter FROM orders GROUP BY 1, 2, 4""", digits=2,
)(_resampled("sum"))


@query(
    "quarterly_by_rule",
    f"""WITH rows AS (SELECT l_returnflag || l_linestatus AS entity, {pn.q_sql('l_shipdate')} AS q_idx,
          l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, {pn.q_sql('l_shipdate')}
                             ORDER BY l_shipdate DESC, l_quantity DESC) AS k FROM lineitem)
        SELECT entity, q_idx, {r("""CASE left(entity, 1) WHEN 'A' THEN avg(v) WHEN 'N' THEN max(v) FILTER (k = 1)
                                   ELSE sum(v) END""", 'value', 4)}, {Q_LABEL} AS quarter
        FROM rows GROUP BY 1, 2""", digits=4,
)
def quarterly_by_rule(spark, d):
    """Every series resampled by the rule its specification row names."""
    li = pn.table(spark, d, "lineitem").withColumn("entity", F.concat("l_returnflag", "l_linestatus"))
    flag = F.substring("entity", 1, 1)
    spec = li.select("entity").distinct().withColumn(
        "agg", F.when(flag == "A", "mean").when(flag == "N", "last").otherwise("sum")
    )
    return align.resample(li, K, "l_shipdate", "l_quantity", spec=spec)


@query(
    "merged_series",
    f"""WITH q AS (SELECT o_orderpriority AS entity, o_orderstatus AS s, {Q_ORD} AS q_idx, avg(o_totalprice) AS v
                   FROM orders GROUP BY 1, 2, 3)
        SELECT entity, q_idx, {r("max(v) FILTER (s = 'F')", 'F', 4)}, {r("max(v) FILTER (s = 'O')", 'O', 4)},
               {r("max(v) FILTER (s = 'P')", 'P', 4)}, {Q_LABEL} AS quarter FROM q GROUP BY 1, 2""", digits=4,
)
def merged_series(spark, d):
    """One series per order status merged on the quarter."""
    o = pn.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("entity"), F.col("o_orderstatus").alias("series_id"), "o_orderdate", "o_totalprice"
    )
    long = align.resample(o, [*K, "series_id"], "o_orderdate", "o_totalprice")
    return align.merge_series(long, K, ["F", "O", "P"])


@query(
    "segment_growth_panel",
    f"""WITH q AS (SELECT c_mktsegment AS segment, n_name AS nation, {Q_ORD} AS q_idx,
                          avg(o_totalprice) / 997 AS value
                   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
                   GROUP BY 1, 2, 3)
        SELECT segment, nation, q_idx, {Q_LABEL} AS quarter, {rs('value')},
               {r('(value - lag(value) OVER w) / lag(value) OVER w * 100', 'growth')},
               {r('value - lag(value, 4) OVER w', 'change_4')}
        FROM q WINDOW w AS (PARTITION BY segment, nation ORDER BY q_idx)""",
)
def segment_growth_panel(spark, d):
    """Flagship: quarterly mean order value per market segment and nation with growth and yearly change."""
    o = pn.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = pn.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment"))
    n = pn.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    keys = ["segment", "nation"]
    # orders shrink to one row per customer and quarter before the join, so a customer with most of the
    # orders costs the join no more than any other
    own = o.groupBy(F.col("o_custkey").alias("c_custkey"), cal.q_idx("o_orderdate").alias("q_idx")).agg(
        F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("c")
    )
    joined = own.join(c, "c_custkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    p = joined.groupBy(*keys, "q_idx").agg((F.sum("s") / F.sum("c") / 997).alias("value"))
    p = p.withColumn("quarter", cal.q_label("q_idx"))
    p = features.add_growth(p, keys, {"value": "growth"})
    return features.change_over(p, keys, "value", 4, "change_4").select(
        *keys, "q_idx", "quarter", "value", "growth", "change_4"
    )


@query(
    "labelled_sample",
    f"""WITH {pn.PRED}, tgt AS (SELECT entity, q_idx, value, value - lag(value) OVER (PARTITION BY entity ORDER BY q_idx) AS change FROM panel)
        SELECT t.entity, t.q_idx, {r('forecast', 'headline')}, {r('value', 'value')}, {r('change', 'change')},
               CASE WHEN change < 0 THEN 'cut' WHEN change = 0 THEN 'hold' ELSE 'hike' END AS action
        FROM pred p JOIN tgt t ON t.entity = p.entity AND t.q_idx = p.target_q
        WHERE model = 'last_value' AND horizon = 1 AND forecast IS NOT NULL AND change IS NOT NULL""",
)
def labelled_sample(spark, d):
    """One-step forecasts joined to the label of their target quarter."""
    from panelcast.operators.rules import label_change

    panel = features.add_change(pn.order_panel(spark, d).select("entity", "q_idx", "value"), K, {"value": "change"})
    panel = panel.withColumn("action", label_change(F.round("change", 9)))
    return align.labelled_sample(pn.predictions(spark, d), panel, K, "last_value", 1, "headline", ["change", "action"])


def outside_forecasts(spark, d):
    """Dated outside forecasts taken from single orders: horizon, forecast, own actual, own error."""
    o = pn.table(spark, d, "orders")
    return o.select(
        F.col("o_orderpriority").alias("entity"), F.col("o_orderdate").cast("date").alias("forecast_date"),
        (F.col("o_orderkey") % 6).cast("int").alias("horizon_quarters"),
        (F.col("o_totalprice") / 1000).alias("benchmark_forecast"),
        (F.col("o_custkey") / 10).alias("benchmark_actual"),
        (F.col("o_custkey") / 10 - F.col("o_totalprice") / 1000).alias("benchmark_reported_error"),
    )


BENCH = f"""bench AS (
  SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS forecast_date, {Q_ORD} AS origin_q,
         CAST(o_orderkey % 6 AS INTEGER) AS horizon_quarters, o_totalprice / 1000 AS benchmark_forecast,
         o_custkey / 10 AS benchmark_actual, o_custkey / 10 - o_totalprice / 1000 AS benchmark_reported_error
  FROM orders),
bench_last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, origin_q, horizon_quarters
     ORDER BY forecast_date DESC, benchmark_forecast DESC, benchmark_actual DESC) AS k FROM bench) WHERE k = 1),
aligned AS (
  SELECT g.entity, 'benchmark' AS model, g.origin_q, g.target_q, g.horizon, g.actual,
         b.benchmark_forecast AS forecast, g.actual - b.benchmark_forecast AS error, b.benchmark_actual,
         b.benchmark_reported_error
  FROM grid g JOIN bench_last b ON b.entity = g.entity AND b.origin_q = g.origin_q AND b.horizon_quarters = g.horizon)"""


@query(
    "benchmark_on_grid",
    f"""WITH {pn.PRED}, {BENCH}
        SELECT entity, model, origin_q, target_q, horizon,
               {rs('actual forecast error benchmark_actual benchmark_reported_error')} FROM aligned""",
)
def benchmark_on_grid(spark, d):
    """Outside forecasts placed on the model grid; the latest of a quarter and horizon wins."""
    grid = backtest.walk_forward(pn.order_panel(spark, d), K, "value", pn.INITIAL, pn.HORIZONS)
    return align.align_benchmark(outside_forecasts(spark, d), grid, K, pn.HORIZONS)


@query(
    "asof_complete_row",
    f"""WITH {pn.SPARSE}
        SELECT o.entity, o.q_idx AS origin_q, max(s.q_idx) AS asof_q, {r('arg_max(s.gappy, s.q_idx)', 'gappy')},
               {r('arg_max(s.late, s.q_idx)', 'late')}
        FROM sparse o LEFT JOIN sparse s ON s.entity = o.entity AND s.q_idx <= o.q_idx
             AND s.gappy IS NOT NULL AND s.late IS NOT NULL GROUP BY 1, 2""",
)
def asof_complete_row(spark, d):
    """Latest complete row at or before every quarter."""
    p = pn.sparse_panel(spark, d)
    return align.asof_latest(p, K, ["gappy", "late"], p.select("entity", F.col("q_idx").alias("origin_q")))


@query(
    "asof_with_fallback",
    f"""WITH {pn.SPARSE}, ok AS (SELECT * FROM sparse WHERE late IS NOT NULL),
        hit AS (SELECT o.entity, o.q_idx AS origin_q, max(s.q_idx) AS q FROM sparse o
                LEFT JOIN ok s ON s.entity = o.entity AND s.q_idx <= o.q_idx GROUP BY 1, 2),
        final AS (SELECT h.entity, origin_q, coalesce(q, (SELECT max(q_idx) FROM ok WHERE ok.entity = h.entity)) AS asof_q FROM hit h)
        SELECT f.entity, origin_q, asof_q, {r('late', 'late')} FROM final f LEFT JOIN ok ON ok.entity = f.entity AND ok.q_idx = asof_q""",
)
def asof_with_fallback(spark, d):
    """As above, but an origin before every complete row takes the latest complete row overall."""
    p = pn.sparse_panel(spark, d)
    origins = p.select("entity", F.col("q_idx").alias("origin_q"))
    return align.asof_latest(p, K, ["late"], origins, fallback=True)


@query(
    "target_inputs",
    f"""WITH {pn.SPARSE}
        SELECT t.entity, t.q_idx AS target_q, t.q_idx - 1 AS q_idx, {r('s.value', 'value')}, {r('s.gappy', 'gappy')},
               s.value IS NOT NULL AND s.gappy IS NOT NULL AS inputs_complete
        FROM sparse t LEFT JOIN sparse s ON s.entity = t.entity AND s.q_idx = t.q_idx - 1""",
)
def target_inputs(spark, d):
    """Inputs of the quarter before each target, flagged when missing."""
    p = pn.sparse_panel(spark, d)
    return align.origin_row(p, K, ["value", "gappy"], p.select("entity", F.col("q_idx").alias("target_q")))


@query(
    "tolerance_join",
    f"""WITH {pn.PANEL}, raw AS (SELECT o_orderpriority AS entity, {Q_ORD} AS q_idx, round(avg(o_totalprice) / 997, 2) AS exact FROM orders GROUP BY 1, 2)
        SELECT p.entity, p.q_idx, {r('value', 'value')}, {r('exact', 'exact', 6)} FROM panel p JOIN raw USING (entity, q_idx)
        WHERE abs(value - exact) <= 1e-8 + 1e-5 * abs(exact)""",
)
def tolerance_join(spark, d):
    """Equal keys and values equal within the float tolerance."""
    o = pn.table(spark, d, "orders")
    raw = o.groupBy(F.col("o_orderpriority").alias("entity"), cal.q_idx("o_orderdate").alias("q_idx")).agg(
        F.round(F.avg("o_totalprice") / 997, 2).alias("exact")
    )
    p = pn.order_panel(spark, d).select("entity", "q_idx", "value")
    return align.join_close(p, raw, [*K, "q_idx"], "value", "exact")


@query(
    "trailing_year",
    f"""WITH {pn.PANEL} SELECT o.entity, o.q_idx AS origin_q, count(*) AS n, {r('sum(s.value)', 'total')}
        FROM panel o JOIN panel s ON s.entity = o.entity AND s.q_idx <= o.q_idx AND s.q_idx > o.q_idx - 4 GROUP BY 1, 2""",
)
def trailing_year(spark, d):
    """Rows in the window (origin - 4, origin] of every origin."""
    p = pn.order_panel(spark, d).select("entity", "q_idx", "value")
    pairs = align.trailing_pairs(p.select("entity", F.col("q_idx").alias("origin_q")), p, K, "origin_q", "q_idx", 4)
    return pairs.groupBy("entity", "origin_q").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "paired_summaries",
    f"""WITH {pn.SPARSE}, a AS (SELECT entity, CAST(q_idx // 4 AS INTEGER) AS year, avg(value) AS avg_value FROM sparse GROUP BY 1, 2),
        b AS (SELECT entity, CAST(q_idx // 4 AS INTEGER) AS year, avg(late) AS avg_late FROM sparse WHERE late IS NOT NULL GROUP BY 1, 2)
        SELECT entity, year, {rs('avg_value avg_late')} FROM a LEFT JOIN b USING (entity, year)""",
)
def paired_summaries(spark, d):
    """One summary table looked up in another; years without a match stay."""
    from panelcast.operators.profile import annual_summary

    p = pn.sparse_panel(spark, d)
    return align.join_summaries(
        annual_summary(p, K, ["value"]), annual_summary(p.where("late is not null"), K, ["late"]), [*K, "year"]
    )


@query(
    "history_to_forecast",
    f"""WITH {pn.SEQ}, last AS (SELECT * FROM seq WHERE rn = n)
        SELECT entity, q_idx, {r('value', 'value')}, 'history' AS part FROM last
        UNION ALL SELECT l.entity, l.q_idx + CAST(h AS INTEGER), {r('s.value', 'value')}, 'forecast'
        FROM last l CROSS JOIN range(1, 5) AS g(h) JOIN seq s ON s.entity = l.entity AND s.rn = l.n - 3 + (h - 1) % 4""",
)
def history_to_forecast(spark, d):
    """Last observation of each entity followed by its seasonal-naive path."""
    p = pn.order_panel(spark, d)
    naive = backtest.seasonal_naive("value", K)
    w = align.over_time(K)
    path = p.withColumns(
        {"_p": F.array(*[naive(h) for h in pn.HORIZONS]), "_next": F.lead("q_idx").over(w)}
    ).where(F.col("_next").isNull())
    fc = path.select("entity", "q_idx", F.posexplode("_p").alias("i", "forecast")).withColumn(
        "target_q", (F.col("q_idx") + F.col("i") + 1).cast("int")
    )
    return align.bridge_history(p, fc, K, "value")


@query(
    "reconciled_values",
    f"""WITH {pn.PANEL}, raw AS (SELECT o_orderpriority AS entity, {Q_ORD} AS q_idx, avg(o_totalprice) / 997 AS derived FROM orders GROUP BY 1, 2)
        SELECT entity, q_idx, {r('derived', 'derived')}, {r('value', 'stored')}, abs(derived - value) <= 1e-8 + 1e-8 * abs(value) AS matches
        FROM raw FULL JOIN panel USING (entity, q_idx)""",
)
def reconciled_values(spark, d):
    """Values resampled again from raw rows against the stored panel, for every quarter."""
    o = pn.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "entity")
    derived = align.resample(o, K, "o_orderdate", "o_totalprice").withColumn("value", F.col("value") / 997)
    return align.reconcile(derived, pn.order_panel(spark, d), K)


@query(
    "missing_quarters",
    f"""WITH own AS (SELECT DISTINCT o_custkey, {Q_ORD} AS q_idx FROM orders),
        span AS (SELECT o_custkey, min(q_idx) AS a, max(q_idx) AS b FROM own GROUP BY 1),
        full_grid AS (SELECT o_custkey, CAST(unnest(range(a, b + 1)) AS INTEGER) AS q_idx FROM span)
        SELECT * FROM full_grid EXCEPT SELECT * FROM own""",
)
def missing_quarters(spark, d):
    """Quarters without an order between a customer's first and last one."""
    o = pn.table(spark, d, "orders").select("o_custkey", cal.q_idx("o_orderdate").alias("q_idx"))
    return align.calendar_gaps(o, ["o_custkey"])


@query(
    "quarter_calendar",
    f"""WITH q AS (SELECT DISTINCT {Q_ORD} AS q_idx FROM orders)
        SELECT q_idx, {Q_LABEL} AS quarter, make_date(q_idx // 4, q_idx % 4 * 3 + 1, 1) AS first_day,
               CAST(make_date(q_idx // 4, q_idx % 4 * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS last_day,
               CAST(h AS INTEGER) AS horizon, q_idx + CAST(h AS INTEGER) AS target_q,
               concat((q_idx + h) // 4, 'Q', (q_idx + h) % 4 + 1) AS target_quarter
        FROM q CROSS JOIN range(1, 9) AS g(h)""",
)
def quarter_calendar(spark, d):
    """Label, first and last day of every quarter and the eight quarters after it."""
    q = pn.table(spark, d, "orders").select(cal.q_idx("o_orderdate").alias("q_idx")).distinct()
    return cal.next_quarters(q, "q_idx", 8).select(
        "q_idx", cal.q_label("q_idx").alias("quarter"), cal.q_start("q_idx").alias("first_day"),
        cal.q_end("q_idx").alias("last_day"), "horizon", "target_q", cal.q_label("target_q").alias("target_quarter"),
    )


@query(
    "parsed_dates",
    f"""WITH texts AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {pn.label_sql(Q_ORD)}
                         WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS raw FROM orders)
        SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '[0-9]{{4}}Q[1-4]')
             THEN make_date(CAST(left(raw, 4) AS INTEGER), CAST(right(raw, 1) AS INTEGER) * 3 - 2, 1)
             ELSE TRY_CAST(raw AS DATE) END AS parsed FROM texts""",
)
def parsed_dates(spark, d):
    """Quarter labels and ISO dates in one text column; anything else is missing."""
    o = pn.table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, cal.q_label(cal.q_idx("o_orderdate"))).when(
        k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", raw.alias("raw")).withColumn("parsed", cal.parse_temporal("raw"))


@query(
    "orders_by_year",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders
       WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1""",
)
def orders_by_year(spark, d):
    """Inclusive year filter, pushed to the scan as a date range."""
    o = cal.filter_years(pn.table(spark, d, "orders").select("o_orderdate"), "o_orderdate", 1996, 1999)
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pinned_window",
    f"WITH {pn.PANEL} SELECT entity, q_idx, {r('value', 'value')} FROM panel WHERE q_idx <= 1999 * 4 + 3",
)
def pinned_window(spark, d):
    """Rows up to the analysis pin."""
    return cal.restrict_to_window(pn.order_panel(spark, d, last_q=1999 * 4 + 3), 1999 * 4 + 3).select("entity", "q_idx", "value")


TEXT_NUMBERS = """texts AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS k,
   CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS v FROM events)"""


@query(
    "numeric_rows",
    f"""WITH {TEXT_NUMBERS} SELECT event_id, {r('TRY_CAST(k AS DOUBLE)', 'k')}, {r('TRY_CAST(v AS DOUBLE)', 'v')} FROM texts
        WHERE TRY_CAST(k AS DOUBLE) IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NOT NULL""",
)
def numeric_rows(spark, d):
    """Text columns coerced to numbers, complete rows only."""
    e = pn.table(spark, d, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("user_id") % 7 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("k"),
        F.when(F.col("user_id") % 5 != 0, F.col("value").cast("string")).alias("v"),
    )
    return nm.numeric_complete(raw, ["k", "v"])


@query(
    "finite_ratios",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END', 'discount_per_tax')}
        FROM lineitem""",
)
def finite_ratios(spark, d):
    """Infinite and undefined ratios become missing."""
    li = pn.table(spark, d, "lineitem")
    x = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(
        F.lit(float("inf")))).otherwise(F.try_divide(F.col("l_discount"), F.col("l_tax")))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", x.alias("discount_per_tax"))
    return nm.scrub_inf(rows, ["discount_per_tax"])


@query(
    "horizon_labels",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 't+' || CAST(o_custkey % 9 AS VARCHAR)
                  WHEN 2 THEN 'T-' || CAST(o_custkey % 3 + 1 AS VARCHAR) ELSE o_orderstatus END AS label FROM orders)
       SELECT o_orderkey, label, CASE WHEN lower(label) = 't' THEN 0 WHEN regexp_full_match(lower(label), 't[+-][0-9]+')
              THEN CAST(replace(replace(lower(label), 't', ''), '+', '') AS INTEGER) END AS horizon FROM t""",
)
def horizon_labels(spark, d):
    """``t``, ``t+h`` and ``t-h`` labels to integers; other labels stay missing for the quality report."""
    o = pn.table(spark, d, "orders")
    k, s = F.col("o_orderkey") % 4, lambda e: e.cast("string")
    label = (
        F.when(k == 0, "t").when(k == 1, F.concat(F.lit("t+"), s(F.col("o_custkey") % 9)))
        .when(k == 2, F.concat(F.lit("T-"), s(F.col("o_custkey") % 3 + 1))).otherwise(F.col("o_orderstatus"))
    )
    return o.select("o_orderkey", label.alias("label")).withColumn("horizon", cal.horizon_label_to_int("label"))


@query(
    "parsed_flags",
    """WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN ' True ' WHEN toxic = 1 THEN 'YES' ELSE 'no' END AS raw FROM labels)
       SELECT doc_id, lower(trim(raw)) IN ('1', 'true', 'yes') AS flag FROM t""",
)
def parsed_flags(spark, d):
    """Text booleans."""
    lb = pn.table(spark, d, "labels")
    raw = F.when(F.col("quality") == 1, " True ").when(F.col("toxic") == 1, "YES").otherwise("no")
    return lb.select("doc_id", nm.parse_bool(raw).alias("flag"))


@query(
    "rounded_report",
    f"""WITH {pn.LINE} SELECT entity, q_idx, {r('price', 'price', 2)}, {r('quantity', 'quantity', 1)}, {r('tax', 'tax')} FROM line""",
)
def rounded_report(spark, d):
    """Different digits per report column."""
    p = pn.line_panel(spark, d).select("entity", "q_idx", "price", "quantity", "tax")
    return nm.round_report(p, {"price": 2, "quantity": 1})


@query(
    "gap_column",
    f"WITH {pn.LINE} SELECT entity, q_idx, {r('discount - tax', 'gap')} FROM line",
)
def gap_column(spark, d):
    """Difference of two columns."""
    return features.add_gap(pn.line_panel(spark, d), "discount", "tax", "gap").select("entity", "q_idx", "gap")
