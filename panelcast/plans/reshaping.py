"""Reshape queries: wide, long and nested."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal
from panelcast.operators import draws as dr
from panelcast.operators import reshape as rs_
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs

K = pn.K


@query(
    "long_drivers",
    f"""WITH {pn.LINE} SELECT entity, q_idx, variable, {r('value', 'value')} FROM
        (UNPIVOT line ON quantity, discount, tax INTO NAME variable VALUE value)""",
)
def long_drivers(spark, d):
    """Driver columns to long rows."""
    return rs_.to_long(pn.line_panel(spark, d), ["entity", "q_idx"], pn.DRIVERS)


@query(
    "wide_statuses",
    f"""SELECT o_orderpriority AS entity, {pn.q_sql('o_orderdate')} AS q_idx, {r("sum(o_totalprice) FILTER (o_orderstatus = 'F')", 'F', 2)},
        {r("sum(o_totalprice) FILTER (o_orderstatus = 'O')", 'O', 2)}, {r("sum(o_totalprice) FILTER (o_orderstatus = 'P')", 'P', 2)}
        FROM orders GROUP BY 1, 2""", digits=2,
)
def wide_statuses(spark, d):
    """Long to wide with the value list known up front."""
    o = pn.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("entity"), cal.q_idx("o_orderdate").alias("q_idx"), "o_orderstatus", "o_totalprice"
    )
    return rs_.to_wide(o, ["entity", "q_idx"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "sum")


@query(
    "tidy_horizon_matrices",
    f"""WITH base AS (SELECT CAST(o_orderdate AS DATE) AS forecast_date, o_orderkey % 4 AS h, max(o_totalprice) AS f, min(o_totalprice) AS a, max(o_orderpriority) AS source
                     FROM orders GROUP BY 1, 2),
        f AS (SELECT forecast_date, h, f FROM base), a AS (SELECT forecast_date, h, a FROM base WHERE h <> 2),
        src AS (SELECT forecast_date, max(source) AS source FROM base GROUP BY 1)
        SELECT s.forecast_date, CASE k.h WHEN 0 THEN 't' ELSE concat('t+', k.h) END AS horizon_label, source,
               {r('f.f', 'forecast', 2)}, {r('a.a', 'actual', 2)}, CAST(k.h AS INTEGER) AS horizon_quarters
        FROM src s CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(h)
        LEFT JOIN f ON f.forecast_date = s.forecast_date AND f.h = k.h LEFT JOIN a ON a.forecast_date = s.forecast_date AND a.h = k.h""",
    digits=2,
)
def tidy_horizon_matrices(spark, d):
    """Forecast and actual matrices over ``t+h`` columns to one row per date and horizon."""
    o = pn.table(spark, d, "orders")
    date = F.col("o_orderdate").cast("date")
    label = lambda h: "t" if h == 0 else f"t+{h}"
    cell = lambda agg, h: agg(F.when(F.col("o_orderkey") % 4 == h, F.col("o_totalprice"))).alias(label(h))
    f = o.groupBy(date.alias("forecast_date")).agg(F.max("o_orderpriority").alias("source"), *[cell(F.max, h) for h in range(4)])
    a = o.groupBy(date.alias("forecast_date")).agg(*[cell(F.min, h) for h in (0, 1, 3)])
    return rs_.tidy_horizon_matrices({"forecast": f, "actual": a})


@query(
    "ratio_rows",
    f"""WITH s AS (SELECT o_orderpriority AS m, {pn.q_sql('o_orderdate')} AS q_idx, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS v
                   FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY 1, 2),
        t AS (SELECT * FROM s WHERE q_idx >= 1996 * 4)
        SELECT q_idx, {r('v * 100', 'ratio_percent')}, m AS source_measure, CASE left(m, 1) WHEN '1' THEN 'urgent basis' ELSE 'high basis' END AS measurement_basis,
               count(*) OVER (PARTITION BY q_idx) AS measures_in_quarter, {pn.label_sql('q_idx')} AS quarter FROM t""",
)
def ratio_rows(spark, d):
    """Ratio rows across period columns to long percent rows with basis labels."""
    o = pn.table(spark, d, "orders").select(
        F.concat(F.lit(" "), "o_orderpriority").alias("measure"), cal.q_label(cal.q_idx("o_orderdate")).alias("quarter"),
        (F.col("o_orderstatus") == "F").cast("double").alias("v"),
    )
    periods = [r.quarter for r in o.select("quarter").distinct().orderBy("quarter").collect()]  # the quarters there are
    wide = rs_.to_wide(o, ["measure"], "quarter", "v", periods, "avg")
    return rs_.tidy_ratio_rows(
        wide, "measure", {"1-URGENT": "urgent basis", "2-HIGH": "high basis"}, 1996 * 4, periods
    )


@query(
    "exploded_forecasts",
    f"""WITH {pn.PRED} SELECT entity, model, origin_q, horizon, target_q, {rs('forecast actual')} FROM pred""",
)
def exploded_forecasts(spark, d):
    """Parallel arrays per model and origin flattened to one row per step."""
    p = pn.predictions(spark, d)
    cell = F.array_sort(F.collect_list(F.struct("horizon", "target_q", "forecast", "actual")))
    nested = p.groupBy("entity", "model", "origin_q").agg(cell.alias("c")).select(
        "entity", "model", "origin_q", F.col("c.target_q").alias("quarters"), F.col("c.forecast").alias("points"),
        F.col("c.actual").alias("outcomes"),
    )
    return rs_.explode_arrays(
        nested, ["entity", "model", "origin_q"], {"quarters": "target_q", "points": "forecast", "outcomes": "actual"}
    )


@query(
    "exploded_scenarios",
    f"""WITH s AS (SELECT c_mktsegment AS segment, sum(c_acctbal) AS ead FROM customer GROUP BY 1),
        w AS (SELECT * FROM (VALUES ('base', 0.55, 0.0), ('downside', 0.425, 2.0), ('upside', 0.025, -1.0)) AS v(scenario, weight, delta))
        SELECT segment, scenario, {r('ead * (1 + CAST(delta AS DOUBLE) / 10)', 'exposure', 2)}, {r('ead * CAST(weight AS DOUBLE)', 'weighted', 2)},
               CAST(weight AS DOUBLE) AS weight FROM s CROSS JOIN w""", digits=3,
)
def exploded_scenarios(spark, d):
    """Maps keyed by scenario to rows, with scenario attributes joined."""
    c = pn.table(spark, d, "customer")
    s = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("c_acctbal").alias("ead"))
    # fixed values: scenario weights and changes of the example stress test
    defs = {"base": (0.55, 0.0), "downside": (0.425, 2.0), "upside": (0.025, -1.0)}
    pairs = lambda f: F.create_map(*[x for n, v in defs.items() for x in (F.lit(n), f(*v))])
    nested = s.select(
        "segment", pairs(lambda w, x: F.round(F.col("ead") * (1 + F.lit(x) / 10), 2)).alias("by_exposure"),
        pairs(lambda w, x: F.round(F.col("ead") * F.lit(w), 2)).alias("by_weight"),
    )
    attributes = spark.createDataFrame([(n, v[0]) for n, v in defs.items()], "scenario string, weight double")
    return rs_.explode_scenarios(
        nested, ["segment"], {"by_exposure": "exposure", "by_weight": "weighted"}, attributes
    )


@query(
    "payload_rows",
    """SELECT event_id AS origin, event_type AS action, CAST(json_extract(props, '$.k') AS INTEGER) AS model_id, m.name
       FROM events CROSS JOIN (VALUES ('a'), ('b')) AS m(name)""",
)
def payload_rows(spark, d):
    """A JSON payload per event: its items as rows, the shared context repeated."""
    e = pn.table(spark, d, "events")
    item = lambda n: F.struct(F.get_json_object("props", "$.k").cast("int").alias("model_id"), F.lit(n).alias("name"))
    payload = F.to_json(F.struct(
        F.col("event_id").alias("origin"), F.col("event_type").alias("action"), F.array(item("a"), item("b")).alias("models")
    ))
    schema = "origin bigint, action string, models array<struct<model_id: int, name: string>>"
    return rs_.explode_payload(e.select(payload.alias("p")), "p", schema, ["origin", "action"], "models")


@query(
    "stacked_predictions",
    f"""WITH {pn.PRED} SELECT entity, model, origin_q, target_q, horizon, {rs('actual forecast error')}, CAST(NULL AS DOUBLE) AS note FROM pred WHERE model <> 'last_value'
        UNION ALL SELECT entity, model, origin_q, target_q, horizon, {rs('actual forecast error')}, 1.0 FROM pred WHERE model = 'last_value'""",
)
def stacked_predictions(spark, d):
    """Prediction tables with different columns stacked; absent columns are missing."""
    p = pn.predictions(spark, d)
    a = p.where("model <> 'last_value'")
    b = p.where("model = 'last_value'").withColumn("note", F.lit(1.0))
    cols = ["entity", "model", "origin_q", "target_q", "horizon", "actual", "forecast", "error", "note"]
    return rs_.stack_predictions([a, b], cols)


@query(
    "model_union",
    f"WITH {pn.PRED} SELECT model, count(*) AS n, {r('sum(forecast)', 'total', 4)} FROM pred GROUP BY 1", digits=4,
)
def model_union(spark, d):
    """Union of per-model outputs, counted per model."""
    p = pn.predictions(spark, d)
    u = rs_.stack_predictions([p.where(F.col("model") == m) for m in pn.MODELS])
    return u.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("forecast").alias("total"))


def responses(spark, d):
    """A response tensor per (return flag) from line averages: [horizon][response][shock]."""
    p = pn.line_panel(spark, d).groupBy("entity").agg(*[F.avg(c).alias(c) for c in pn.DRIVERS])
    cells = lambda h: F.array(*[F.array(*[F.col(a) / F.col(b) / (h + 1) for b in pn.DRIVERS]) for a in pn.DRIVERS])
    return p.select("entity", F.array(*[cells(h) for h in range(4)]).alias("tensor"))


RESP = f"""{pn.LINE}, m AS (SELECT entity, avg(quantity) AS quantity, avg(discount) AS discount, avg(tax) AS tax FROM line GROUP BY 1),
 ml AS (SELECT entity, variable, value FROM (UNPIVOT m ON quantity, discount, tax INTO NAME variable VALUE value)),
 irf AS (SELECT a.entity, CAST(h AS INTEGER) AS horizon, a.variable AS response, b.variable AS shock, a.value / b.value / (h + 1) AS value
         FROM ml a JOIN ml b USING (entity) CROSS JOIN range(0, 4) AS g(h))"""


@query("nested_responses", f"WITH {RESP} SELECT entity, horizon, response, shock, {r('value', 'value')} FROM irf")
def nested_responses(spark, d):
    """A nested [horizon][response][shock] array to long rows."""
    return rs_.nested_to_long(responses(spark, d), K, "tensor", pn.DRIVERS, pn.DRIVERS)


@query(
    "response_convolution",
    f"""WITH {RESP}, sh AS (SELECT entity, variable AS shock, q_idx, value FROM (UNPIVOT (SELECT entity, q_idx, quantity, discount, tax FROM line) ON quantity, discount, tax INTO NAME variable VALUE value)),
        e AS (SELECT entity, max(q_idx) AS last_q FROM sh GROUP BY 1)
        SELECT s.entity, s.q_idx + i.horizon AS q_idx, i.response, i.shock, {r('sum(i.value * s.value)', 'contribution')}
        FROM sh s JOIN irf i ON i.entity = s.entity AND i.shock = s.shock JOIN e ON e.entity = s.entity
        WHERE s.q_idx + i.horizon <= last_q GROUP BY 1, 2, 3, 4""",
)
def response_convolution(spark, d):
    """Contribution of past shocks to every quarter through their responses."""
    irf = rs_.nested_to_long(responses(spark, d), K, "tensor", pn.DRIVERS, pn.DRIVERS)
    shocks = rs_.to_long(pn.line_panel(spark, d), ["entity", "q_idx"], pn.DRIVERS).withColumnRenamed("variable", "shock")
    return dr.convolve(irf, shocks, K)
