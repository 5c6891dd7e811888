"""Data-quality and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import calendar as cal
from panelcast.operators import quality as ql
from panelcast.plans import panels as pn
from panelcast.plans.registry import query, r, rs
from panelcast.sources import series, sinks, stage
from panelcast.sources import upsert as up

K = pn.K

RAW = """raw AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' AND value > 90 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
   CASE WHEN event_type = 'click' AND value > 80 THEN event_type WHEN event_type = 'view' AND value < 5 THEN NULL ELSE CAST(value AS VARCHAR) END AS value_text, value FROM events)"""


def raw_events(spark, d):
    """Event dates and values as text with some unreadable dates, words and gaps."""
    e = pn.table(spark, d, "events")
    t, v = F.col("event_type"), F.col("value")
    return e.select(
        "user_id",
        F.when((t == "error") & (v > 90), "bad").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date_text"),
        F.when((t == "click") & (v > 80), t).when((t == "view") & (v < 5), F.lit(None)).otherwise(v.cast("string")).alias("value_text"),
    )


def _note(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} END"


SERIES = f"""{RAW}, typed AS (SELECT user_id, event_id, TRY_CAST(date_text AS DATE) AS d, value_text, TRY_CAST(value_text AS DOUBLE) AS v FROM raw),
  ordered AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM typed WHERE d IS NOT NULL),
  back AS (SELECT user_id, bool_or(coalesce(d < prev, false)) AS unsorted FROM ordered GROUP BY 1),
  agg AS (SELECT user_id, count(*) AS rows, count(*) FILTER (d IS NULL) AS invalid, count(*) - count(DISTINCT coalesce(d, DATE '1000-01-01')) AS dup,
     min(d) AS a, max(d) AS b, count(*) FILTER (value_text IS NOT NULL AND v IS NULL) AS bad, count(*) FILTER (value_text IS NULL) AS miss,
     count(*) FILTER (v < 0 OR v > 100) AS outside, count(*) FILTER (d > DATE '2024-01-28') AS future,
     max(year(d) * 4 + quarter(d)) - min(year(d) * 4 + quarter(d)) + 1 - count(DISTINCT year(d) * 4 + quarter(d)) AS gap FROM typed GROUP BY 1),
  f AS (SELECT agg.*, coalesce(unsorted, false) AS unsorted FROM agg LEFT JOIN back USING (user_id))"""

FAILS = "(rows < 100 OR invalid > 0 OR dup > 0 OR bad > 0)"
PARTS = [
    _note("rows < 100", "'row count below minimum 100'"), _note("invalid > 0", "concat(invalid, ' invalid date values')"),
    _note("dup > 0", "concat(dup, ' duplicate dates')"), _note("unsorted", "'dates are not sorted'"),
    _note("bad > 0", "concat('value_text has ', bad, ' non-numeric values')"),
    _note(f"miss > 0 AND NOT {FAILS} AND NOT unsorted", "concat(miss, ' missing values')"),
]
EXTRA = [
    _note("gap > 0", "concat(gap, ' missing quarters in date range')"), _note("future > 0", "concat(future, ' future date values')"),
    _note("outside > 0", "concat('value_text has ', outside, ' values outside 0-100 percent')"),
]


def _series_sql(parts, fails, warns):
    return f"""WITH {SERIES} SELECT user_id, CASE WHEN {fails} THEN 'FAIL' WHEN {warns} THEN 'WARNING' ELSE 'PASS' END AS status, rows,
       CAST(2 AS BIGINT) AS columns, coalesce(CAST(a AS VARCHAR), '') AS start_date, coalesce(CAST(b AS VARCHAR), '') AS end_date, miss AS missing_values, dup AS duplicate_dates,
       coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), 'ok') AS notes FROM f"""


@query("series_check", _series_sql(PARTS, FAILS, "unsorted OR miss > 0"))
def series_check(spark, d):
    """Quality record per user series: dates, order in the file, numbers."""
    return ql.check_series(raw_events(spark, d), ["user_id"], "date_text", ["value_text"], 100, order="file")


@query("ratio_check", _series_sql(PARTS + EXTRA, f"{FAILS} OR future > 0 OR outside > 0", "unsorted OR miss > 0 OR gap > 0"))
def ratio_check(spark, d):
    """The series check plus missing quarters, future dates and values outside 0-100."""
    return ql.check_ratio(raw_events(spark, d), ["user_id"], "date_text", ["value_text"], "2024-01-28", 100, order="file")


@query(
    "curated_check",
    f"""WITH c AS (SELECT o_custkey AS entity, {pn.q_sql('o_orderdate')} AS q_idx, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS value FROM orders),
        g AS (SELECT entity, count(*) AS rows, min(q_idx) AS a, max(q_idx) AS b, count(DISTINCT q_idx) AS q, count(value) AS use, count(*) - count(value) AS miss FROM c GROUP BY 1)
        SELECT entity, CASE WHEN rows > q OR use < 3 THEN 'FAIL' WHEN b - a + 1 > q THEN 'WARNING' ELSE 'PASS' END AS status, rows, CAST(2 AS BIGINT) AS columns,
               {pn.label_sql('a')} AS start_date, {pn.label_sql('b')} AS end_date, miss AS missing_values, rows - q AS duplicate_dates,
               coalesce(nullif(concat_ws('; ', CASE WHEN rows > q THEN concat(rows - q, ' duplicate quarters') END, CASE WHEN use < 3 THEN 'value usable rows below minimum 3' END,
                  CASE WHEN b - a + 1 > q THEN concat(b - a + 1 - q, ' missing quarters in date range') END), ''), 'ok') AS notes FROM g""",
)
def curated_check(spark, d):
    """Finished-table record per customer history."""
    o = pn.table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), cal.q_idx("o_orderdate").alias("q_idx"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("value"),
    )
    return ql.check_curated(o, K, "value", ["q_idx", "value"], 3)


@query(
    "column_check",
    f"""WITH {pn.SPARSE}, s2 AS (SELECT entity, q_idx, value, gappy, late, CASE WHEN q_idx > 2000 * 4 THEN value END AS recent FROM sparse),
        u AS (SELECT entity, variable, v FROM s2, LATERAL (VALUES ('value', value), ('gappy', gappy), ('late', late), ('recent', recent)) AS x(variable, v)),
        g AS (SELECT entity, variable, count(v) AS n, count(*) - count(v) AS miss, (count(*) - count(v)) / count(*) AS share FROM u GROUP BY 1, 2)
        SELECT entity, variable, CASE WHEN share > 0.5 THEN 'WARNING' ELSE 'PASS' END AS status, n AS rows, miss AS missing_values,
               CASE WHEN share > 0.5 THEN concat(printf('%.1f', share * 100), '% missing after quarterly merge') ELSE 'ok' END AS notes FROM g""",
)
def column_check(spark, d):
    """Missing share of every column."""
    p = pn.sparse_panel(spark, d).withColumn("recent", F.when(F.col("q_idx") > 2000 * 4, F.col("value")))
    return ql.check_columns(p, K, ["value", "gappy", "late", "recent"])


@query(
    "schema_check",
    """WITH n AS (SELECT count(*) AS rows FROM orders)
       SELECT c AS column_name, s AS status, rows, t AS notes FROM n CROSS JOIN (VALUES ('o_orderkey', 'PASS', 'ok'), ('o_totalprice', 'FAIL', 'expected string, found double'),
         ('o_clerk', 'FAIL', 'column is absent')) AS v(c, s, t)""",
)
def schema_check(spark, d):
    """Typed contract on the orders table; extra columns are allowed."""
    contract = T.StructType([
        T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_totalprice", T.StringType()),
        T.StructField("o_clerk", T.StringType()),
    ])
    return ql.check_schema(pn.table(spark, d, "orders"), contract)


@query(
    "consecutive_check",
    f"""WITH o AS (SELECT DISTINCT o_custkey, {pn.q_sql('o_orderdate')} AS q_idx FROM orders)
        SELECT o_custkey, count(*) AS rows, min(q_idx) AS first_q, max(q_idx) AS last_q, max(q_idx) - min(q_idx) + 1 = count(*) AS consecutive FROM o GROUP BY 1""",
)
def consecutive_check(spark, d):
    """Whether each history is free of gaps."""
    o = pn.table(spark, d, "orders").select("o_custkey", cal.q_idx("o_orderdate").alias("q_idx")).distinct()
    return ql.consecutive_periods(o, ["o_custkey"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """Keys that occur more than once."""
    return ql.duplicate_keys(pn.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("unmatched_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unmatched_keys(spark, d):
    """Required keys without a match."""
    o = pn.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return ql.missing_keys(pn.table(spark, d, "customer"), o, ["c_custkey"])


@query(
    "newest_files",
    """WITH f AS (SELECT DISTINCT concat('/in/', lower(o_orderpriority), '_', 1990 + o_custkey % 5, '_', year(o_orderdate), '.csv') AS path FROM orders),
       p AS (SELECT path, regexp_extract(path, '/in/(.+)_([0-9]{4})_([0-9]{4})\\.csv', 1) AS series, CAST(regexp_extract(path, '_([0-9]{4})_([0-9]{4})\\.csv', 1) AS INTEGER) AS a,
             CAST(regexp_extract(path, '_([0-9]{4})_([0-9]{4})\\.csv', 2) AS INTEGER) AS b FROM f)
       SELECT series, a AS first_year, b AS last_year, path FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY b DESC, a) AS k FROM p) WHERE k = 1""",
)
def newest_files(spark, d):
    """Newest download per series by the year range in its name."""
    o = pn.table(spark, d, "orders")
    path = F.concat(
        F.lit("/in/"), F.lower("o_orderpriority"), F.lit("_"), (1990 + F.col("o_custkey") % 5).cast("string"), F.lit("_"),
        F.year("o_orderdate").cast("string"), F.lit(".csv"),
    )
    return series.latest_files(o.select(path.alias("path")).distinct())


@query(
    "projected_columns",
    f"SELECT o_orderkey, {r('o_totalprice', 'o_totalprice', 2)} FROM orders", digits=2,
)
def projected_columns(spark, d):
    """Only the named columns are read."""
    return series.read_columns(pn.table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query(
    "complete_rows",
    f"WITH {pn.SPARSE} SELECT entity, q_idx, {rs('gappy late')} FROM sparse WHERE gappy IS NOT NULL AND late IS NOT NULL",
)
def complete_rows(spark, d):
    """Numeric complete rows of the curated panel."""
    return series.load_complete(pn.sparse_panel(spark, d), ["gappy", "late"], ["entity", "q_idx"])


@query("trimmed_text", "SELECT p_partkey, trim(concat('  ', p_name, ' ')) AS p_name, trim(p_brand) AS p_brand FROM part")
def trimmed_text(spark, d):
    """Every string column trimmed."""
    p = pn.table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"), "p_brand")
    return sinks.trim_strings(p)


@query(
    "load_manifest",
    "SELECT source AS path, count(*) AS rows, CAST(3 AS BIGINT) AS columns, 'doc_id, lang, n_chars' AS column_names FROM documents GROUP BY 1",
)
def load_manifest(spark, d):
    """Rows and columns per saved source."""
    doc = pn.table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.col("source").alias("path"))
    return sinks.load_manifest(doc)


@query(
    "load_record",
    f"""WITH {pn.SPARSE} SELECT 'table:panel' AS dataset, 'PASS' AS status, count(*) AS rows, CAST(6 AS BIGINT) AS columns,
        2 * count(*) - count(gappy) - count(late) AS missing_values, 'ok' AS notes FROM sparse""",
)
def load_record(spark, d):
    """Quality record of a finished table load."""
    return sinks.load_record(pn.sparse_panel(spark, d), "panel")


SNAP = """old AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, max(o_totalprice) AS point_forecast, CASE WHEN y % 2 = 0 THEN min(o_totalprice) END AS actual FROM orders
    WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
  new AS (SELECT o_custkey AS entity, year(o_orderdate) AS y, avg(o_totalprice) / 997 AS point_forecast, max(o_totalprice) AS actual FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2),
  merged AS (SELECT coalesce(o.entity, n.entity) AS entity, CAST(coalesce(o.y, n.y) AS INTEGER) AS y, CASE WHEN o.entity IS NOT NULL THEN o.point_forecast ELSE n.point_forecast END AS point_forecast,
    coalesce(o.actual, n.actual) AS actual FROM old o FULL JOIN new n ON n.entity = o.entity AND n.y = o.y)"""


def snapshot_cuts(spark, d):
    o = pn.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("y"), "o_orderdate", "o_totalprice")
    old = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("date")).groupBy("entity", "y").agg(
        F.max("o_totalprice").alias("point_forecast"), F.min("o_totalprice").alias("m")
    ).select("entity", "y", "point_forecast", F.when(F.col("y") % 2 == 0, F.col("m")).alias("actual"))
    new = o.where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("date")).groupBy("entity", "y").agg(
        (F.avg("o_totalprice") / 997).alias("point_forecast"), F.max("o_totalprice").alias("actual")
    )
    return old, new


def snapshots(spark, d):
    return up.upsert(*snapshot_cuts(spark, d), ["entity", "y"], ["actual"])


@query("snapshot_upsert", f"WITH {SNAP} SELECT entity, y, {rs('point_forecast actual')} FROM merged")
def snapshot_upsert(spark, d):
    """New keys inserted; known keys keep their forecast and only fill a missing actual."""
    return snapshots(spark, d)


@query(
    "snapshot_errors",
    f"""WITH {SNAP} SELECT entity, y, {rs('point_forecast actual')}, {r('actual - point_forecast', 'error')}, {r('abs(actual - point_forecast)', 'absolute_error')}
        FROM merged WHERE actual IS NOT NULL""",
)
def snapshot_errors(spark, d):
    """Errors of saved forecasts whose actual is known."""
    return up.snapshot_errors(snapshots(spark, d))


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""",
)
def latest_per_key(spark, d):
    """Last row per key by date, combined map-side."""
    o = pn.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return up.keep_last(o, ["o_custkey"], "o_orderdate").drop("o_orderdate")


@query(
    "gated_publish",
    f"WITH {pn.PANEL} SELECT entity, q_idx, {r('value', 'value')}, n_orders FROM panel",
)
def gated_publish(spark, d):
    """The panel published behind its quality report and read back through the pointer."""
    panel = pn.order_panel(spark, d)
    folder = stage.fresh_folder(spark)
    sinks.publish_if_clean(panel, ql.check_curated(panel, K, "value", ["q_idx", "value"], 8), folder)
    return sinks.read_published(spark, folder)


@query(
    "curated_files",
    f"WITH {pn.LINE} SELECT entity, q_idx, {rs('price quantity')} FROM line UNION ALL SELECT entity, q_idx, {rs('price quantity')} FROM line",
)
def curated_files(spark, d):
    """The curated panel written as Parquet and CSV, split by entity; both copies read back."""
    folder = stage.fresh_folder(spark)
    sinks.write_curated(pn.line_panel(spark, d).select("entity", "q_idx", "price", "quantity"), folder, ["entity"])
    both = [sinks.read_published(spark, folder, part).select("entity", "q_idx", "price", "quantity") for part in (sinks.DATA, sinks.CSV)]
    return both[0].unionByName(both[1].select("entity", *[F.col(c).cast(t) for c, t in both[0].dtypes[1:]]))


@query(
    "series_files",
    f"WITH {pn.PANEL} SELECT entity AS series_id, q_idx, {r('value', 'value')} FROM panel",
)
def series_files(spark, d):
    """One CSV folder per series, written and read back with a declared schema."""
    folder = stage.fresh_folder(spark)
    sinks.write_series(pn.order_panel(spark, d).select(F.col("entity").alias("series_id"), "q_idx", "value"), folder)
    return series.read_series(spark, folder, "q_idx int, value double, series_id string")


@query(
    "saved_file_manifest",
    f"""WITH {pn.PANEL}, f AS (SELECT entity, count(*) AS n FROM panel GROUP BY 1)
        SELECT entity AS series_id, n AS rows, CAST(2 AS BIGINT) AS columns, 'q_idx, value' AS column_names, true AS has_bytes FROM f""",
)
def saved_file_manifest(spark, d):
    """Series written to files, and what the folder then holds, per series."""
    folder = stage.fresh_folder(spark)
    sinks.write_series(pn.order_panel(spark, d).select(F.col("entity").alias("series_id"), "q_idx", "value"), folder)
    files = sinks.saved_files(spark, folder, "csv").withColumn("series_id", F.url_decode(F.regexp_extract("path", "series_id=([^/]+)/", 1)))
    return files.groupBy("series_id").agg(
        F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.max("column_names").alias("column_names"), (F.min("bytes") > 0).alias("has_bytes")
    )


@query(
    "published_tables",
    f"""WITH {pn.SPARSE} SELECT 'table:curated_panel' AS dataset, 'PASS' AS status, count(*) AS rows, CAST(6 AS BIGINT) AS columns, 2 * count(*) - count(gappy) - count(late) AS missing_values, 'ok' AS notes FROM sparse
        UNION ALL SELECT 'table:quality', 'PASS', count(DISTINCT entity), CAST(9 AS BIGINT), 0, 'ok' FROM sparse""",
)
def published_tables(spark, d):
    """Curated and quality tables registered for SQL, with a load record each."""
    p = pn.sparse_panel(spark, d)
    return sinks.publish_tables({"curated_panel": p, "quality": ql.check_curated(p, K, "value", ["q_idx"], 8)})


@query("snapshot_table", f"WITH {SNAP} SELECT entity, y, {rs('point_forecast actual')} FROM merged")
def snapshot_table(spark, d):
    """The versioned table after three merges, the last two of them identical."""
    old, new = snapshot_cuts(spark, d)
    folder = stage.fresh_folder(spark)
    for incoming in (old, new, new):
        out = up.merge_table(spark, folder, incoming, ["entity", "y"], ["actual"])
    return out
