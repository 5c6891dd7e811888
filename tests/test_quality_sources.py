import datetime as dt

import pytest
from conftest import q, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import profile, quality
from panelcast.sources import pointer, series, sinks, stage, upsert


def record(df):
    return df.first().asDict()


def test_duplicate_dates_fail(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-01", 2.0)], "date string, v double")
    r = record(quality.check_series(df, [], "date", ["v"]))
    assert (r["status"], r["duplicate_dates"], r["notes"]) == ("FAIL", 1, "1 duplicate dates")


def test_empty_invalid_unsorted_and_missing(spark):
    empty = spark.createDataFrame([], "date string, v double")
    r = record(quality.check_series(empty, [], "date", ["v"]))
    assert r["status"] == "FAIL" and r["notes"].startswith("dataset is empty; row count below minimum 1")
    df = spark.createDataFrame([("2020-02-01", "1"), ("2020-01-01", None), ("x", "a")], "date string, v string")
    df = quality.with_file_order(df.coalesce(1))
    r = record(quality.check_series(df, [], "date", ["v"], order="_pos"))
    assert r["status"] == "FAIL"
    assert r["notes"] == "1 invalid date values; dates are not sorted; v has 1 non-numeric values"
    ok = spark.createDataFrame([("2020-01-01", None), ("2020-02-01", 1.0)], "date string, v double")
    r = record(quality.check_series(ok, [], "date", ["v", "w"]))
    assert r["status"] == "FAIL" and r["notes"] == "missing value column: w"
    r = record(quality.check_series(ok, [], "date", ["v"]))
    assert (r["status"], r["notes"]) == ("WARNING", "1 missing values")


def test_unsorted_by_a_position_column(spark):
    for days, back in [([1, 2, 3, 9, 4, 5], True), ([1, 2, 2, 9], False), ([1, 2, 1], True), ([3], False), ([2, None, 1], True), ([1, None, 2, 2], False), ([1, 1, 2, 1, 2], True)]:
        df = spark.createDataFrame(list(enumerate(days)), "p bigint, d int").repartition(3)
        assert quality.unsorted_flags(df, [], F.col("d"), "p").first()["unsorted"] is back


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_file_order_over_files_of_unequal_size(spark, tmp_path, form):
    """Larger files are read first; the order is that of their names. Blocks of a file follow by offset."""
    base = str(tmp_path)

    def save(name, frame):
        frame.coalesce(1).sortWithinPartitions("n").write.option("header", True).option("compression", "none").format(form).save(f"{base}/{name}")

    days = spark.range(9000).select(F.col("id").alias("n"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 2).alias("k"))
    save("a", days.where("n < 20"))
    save("b", days.where("n >= 20"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = spark.read.schema("n long, day date, k long").option("header", True).format(form)
        both = read.load([f"{base}/a", f"{base}/b"])
        swapped = both.withColumn("day", F.when(F.col("n") == 4500, F.lit("2001-01-01").cast("date")).otherwise(F.col("day")))
        first_late = both.withColumn("day", F.when(F.col("n") == 3, F.lit("2000-02-01").cast("date")).otherwise(F.col("day")))
        for df, back in [(both, {0: False, 1: False}), (swapped, {0: True, 1: False}), (first_late, {0: False, 1: True})]:
            assert {r.k: r.unsorted for r in quality.unsorted_flags(df, ["k"], F.col("day")).collect()} == back
        record_ = quality.check_series(both, [], "day", ["n"], order="file")
        assert record_.first().status == "PASS"
        plan = record_._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan and "InPandas" not in plan
        assert "dates are not sorted" in quality.check_series(swapped, [], "day", ["n"], order="file").first().notes
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ratio_check_future_and_range(spark):
    df = spark.createDataFrame([("2020Q1", 5.0), ("2021Q1", 101.0)], "quarter string, v double")
    r = record(quality.check_ratio(df, [], "quarter", ["v"], "2020-06-30"))
    assert r["status"] == "FAIL"
    assert "3 missing quarters in date range" in r["notes"]
    assert "1 future date values" in r["notes"] and "outside 0-100 percent" in r["notes"]


def test_curated_and_column_checks(spark):
    df = spark.createDataFrame(
        [(q("2020Q1") + i, 1.0 if i == 0 else None, None if i == 2 else 2.0) for i in range(5)], "q_idx int, y double, z double"
    )
    r = record(quality.check_curated(df, [], "y", ["q_idx", "y"], 1))
    assert (r["status"], r["rows"], r["missing_values"], r["notes"]) == ("PASS", 5, 5, "ok")
    assert record(quality.check_curated(df, [], "y", ["gone"], 2))["notes"] == (
        "missing required columns: gone; y usable rows below minimum 2"
    )
    cols = {x.variable: (x.status, x.missing_values, x.notes) for x in quality.check_columns(df, [], ["y", "z"]).collect()}
    assert cols["z"] == ("PASS", 1, "ok")
    assert cols["y"] == ("WARNING", 4, "80.0% missing after quarterly merge")


def test_schema_contract(spark):
    contract = T.StructType([T.StructField("quarter", T.StringType(), False), T.StructField("y", T.DoubleType(), False)])
    good = spark.createDataFrame([("2020Q1", 1.0, 5)], "quarter string, y double, extra int")
    assert {r.status for r in quality.check_schema(good, contract).collect()} == {"PASS"}
    text = good.withColumn("y", F.col("y").cast("string"))
    assert rows(quality.check_schema(text, contract).where("status = 'FAIL'"), "column_name") == [("y",)]
    assert "FAIL" in {r.status for r in quality.check_schema(good.drop("y"), contract).collect()}
    null = spark.createDataFrame([("2020Q1", None)], "quarter string, y double")
    assert rows(quality.check_schema(null, contract).where("status = 'FAIL'"), "notes") == [("1 missing values",)]


def test_key_and_period_assertions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "k string, q_idx int")
    quality.assert_unique(df, ["k", "q_idx"])
    with pytest.raises(ValueError):
        quality.assert_unique(df, ["k"])
    quality.assert_consecutive(df.where("k = 'a'"), ["k"])
    with pytest.raises(ValueError):
        quality.assert_consecutive(df, ["k"])
    with pytest.raises(ValueError):
        quality.assert_keys(df, df.where("k = 'a'"), ["k"], "x")


def test_gated_publish(spark, tmp_path):
    data = spark.createDataFrame([(1,)], "x int")
    bad = spark.createDataFrame([("d", "FAIL")], "dataset string, status string")
    with pytest.raises(sinks.QualityGateError, match="/quality contains FAIL"):
        sinks.publish_if_clean(data, bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "pointer-1").exists()
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "bad"))
    warn = spark.createDataFrame([("d", "WARNING")], bad.schema)
    sinks.publish_if_clean(data, warn, str(tmp_path / "good"))
    assert sinks.read_published(spark, str(tmp_path / "good")).count() == 1


def test_a_death_between_writes_leaves_the_last_set(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "t")
    report = lambda status: lambda df: df.agg(F.lit(status).alias("status"), F.count(F.lit(1)).alias("rows"))
    sinks.publish_set(spark.range(3), where, report("PASS"), csv=True)
    seen = lambda: [sinks.read_published(spark, where, part).collect() for part in (sinks.DATA, sinks.QUALITY, sinks.CSV)]
    first = seen()
    assert [len(x) for x in first] == [3, 1, 3] and first[1][0].rows == 3

    def dies(*_):
        raise OSError("gone")

    broken = spark.range(9).select(F.assert_true(F.col("id") < 5), "id")
    for df, quality_, move in [(broken, report("PASS"), None), (spark.range(9), dies, None), (spark.range(9), report("FAIL"), None), (spark.range(9), report("PASS"), dies)]:
        with monkeypatch.context() as m:
            if move:
                m.setattr(sinks, "move_pointer", move)
            with pytest.raises(Exception):
                sinks.publish_set(df, where, quality_, csv=True)
        assert seen() == first
    sinks.publish_set(spark.range(5), where, report("PASS"), csv=True)
    assert [len(x) for x in seen()] == [5, 1, 5] and seen()[1][0].rows == 5
    assert sinks.read_published(spark, where, number=1).count() == 3


def test_the_report_is_of_what_was_written(spark, tmp_path):
    """A table that differs each time it is computed is checked and published as one."""
    df = spark.range(50).select((F.rand() * 1e6).alias("x"))
    sinks.publish_set(df, str(tmp_path), lambda t: t.agg(F.lit("PASS").alias("status"), F.sum("x").alias("total")), csv=True)
    total = sinks.read_published(spark, str(tmp_path), sinks.QUALITY).first().total
    assert sinks.read_published(spark, str(tmp_path)).agg(F.sum("x")).first()[0] == pytest.approx(total)
    assert sinks.read_published(spark, str(tmp_path), sinks.CSV).agg(F.sum(F.col("x").cast("double"))).first()[0] == pytest.approx(total)


def test_writers_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "2020Q1", " x "), ("b", "2020Q1", "y"), (None, "2020Q2", "z")], "series_id string, quarter string, note string")
    sinks.write_series(df, str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert rows(back.where("series_id IS NOT NULL"), "series_id", "note") == [("a", "x"), ("b", "y")] and back.count() == 3
    with pytest.raises(Exception, match="already exists"):
        sinks.write_series(df, str(tmp_path / "s"))
    sinks.write_curated(df, str(tmp_path / "c"), ["series_id"])
    assert sinks.read_published(spark, str(tmp_path / "c")).count() == 3
    m = sinks.load_manifest(df.where("series_id IS NOT NULL").withColumnRenamed("series_id", "path"))
    assert rows(m, "path", "rows", "columns", "column_names") == [("a", 1, 2, "quarter, note"), ("b", 1, 2, "quarter, note")]


def test_a_hot_series_has_many_files(spark, tmp_path):
    """One series with half of all rows is written by many tasks; small ones keep one file each."""
    df = spark.range(4000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("series_id"), "id")
    # so little data would be put together again
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sinks.write_series(df, str(tmp_path / "s"), file_rows=250)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name.split("=")[1]: len(list(p.glob("*.csv"))) for p in (tmp_path / "s").iterdir() if "=" in p.name}
    assert 3 < files.pop("hot") <= 8 and set(files.values()) == {1} and len(files) == 20
    got = sinks.saved_files(spark, str(tmp_path / "s"), "csv").collect()
    assert sum(r.rows for r in got) == 4000 and all(r.columns == 1 and r.column_names == "id" for r in got)
    assert {r.path.split("///")[1]: r.bytes for r in got} == {str(p)[1:]: p.stat().st_size for p in (tmp_path / "s").rglob("*.csv")}


def test_files_without_rows_are_listed(spark, tmp_path):
    df = spark.range(10).repartition(2).where("id < 0 OR id = 3").select("id", F.lit("x").alias("y"))
    df.write.parquet(str(tmp_path / "p"))
    spark.range(3).select("id", F.lit("x").alias("y"), F.lit("a:b+c d").alias("k")).coalesce(1).write.partitionBy("k").parquet(str(tmp_path / "q"))
    assert [r.rows for r in sinks.saved_files(spark, str(tmp_path / "q")).collect()] == [3]
    got = sinks.saved_files(spark, str(tmp_path / "p")).collect()
    assert len(got) == len(list((tmp_path / "p").glob("*.parquet"))) and sum(r.rows for r in got) == 1 and all(r.column_names == "id, y" and r.bytes > 0 for r in got)


def test_publish_tables(spark):
    df = spark.createDataFrame([("2020Q1", None)], "quarter string, y double")
    out = sinks.publish_tables({"curated_view": df, "empty_view": df.where("false")})
    assert rows(out, "dataset", "status", "rows", "missing_values") == [
        ("table:curated_view", "PASS", 1, 1), ("table:empty_view", "FAIL", 0, 0)
    ]
    assert spark.table("curated_view").count() == 1


def test_upsert_is_idempotent_and_keeps_forecasts(spark, tmp_path):
    schema = "target string, model string, target_quarter string, point_forecast double, actual double"
    keys, path = ["target", "model", "target_quarter"], str(tmp_path / "snap")
    new = lambda f, a: spark.createDataFrame([("cpi", "m", "2026Q1", f, a)], schema)
    upsert.merge_table(spark, path, new(3.5, None), keys, ["actual"])
    t = upsert.merge_table(spark, path, new(3.5, None), keys, ["actual"])
    assert rows(t, "point_forecast", "actual") == [(3.5, None)]
    t = upsert.merge_table(spark, path, new(9.9, 4.0), keys, ["actual"])
    assert rows(upsert.snapshot_errors(t), "point_forecast", "error", "absolute_error") == [(3.5, 0.5, 0.5)]
    with pytest.raises(ValueError):
        upsert.merge_table(spark, path, new(1.0, None).union(new(2.0, None)), keys, ["actual"])


def test_merge_that_dies_before_its_pointer(spark, tmp_path, monkeypatch):
    """The old table stays readable, the next merge is complete, and only touched parts are written anew."""
    path = str(tmp_path / "t")
    new = lambda *ids: spark.createDataFrame([(i, float(i), None) for i in ids], "k long, f double, a double")
    upsert.merge_table(spark, path, new(*range(40)), ["k"], ["a"], parts=8)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(upsert, "move_pointer", die)
        with pytest.raises(RuntimeError, match="lost"):
            upsert.merge_table(spark, path, new(100, 101), ["k"], ["a"], parts=8)
    assert spark.read.parquet(*pointer.read_pointer(spark, path).values()).count() == 40
    before = pointer.read_pointer(spark, path)
    t = upsert.merge_table(spark, path, new(100), ["k"], ["a"], parts=8)
    after = pointer.read_pointer(spark, path)
    assert t.count() == 41 and sum(before[p] != after[p] for p in before) == 1
    # a pointer that was not finished does not count
    (tmp_path / "t" / "pointer-9").mkdir()
    assert pointer.read_pointer(spark, path) == after
    assert upsert.merge_table(spark, path, new(200), ["k"], ["a"], parts=8).count() == 42
    lost = tmp_path / "lost"
    (lost / "data-1").mkdir(parents=True)
    with pytest.raises(RuntimeError, match="no finished pointer"):
        upsert.merge_table(spark, str(lost), new(1), ["k"], ["a"])


def test_merged_table_splits_the_part_that_outgrows_it(spark, tmp_path):
    """Parts split by their rows, untouched ones stay, readers of the older version keep it."""
    path = str(tmp_path / "t")
    frame = lambda ids, f=1.0: spark.createDataFrame([(i, f, None) for i in ids], "k long, f double, a double")
    merge = lambda df: upsert.merge_table(spark, path, df, ["k"], ["a"], parts=4, part_rows=50)
    first = merge(frame(range(120)))
    old = pointer.read_sizes(spark, path)
    assert sorted(old) == [4, 5, 6, 7] and sum(n for _, n in old.values()) == 120
    hot = min(old)
    inside = [r.k for r in spark.range(4000).select(F.col("id").alias("k")).where((F.pmod(F.xxhash64("k"), F.lit(4)) == hot - 4) & (F.col("k") >= 120)).limit(300).collect()]
    out = merge(frame(inside))
    new = pointer.read_sizes(spark, path)
    assert hot not in new and {p: new[p] for p in old if p != hot} == {p: old[p] for p in old if p != hot}
    grown = {p: n for p, (_, n) in new.items() if p not in old}
    assert len(grown) >= 8 and sum(grown.values()) == 300 + old[hot][1] and all(bin(p).endswith(bin(hot - 4)[2:].zfill(2)) for p in grown)
    assert out.count() == 420 and out.select("k").distinct().count() == 420
    assert first.count() == 120  # files of the older version are still there
    # known keys keep their row, missing actuals are filled, in parts of either depth
    filled = merge(frame(range(60), 9.0).withColumn("a", F.col("k") * 1.0))
    assert filled.count() == 420 and filled.where("a = k AND f = 1").count() == 60
    assert merge(frame([])).count() == 420
    # a key of an empty part is found again
    few = str(tmp_path / "few")
    for ids in ([1], [2], [1, 2, 3]):
        t = upsert.merge_table(spark, few, frame(ids), ["k"], ["a"], parts=64)
    assert sorted(r.k for r in t.collect()) == [1, 2, 3] and len(pointer.read_sizes(spark, few)) == 64
    with pytest.raises(ValueError, match="power of two"):
        upsert.merge_table(spark, few, frame([1]), ["k"], ["a"], parts=3)


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.checkpoint_folder(Session())


def test_newest_files_of_a_directory(spark, tmp_path):
    for name, value in (("cpi_1990_2020", 1), ("cpi_1990_2021", 2), ("rate_2000_2020", 3), ("plain", 4)):
        (tmp_path / f"{name}.csv").write_text(f"date,value\n2020-01-01,{value}\n")
    out = series.read_latest(spark, str(tmp_path), "date string, value int")
    assert rows(out, "series", "value") == [("cpi", 2), ("plain", 4), ("rate", 3)]


def test_date_spacing_counts_repeats(spark):
    days = [1, 1, 1, 3, 6]
    df = spark.createDataFrame([("u", dt.datetime(2024, 1, d, h)) for h, d in enumerate(days)], "u string, ts timestamp")
    r = record(profile.frequency_profile(df, ["u"], "ts"))
    # gaps 0, 0, 2, 3
    assert (r["rows"], r["duplicate_dates"], r["median_spacing_days"]) == (5, 2, 1.0)


def test_even_sample_positions(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "q_idx int")
    # positions 0, 3.33, 6.67, 10
    assert [r[0] for r in profile.even_sample(df, [], "q_idx", 4).orderBy("q_idx").collect()] == [0, 3, 7, 10]
    assert profile.even_sample(df.where("q_idx < 3"), [], "q_idx", 4).count() == 3
