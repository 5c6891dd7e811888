"""Boosters grown together from shared histograms against a small booster on sorted arrays, and DuckDB over their trees."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting as bo


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    z = x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.4, size=n)
    return [(i, i * 5 // n, *map(float, x[i]), int(z[i] > -0.3), int(z[i] > 0.6)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, block int, a double, b double, c double, low int, high int")


def small_booster(x, y, seen, allowed, s):
    """One model on plain arrays: every distinct value is a cut; returns the score function's value at each row of x."""
    score = np.zeros(len(x))

    def worth(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    def grow(rows, g, h, depth, use):
        best, found = 0.0, None
        if depth:
            for f in use:
                for cut in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if h[left].sum() < s.min_weight or h[right].sum() < s.min_weight:
                        continue
                    gain = round(worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum()), 9)
                    if gain > best:
                        best, found = gain, (f, cut, left, right)
        if found is None:
            total = g[rows].sum()
            value = -np.sign(total) * max(abs(total) - s.l1, 0) / (h[rows].sum() + s.l2) * s.step
            return lambda v: np.full(len(v), value)
        f, cut, left, right = found
        lower, upper = grow(left, g, h, depth - 1, use), grow(right, g, h, depth - 1, use)
        return lambda v: np.where(v[:, f] <= cut, lower(v), upper(v))

    for t in range(s.trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.flatnonzero(seen[t]), p - y, p * (1 - p), s.depth, allowed[t])
        score = score + tree(x)
    return score


@pytest.mark.parametrize("more", [{"subsample": 1.0, "columns": 1.0}, {}, {"depth": 3, "columns": 0.5}])
def test_agrees_with_a_small_booster(spark, more):
    s = bo.Settings(**{"trees": 12, "step": 0.3, "bins": 256, **more})
    rows = data()
    df = frame(spark, rows).repartition(3)
    model = bo.fit(df, ["a", "b", "c"], ["low", "high"], "block", [2, 4], s)
    hashes = {r.id: r.h for r in df.select("id", F.xxhash64(*df.columns).alias("h")).collect()}
    got = {r.id: (r.p_low, r.p_high) for r in model.predict(df.withColumn("k", F.when(F.col("block") < 3, 2).otherwise(4)), "k").collect()}
    assert len(got) == len(rows)
    allowed = [bo.columns_of(t, 3, s) for t in range(s.trees)]
    for fold in (2, 4):
        train = [r for r in rows if r[1] < fold]
        rest = [r for r in rows if (2 if r[1] < 3 else 4) == fold]
        both = train + rest
        x = np.array([r[2:5] for r in both])
        row = np.array([hashes[r[0]] for r in both], np.int64).view(np.uint64)
        teaches = np.arange(len(both)) < len(train)
        seen = [bo.sampled(row, t, s) & teaches for t in range(s.trees)]
        for side, name in enumerate(("low", "high")):
            score = small_booster(x, np.array([r[5 + side] for r in both]), seen, allowed, s)
            for r, v in list(zip(both, score))[len(train) :]:
                assert got[r[0]][side] == pytest.approx(1 / (1 + np.exp(-v)), abs=1e-6)
    assert any(len(t) > 3 for own in model.trees for t in own)


def test_sql_recomputes_scores_from_exported_trees(spark, tmp_path):
    df = frame(spark, data(300))
    model = bo.fit(df, ["a", "b", "c"], ["low", "high"], "block", [3, 4], bo.Settings(trees=15, step=0.2))
    asked = df.where("block >= 3")
    model.table(spark).coalesce(1).write.parquet(f"{tmp_path}/trees")
    asked.coalesce(1).write.parquet(f"{tmp_path}/rows")
    walked = duckdb.sql(f"""WITH RECURSIVE trees AS (SELECT * FROM '{tmp_path}/trees/*.parquet'), rows AS (SELECT * FROM '{tmp_path}/rows/*.parquet'),
        walk AS (SELECT id, outcome, tree, node, fold, feature, cut, value, a, b, c FROM rows JOIN trees ON fold = block AND node = 1
            UNION ALL SELECT w.id, w.outcome, w.tree, t.node, w.fold, t.feature, t.cut, t.value, a, b, c FROM walk w JOIN trees t ON t.fold = w.fold AND t.outcome = w.outcome AND t.tree = w.tree
                AND t.node = 2 * w.node + CASE WHEN CASE w.feature WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END > w.cut THEN 1 ELSE 0 END WHERE w.feature IS NOT NULL)
        SELECT id, outcome, 1 / (1 + exp(-sum(value))) FROM walk WHERE value IS NOT NULL GROUP BY ALL""").fetchall()
    want = {(i, o): p for i, o, p in walked}
    got = {(r.id, o): r[f"p_{o}"] for r in model.predict(asked, "block").collect() for o in ("low", "high")}
    assert got.keys() == want.keys() and len(got) == 240
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_same_trees_however_rows_are_dealt(spark):
    df = frame(spark, data())
    trees = [bo.fit(df.repartition(n), ["a", "b"], ["low"], settings=bo.Settings(trees=12, bins=8)).trees for n in (1, 7)]
    assert trees[0] == trees[1]


def test_wide_features_and_missing_values(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, float(v), None if i % 10 == 0 else float(i % 3), 0.0, None if i % 17 == 0 else int(v > 0), 1) for i, v in enumerate(rng.normal(size=2000))]
    df = frame(spark, rows)
    model = bo.fit(df, ["a", "b"], ["low"], settings=bo.Settings(trees=20, step=0.5, columns=1.0))
    out = model.predict(df)
    assert out.count() == 1800 and out.columns == [*df.columns, "p_low"]
    assert out.where("low IS NOT NULL").select(F.avg(((F.col("p_low") > 0.5).cast("int") == F.col("low")).cast("int"))).first()[0] > 0.97
    with pytest.raises(ValueError, match="only one outcome"):
        bo.fit(df, ["a"], ["high"])
    with pytest.raises(ValueError, match="only one outcome"):
        bo.fit(df.limit(0), ["a"], ["low"])


def test_one_outcome_is_fitted_where_asked(spark):
    df = frame(spark, data(200)).withColumn("high", F.lit(0)).withColumn("low", F.when(F.col("block") < 2, F.lit(1)).otherwise(F.col("low")))
    s = bo.Settings(trees=2, step=0.5, subsample=1.0, columns=1.0, one_sided=True)
    model = bo.fit(df, ["a", "b"], ["low", "high"], "block", [2, 4], s)
    early = model.predict(df.where("block = 2"), "block").select("p_low", "p_high").distinct().collect()
    score = 0.0
    for _ in range(2):  # 80 rows, each pulls the score of its one outcome up
        p = 1 / (1 + np.exp(-score))
        score += 0.5 * (80 * (1 - p) - 0.1) / (80 * p * (1 - p) + 2)
    up = 1 / (1 + np.exp(-score))
    assert len(early) == 1 and (early[0].p_low, early[0].p_high) == (pytest.approx(up, abs=1e-6), pytest.approx(1 - up, abs=1e-6))
    assert all(set(t) == {1} for t in model.trees[0] + model.trees[1] + model.trees[3])  # no split
    assert model.predict(df.where("block = 4"), "block").select("p_low").distinct().count() > 1
    with pytest.raises(ValueError, match="only one outcome"):  # no rows at all
        bo.fit(df, ["a"], ["low"], "block", [0], s)


def still_rate(spark, folder):
    """A lineitem table whose rates never change, so that all labels are "hold"; the SQL's view of it."""
    lines = [("AN"[i % 2], "F", 10 + i * 7 % 31, 900.0 + i, 0.05, (i * 5 % 9) / 100, i // 12) for i in range(240)]
    rows = spark.createDataFrame(lines, "l_returnflag string, l_linestatus string, l_quantity int, l_extendedprice double, l_discount double, l_tax double, n int")
    rows.withColumn("l_quantity", F.col("l_quantity").cast("double")).withColumn("l_shipdate", F.expr("add_months(DATE'1995-01-15', 3 * n)")).drop("n").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


def same_as_sql(spark, con, name, folder):
    import check_oracle

    from panelcast.plans import ORACLE, QUERIES

    problem, n, _ = check_oracle.compare(spark, con, name, QUERIES[name], ORACLE.get(name), str(folder))
    assert problem is None
    return n


def test_stumps_of_a_still_rate(spark, tmp_path):
    assert same_as_sql(spark, still_rate(spark, tmp_path), "boosted_stumps", tmp_path) == 24


def test_pair_sums_of_a_still_rate(spark, tmp_path):
    assert same_as_sql(spark, still_rate(spark, tmp_path), "ordinal_pair_sums", tmp_path) == 2


def test_tree_pair_of_a_still_rate(spark, tmp_path):
    from panelcast.plans import QUERIES

    still_rate(spark, tmp_path)
    out = QUERIES["ordinal_tree_pair"](spark, str(tmp_path)).collect()
    assert len(out) == 24 and {(r.actual_action, r.predicted_action) for r in out} == {("hold", "hold")}
    assert all(r.p_hold > 0.5 and r.p_cut + r.p_hold + r.p_hike == pytest.approx(1.0, abs=3e-6) for r in out)
