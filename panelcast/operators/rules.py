"""Decision rules for the ordered actions cut < hold < hike and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.functions.calendar import q_label
from panelcast.functions.stats import normal_sf_pair
from panelcast.operators.align import over_time
from panelcast.operators.reshape import rank_of

# Class order, inflation band, rule coefficients, dead band, coefficient warning level.
CLASSES = ["cut", "hold", "hike"]
BAND = (2.0, 3.0)
TARGET_MIDPOINT = 2.5
GAP_COEFFICIENT = 0.5
UNEMPLOYMENT_COEFFICIENT = 0.5
DEAD_BAND = 0.125
COEFFICIENT_WARNING = 10.0


def label_change(change: Column) -> Column:
    """Sign of a change: exactly zero is hold, missing stays missing."""
    return F.when(change < 0, "cut").when(change == 0, "hold").when(change > 0, "hike")


def band_rule(value: Column, lo: float = BAND[0], hi: float = BAND[1]) -> Column:
    """Below the band cut, above hike, otherwise hold (also for a missing forecast)."""
    return F.when(value < lo, "cut").when(value > hi, "hike").otherwise("hold")


def class_code(label: Column) -> Column:
    return F.coalesce(*[F.when(label == c, F.lit(i)) for i, c in enumerate(CLASSES)])


def class_counts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(label) == c).alias(c) for c in CLASSES])


def implied_change(
    headline: Column, unemployment_change: Column, rate: Column, r_star: Column, midpoint: float = TARGET_MIDPOINT,
) -> Column:
    implied = r_star + headline + GAP_COEFFICIENT * (headline - midpoint) + UNEMPLOYMENT_COEFFICIENT * unemployment_change
    return implied - rate


def fixed_rule(
    df: DataFrame, keys: list[str], headline: str, unemployment_change: str, rate: str,
    current_rate: str, r_star: str = "full", midpoint: float = TARGET_MIDPOINT,
) -> DataFrame:
    """Fixed-coefficient rule. ``r_star="full"`` averages the real rate over the whole sample,
    ``"expanding"`` over strictly earlier rows."""
    real = F.col(rate) - F.col(headline)
    w = W.partitionBy(*keys) if r_star == "full" else over_time(keys).rowsBetween(W.unboundedPreceding, -1)
    change = implied_change(
        F.col(headline), F.col(unemployment_change), F.col(current_rate), F.col("r_star"), midpoint
    )
    return df.withColumn("r_star", F.avg(real).over(w)).withColumn("implied_change", change).withColumn(
        "predicted_action", label_change(F.col("implied_change"))
    )


def dead_band_label(change: Column, band: float = DEAD_BAND) -> Column:
    return F.when(change < -band, "cut").when(change > band, "hike").otherwise("hold")


def expanding_ols(
    df: DataFrame, keys: list[str], y: str, x1: str, x2: str, initial: int, band: float = DEAD_BAND,
) -> DataFrame:
    """Two-regressor least squares refitted before every row from strictly earlier rows.

    Running centred moments over the earlier rows give the coefficients in closed form, so one sorted pass
    per entity replaces a refit per row. Rows before ``initial`` earlier observations are dropped.
    """
    rows = df.dropna(subset=[y, x1, x2])
    past = over_time(keys).rowsBetween(W.unboundedPreceding, -1)
    n = F.count(y).over(past)
    moments = {
        "_n": n, "_my": F.avg(y).over(past), "_m1": F.avg(x1).over(past), "_m2": F.avg(x2).over(past),
        "_s11": F.var_pop(x1).over(past) * n, "_s22": F.var_pop(x2).over(past) * n,
        "_syy": F.var_pop(y).over(past) * n, "_s12": F.covar_pop(x1, x2).over(past) * n,
        "_s1y": F.covar_pop(x1, y).over(past) * n, "_s2y": F.covar_pop(x2, y).over(past) * n,
    }
    c = F.col
    det = F.nullif(c("_s11") * c("_s22") - c("_s12") * c("_s12"), F.lit(0.0))
    fitted = rows.withColumns(moments).where(c("_n") >= initial).withColumns(
        {
            "coef_1": (c("_s22") * c("_s1y") - c("_s12") * c("_s2y")) / det,
            "coef_2": (c("_s11") * c("_s2y") - c("_s12") * c("_s1y")) / det,
        }
    )
    fitted = fitted.withColumn("intercept", c("_my") - c("coef_1") * c("_m1") - c("coef_2") * c("_m2"))
    sse = F.greatest(F.lit(0.0), c("_syy") - c("coef_1") * c("_s1y") - c("coef_2") * c("_s2y"))
    big = lambda name: F.when(F.abs(name) > COEFFICIENT_WARNING, F.lit(name))
    return fitted.withColumns(
        {
            "train_rows": c("_n"),
            "predicted_change": c("intercept") + c("coef_1") * c(x1) + c("coef_2") * c(x2),
            "residual_se": F.sqrt(F.try_divide(sse, (c("_n") - 3).cast("double"))),
            "unstable_coefficients": F.concat_ws(", ", big("coef_1"), big("coef_2")),
        }
    ).withColumn("predicted_action", dead_band_label(c("predicted_change"), band)).drop(*moments)


def normal_band_probs(df: DataFrame, mu: str, sigma: str, band: float = DEAD_BAND) -> DataFrame:
    """Class probabilities of a normal change; all three are missing where ``sigma`` is zero or missing."""
    lo, hi = normal_sf_pair(F.col(mu), F.col(sigma), band)
    return df.withColumns({"p_cut": lo, "_u": hi}).withColumns(
        {"p_hold": F.col("_u") - F.col("p_cut"), "p_hike": 1.0 - F.col("_u")}
    ).drop("_u")


def majority_vote(df: DataFrame, voters: list[str], tie_breaker: str, required: list[str] | None = None) -> DataFrame:
    """Most frequent label of the voter columns; a tie takes the tie breaker's label and is flagged."""
    required = required or voters
    if set(voters) != set(required):
        raise ValueError(
            f"voters must be exactly {sorted(required)}; missing {sorted(set(required) - set(voters))}, "
            f"extra {sorted(set(voters) - set(required))}"
        )
    votes = [sum(((F.col(v) == k).cast("int") for v in voters[1:]), (F.col(voters[0]) == k).cast("int")) for k in CLASSES]
    top = F.greatest(*votes)
    leaders = sum(((v == top).cast("int") for v in votes[1:]), (votes[0] == top).cast("int"))
    winner = F.coalesce(*[F.when(v == top, F.lit(k)) for v, k in zip(votes, CLASSES)])
    return df.withColumns(
        {"tie_break": leaders > 1, "predicted_action": F.when(leaders > 1, F.col(tie_breaker)).otherwise(winner)}
    )


def invalid_votes(df: DataFrame, voters: list[str]) -> DataFrame:
    """Rows where a voter's label is not one of the three actions."""
    bad = ~F.coalesce(F.col(voters[0]).isin(*CLASSES), F.lit(False))
    for v in voters[1:]:
        bad = bad | ~F.coalesce(F.col(v).isin(*CLASSES), F.lit(False))
    return df.where(bad)


def assert_votes(df: DataFrame, voters: list[str]) -> None:
    if not invalid_votes(df, voters).isEmpty():
        raise ValueError("majority vote received labels other than " + ", ".join(CLASSES))


def ordinal_combine(df: DataFrame, p_gt_cut: str, p_gt_hold: str) -> DataFrame:
    """Two cumulative probabilities to three class probabilities and the most probable action."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p_gt_cut)))
    b = F.least(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p_gt_hold))), a)
    cut, hold, hike = 1.0 - a, a - b, b
    best = (
        F.when((cut >= hold) & (cut >= hike), "cut").when(hold >= hike, "hold").otherwise("hike")
    )
    return df.withColumns({"p_cut": cut, "p_hold": hold, "p_hike": hike, "predicted_action": best})


def confidence_table(pred: DataFrame, keys: list[str], models: list[str], confidence: str | None = None) -> DataFrame:
    """Probability of the predicted class, with flags for a bad sum and for a differing stored confidence."""
    p = F.coalesce(*[F.when(F.col("predicted_action") == k, F.col(f"p_{k}")) for k in CLASSES])
    total = F.col("p_cut") + F.col("p_hold") + F.col("p_hike")
    rows = pred.where(F.col("model").isin(*models))
    ok = F.coalesce(F.abs(total - 1.0) <= 1e-8 + 1e-5, F.lit(False))
    if confidence is not None:
        ok = ok & F.coalesce(F.abs(F.col(confidence) - p) <= 1e-8 + 1e-5 * F.abs(p), F.lit(False))
    return rows.select(
        *keys, "target_q", "model", "predicted_action", "p_cut", "p_hold", "p_hike", p.alias("confidence"),
        ok.alias("consistent"),
    )


def disagreements(pred: DataFrame, keys: list[str], a: str, b: str, a_text: str, b_text: str, carry: list[str]) -> DataFrame:
    """Rows where two derivations of the label differ, with a sentence saying how."""
    text = F.concat(F.col(a), F.lit(f" from {a_text} vs "), F.col(b), F.lit(f" from {b_text}"))
    return pred.where(F.col(a) != F.col(b)).select(*keys, "target_q", *carry, a, b, text.alias("disagreement"))


def split_audit(df: DataFrame, keys: list[str], label: str, sizes: list[int]) -> DataFrame:
    """Per candidate initial window: class counts and degenerate folds over all expanding folds.

    The fold that tests row r trains on rows before r, so running class counts of earlier rows describe
    every fold; no training window is copied.
    """
    w = over_time(keys)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    counts = {c: F.count_if(F.col(label) == c).over(past) for c in CLASSES}
    rows = df.withColumns(
        {"_pos": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
         **{f"_{c}": e for c, e in counts.items()}}
    )
    fanned = rows.withColumn("initial_size", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
    inside = F.col("_pos") >= F.col("initial_size")
    cut, hold, hike = (F.col(f"_{c}") for c in CLASSES)
    gt_cut_bad = (cut == 0) | (hold + hike == 0)
    gt_hold_bad = (hike == 0) | (cut + hold == 0)
    low = lambda e, name: F.min(F.when(inside, e)).alias(name)
    any_bad = lambda e, text: F.when(F.coalesce(F.max(F.when(inside, e)), F.lit(False)), F.lit(text))
    agg = fanned.groupBy(*keys, "initial_size").agg(
        F.count_if(inside).alias("test_rows"),
        q_label(F.min(F.when(inside, F.col("q_idx")))).alias("first_test_quarter"),
        low(cut, "min_train_cut"), low(hold, "min_train_hold"), low(hike, "min_train_hike"),
        F.count_if(inside & ((cut == 0) | (hold == 0) | (hike == 0))).alias("degenerate_folds"),
        F.array_join(F.array_sort(F.array_compact(F.array(
            any_bad(cut == 0, "cut"), any_bad(hold == 0, "hold"), any_bad(hike == 0, "hike")))), ", ").alias("_dc"),
        low(cut, "min_gt_cut_negative"), low(hold + hike, "min_gt_cut_positive"),
        low(cut + hold, "min_gt_hold_negative"), low(hike, "min_gt_hold_positive"),
        F.count_if(inside & (gt_cut_bad | gt_hold_bad)).alias("degenerate_binary_folds"),
        F.array_join(F.array_compact(F.array(
            any_bad(gt_cut_bad, "Y>cut"), any_bad(gt_hold_bad, "Y>hold"))), ", ").alias("_db"),
    )
    empty = F.col("test_rows") == 0
    name = lambda c: F.when(empty, "invalid_no_test_rows").when(F.col(c) == "", "none").otherwise(F.col(c))
    return agg.withColumns(
        {"degenerate_classes": name("_dc"), "degenerate_binary_problems": name("_db")}
    ).drop("_dc", "_db")


def choose_split(audit: DataFrame, keys: list[str], floor: int) -> DataFrame:
    """Smallest clean candidate at or above the floor; NULL when there is none."""
    clean = (
        (F.col("initial_size") >= floor) & (F.col("test_rows") > 0)
        & (F.col("degenerate_folds") == 0) & (F.col("degenerate_binary_folds") == 0)
    )
    return audit.groupBy(*keys).agg(
        F.min(F.when(clean, F.col("initial_size"))).alias("chosen_size"),
        F.min_by("test_rows", F.when(clean, F.col("initial_size"))).alias("test_rows"),
    )


def assert_split(chosen: DataFrame) -> None:
    if not chosen.where(F.col("chosen_size").isNull()).isEmpty():
        raise ValueError("no candidate split avoids degenerate training folds")


def condensed_audit(audit: DataFrame, keys: list[str], chosen: DataFrame) -> DataFrame:
    """Degenerate rows, the first clean row, the chosen row and the last row, each once."""
    w = W.partitionBy(*keys)
    bad = F.col("degenerate_folds") != 0
    marked = audit.join(chosen.select(*keys, "chosen_size"), keys, "left").withColumns(
        {
            "_last": F.max("initial_size").over(w),
            "_first_clean": F.min(F.when(~bad, F.col("initial_size"))).over(w),
        }
    )
    keep = bad | F.col("initial_size").isin(F.col("_last")) | (
        F.col("initial_size") == F.col("_first_clean")
    ) | (F.col("initial_size") == F.col("chosen_size"))
    return marked.where(keep).withColumn(
        "is_chosen", F.coalesce(F.col("initial_size") == F.col("chosen_size"), F.lit(False))
    ).drop("_last", "_first_clean", "chosen_size")


def confusion(pred: DataFrame, keys: list[str], actual: str = "actual_action", predicted: str = "predicted_action") -> DataFrame:
    """Counts per actual class with one column per predicted class; absent actual classes give zero rows."""
    cells = pred.groupBy(*keys, "model").agg(
        *[F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(f"{a}_{p}") for a in CLASSES for p in CLASSES]
    )
    rows = F.array(*[
        F.struct(F.lit(a).alias("actual"), *[F.col(f"{a}_{p}").alias(p) for p in CLASSES]) for a in CLASSES
    ])
    return cells.select(*keys, "model", F.explode(rows).alias("_r")).select(*keys, "model", "_r.*")


def class_metrics(pred: DataFrame, keys: list[str], actual: str = "actual_action", predicted: str = "predicted_action") -> DataFrame:
    """Macro-F1 over all three classes (an absent class scores 0), accuracy and n per model."""
    a, p = F.col(actual), F.col(predicted)
    f1 = [
        F.coalesce(
            F.try_divide(2.0 * F.count_if((a == k) & (p == k)), F.count_if(a == k) + F.count_if(p == k)), F.lit(0.0)
        )
        for k in CLASSES
    ]
    return pred.groupBy(*keys, "model").agg(
        ((f1[0] + f1[1] + f1[2]) / 3.0).alias("macro_f1"),
        F.avg((a == p).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"),
    )


def rank_class_metrics(metrics: DataFrame, keys: list[str], model_order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("macro_f1"), rank_of("model", model_order), "model")
    return metrics.withColumn("rank", F.row_number().over(w))


def diagnostics(pred: DataFrame, keys: list[str], ols_model: str, vote_model: str) -> DataFrame:
    """Per entity: rows with a large coefficient, their share, and tie breaks of the vote."""
    unstable = (F.col("model") == ols_model) & (F.coalesce("unstable_coefficients", F.lit("")) != "")
    return pred.groupBy(*keys).agg(
        F.count_if(F.col("model") == ols_model).alias("ols_rows"), F.count_if(unstable).alias("unstable_rows"),
        F.count_if((F.col("model") == vote_model) & F.coalesce("tie_break", F.lit(False))).alias("tie_breaks"),
        F.count_distinct(F.when(unstable, F.col("unstable_coefficients"))).alias("unstable_kinds"),
    )
