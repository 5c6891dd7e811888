"""Walk-forward backtests of user callables: forecasts from a training frame, and simulated draws per origin.

Origins, targets and training rows are decided by window expressions; only the callable itself runs in Python.
The origins of an entity are dealt out in chunks of ``origins_per_task``, each with the training rows up to its
last origin, so a long entity spreads over tasks. Rows stream through in order of entity, chunk and time, and an
origin's results go out as they come: a task holds the rows of one chunk and the result of one origin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from panelcast.operators.align import over_time
from panelcast.operators.intervals import with_scores
from panelcast.operators.skew import bounded_quantiles


def _number(c: str):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def origin_chunks(
    df: DataFrame, keys: list[str], value: str, inputs: list[str], initial: int, horizons: list[int],
    skip_origins: int = 0, max_origins: int | None = None, origins_per_task: int = 32,
) -> DataFrame:
    """Training rows and origins of each (keys, _chunk).

    A row has q_idx, the value, the inputs, whether all of these are there (``_whole``) and, if it is an origin of
    this chunk, the number of origins completed before it (``_done``) with target quarter and actual of every
    horizon (``_t1, _a1, ...``). An origin is a row with a value, at least ``initial`` of them up to it, all
    horizons ahead, and at least ``initial`` whole rows up to it. Of these the first ``skip_origins`` are passed
    over without counting, and ``max_origins`` are kept. NaN counts as missing.
    """
    if not horizons or min(horizons) < 1 or initial < 1 or skip_origins < 0 or origins_per_task < 1 or (max_origins is not None and max_origins < 1):
        raise ValueError("horizons, initial, max_origins and origins_per_task must be positive, skip_origins at least 0")
    w = over_time(keys)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    rows = df.select(*keys, "q_idx", *[_number(c).alias(c) for c in (value, *inputs)]).where(F.col(value).isNotNull())
    whole = F.lit(True)
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    marked = rows.withColumns(
        {
            "_whole": whole, "_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
            **{f"_t{h}": F.lead("q_idx", h).over(w) for h in horizons}, **{f"_a{h}": F.lead(value, h).over(w) for h in horizons},
        }
    ).withColumn("_used", F.count_if("_whole").over(so_far))
    origin = (F.col("_rn") >= initial) & (F.col("_rn") <= F.col("_n") - max(horizons)) & (F.col("_used") >= initial)
    marked = marked.withColumn("_at", origin).withColumn("_done", F.count_if("_at").over(so_far) - 1 - skip_origins)
    kept = F.col("_at") & (F.col("_done") >= 0)
    if max_origins is not None:
        kept = kept & (F.col("_done") < max_origins)
    marked = marked.withColumn("_own", F.when(kept, F.floor(F.col("_done") / origins_per_task).cast("int")))
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    spans = marked.withColumns({"_from": F.min("_own").over(ahead), "_to": F.max("_own").over(W.partitionBy(*keys))})
    spread = spans.where(F.col("_from").isNotNull() & (F.col("_whole") | F.col("_own").isNotNull()))
    spread = spread.withColumn("_chunk", F.explode(F.sequence("_from", "_to")))
    done = F.when(F.col("_own") == F.col("_chunk"), F.col("_done")).alias("_done")
    return spread.select(*keys, "_chunk", "q_idx", value, *inputs, "_whole", done, *[f"_{k}{h}" for h in horizons for k in "ta"])


def _run_chunks(chunks: DataFrame, keys: list[str], schema: T.StructType, each: Callable) -> DataFrame:
    """``each(head, train, origin)`` frames for every origin, in streamed batches; ``train`` has the whole rows up to it."""
    order = [*keys, "_chunk", "q_idx"]
    names = schema.fieldNames()

    def one(group) -> Iterator:
        head = {k: group[k].iloc[0] for k in keys}
        for at in group["_done"].notna().to_numpy().nonzero()[0]:
            seen = group.iloc[: at + 1]
            yield each(head, seen[seen["_whole"]], group.iloc[at])[names]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held, name = [], None
        for pdf in batches:
            for this, part in pdf.groupby([*keys, "_chunk"], sort=False, dropna=False):
                this = tuple(None if pd.isna(x) else x for x in this)
                if held and this != name:
                    yield from one(pd.concat(held, ignore_index=True))
                    held = []
                name = this
                held.append(part)
        if held:
            yield from one(pd.concat(held, ignore_index=True))

    dealt = chunks.repartition(*[F.col(c) for c in (*keys, "_chunk")]).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, schema)


def _schema(df: DataFrame, keys: list[str], more: list[T.StructField]) -> T.StructType:
    ints = [T.StructField(c, T.IntegerType()) for c in ("origin_q", "target_q", "horizon")]
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("model", T.StringType()), *ints, *more])


def _grid(head: dict, model: str, origin, horizons: list[int]) -> dict:
    """Columns that every result of an origin shares, one entry per horizon."""
    return {
        **{k: [v] * len(horizons) for k, v in head.items()}, "model": [model] * len(horizons), "origin_q": [int(origin["q_idx"])] * len(horizons),
        "target_q": [int(origin[f"_t{h}"]) for h in horizons], "horizon": horizons, "actual": [float(origin[f"_a{h}"]) for h in horizons],
    }


def walk_forward_frames(
    df: DataFrame, keys: list[str], value: str, inputs: list[str], initial: int, horizons: list[int], forecast: Callable, model: str,
    skip_origins: int = 0, max_origins: int | None = None, origins_per_task: int = 32,
) -> DataFrame:
    """Backtest of ``forecast(train, steps) -> values`` on a training frame with inputs.

    ``train`` is a pandas frame indexed by q_idx with the value and the inputs, whole rows up to the origin only:
    no later row ever reaches the callable. It must give at least ``steps`` finite values, the largest horizon.
    Blocks of origins: see :func:`origin_chunks`. Returns keys, model, origin_q, target_q, horizon, actual,
    forecast, error.
    """
    top = max(horizons, default=0)
    more = [T.StructField(c, T.DoubleType()) for c in ("actual", "forecast")]

    def each(head, train, origin):
        import numpy as np
        import pandas as pd

        path = np.asarray(pd.Series(forecast(train.set_index("q_idx")[[value, *inputs]], top)), dtype=float)
        if len(path) < top:
            raise ValueError(f"the forecaster gave {len(path)} values of {top}")
        if not np.isfinite(path[:top]).all():
            raise ValueError("the forecaster gave values that are not finite")
        return pd.DataFrame({**_grid(head, model, origin, list(horizons)), "forecast": [float(path[h - 1]) for h in horizons]})

    chunks = origin_chunks(df, keys, value, inputs, initial, horizons, skip_origins, max_origins, origins_per_task)
    out = _run_chunks(chunks, keys, _schema(df, keys, more), each)
    return out.withColumn("error", F.col("actual") - F.col("forecast"))


def walk_forward_draws(
    df: DataFrame, keys: list[str], value: str, initial: int, horizons: list[int], simulate: Callable, model: str, n_sims: int, seed: int,
    inputs: list[str] | None = None, skip_origins: int = 0, max_origins: int | None = None, origins_per_task: int = 8,
) -> DataFrame:
    """Draws of ``simulate(train, steps, n_sims, seed) -> array [n_sims, steps]`` at every origin, a row per draw.

    ``train`` is the value's series indexed by q_idx or, with ``inputs``, a frame of whole rows. An origin's seed is
    ``seed`` plus the number of origins completed before it in its entity; skipped ones do not count. The array
    must be finite and hold at least n_sims rows and the largest horizon's columns; more are left out. Returns
    keys, model, origin_q, target_q, horizon, actual, draw_id (from 0), value.
    """
    if n_sims < 1:
        raise ValueError("n_sims must be at least 1")
    top = max(horizons, default=0)
    more = [T.StructField("actual", T.DoubleType()), T.StructField("draw_id", T.IntegerType()), T.StructField("value", T.DoubleType())]

    def each(head, train, origin):
        import numpy as np
        import pandas as pd

        rows = train.set_index("q_idx")
        paths = np.asarray(simulate(rows[[value, *inputs]] if inputs else rows[value], top, n_sims, seed + int(origin["_done"])), dtype=float)
        if paths.ndim != 2 or paths.shape[0] < n_sims or paths.shape[1] < top:
            raise ValueError(f"the simulator gave an array of {paths.shape}, not {n_sims} draws of {top} steps")
        if not np.isfinite(paths[:, :top]).all():
            raise ValueError("the simulator gave values that are not finite")
        grid = pd.DataFrame(_grid(head, model, origin, list(horizons)))
        wide = paths[:n_sims][:, [h - 1 for h in horizons]]
        return grid.loc[grid.index.repeat(n_sims)].assign(draw_id=np.tile(np.arange(n_sims), len(horizons)), value=wide.T.ravel())

    chunks = origin_chunks(df, keys, value, inputs or [], initial, horizons, skip_origins, max_origins, origins_per_task)
    return _run_chunks(chunks, keys, _schema(df, keys, more), each)


def interval_backtest(draws: DataFrame, keys: list[str], lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Interval, hit, width and nonconformity score of every origin and horizon of :func:`walk_forward_draws`.

    The draws of a cell are as many as were simulated, so one aggregation takes their quantiles.
    """
    if not 0 <= lo < hi <= 1:
        raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
    ids = [*keys, "model", "origin_q", "target_q", "horizon", "actual"]
    return with_scores(bounded_quantiles(draws, ids, "value", {"interval_lower": lo, "point_forecast": 0.5, "interval_upper": hi}))
