"""Boosted trees for several outcomes and training windows at once, from shared gradient histograms.

All models of a walk-forward, one per outcome and fold, grow together. A pass over the table sums gradients and
curvatures into a histogram keyed by model, node, feature and bin: one pass a tree level, however many models there
are. Sums are of whole numbers, so they do not depend on how rows are dealt to tasks. Only histograms (models x
nodes x features x bins) and trees come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.sources.stage import written

UNIT = 1 << 30  # gradients are summed as multiples of 1 / UNIT
RESTAGE = 10  # trees after which the scores so far are written with the rows


@dataclass(frozen=True)
class Settings:
    """Default boosting settings."""

    trees: int = 50
    depth: int = 2
    step: float = 0.05
    subsample: float = 0.75
    columns: float = 0.75
    min_weight: float = 3.0
    l1: float = 0.1
    l2: float = 2.0
    bins: int = 64
    seed: int = 42
    one_sided: bool = False  # whether training rows with only one outcome are fitted, too


def _mix(x):
    """A bijective finisher on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(row, tree: int, s: Settings):
    """Which rows, given by a hash, a tree sees."""
    if s.subsample >= 1:
        return np.ones(len(row), bool)
    return _mix(row ^ _mix(np.array([s.seed * 1_000_003 + tree], np.uint64))) < np.uint64(int(s.subsample * (1 << 64)))


def columns_of(tree: int, n: int, s: Settings) -> list[int]:
    """The features a tree may split on."""
    order = _mix(np.arange(n, dtype=np.uint64) + np.uint64(1) + _mix(np.array([s.seed * 1_000_003 + tree + (1 << 40)], np.uint64)))
    return sorted(np.argsort(order, kind="stable")[: max(1, int(s.columns * n))].tolist())


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def weight(g: float, h: float, s: Settings) -> float:
    return float(-soft(g, s.l1) / (h + s.l2) * s.step)


def best_split(g, h, s: Settings, allowed: list[int]) -> tuple[int, int] | None:
    """(feature, bin) after which a node is cut, from its histograms [feature, bin]; ties go to the first."""
    worth = lambda a, b: soft(a, s.l1) ** 2 / (b + s.l2)
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
    gain = np.where((left_h >= s.min_weight) & (all_h - left_h >= s.min_weight), np.round(gain, 9), 0.0)[allowed]
    if not gain.size or gain.max() <= 0:
        return None
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return allowed[f], int(b)


@dataclass
class Boosted:
    """Trees of every (fold, outcome); a node's children are 2 n and 2 n + 1, the root is 1."""

    features: list[str]
    outcomes: list[str]
    folds: list[int]
    settings: Settings
    cuts: dict  # (fold, feature number) -> ascending cut points
    trees: list  # per model a list of trees {node: (feature number, bin) or leaf value}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node: fold, outcome, tree, node, feature and cut (at most the cut goes left) or a leaf's value."""
        rows = []
        for m, own in enumerate(self.trees):
            fold, outcome = self.folds[m // len(self.outcomes)], self.outcomes[m % len(self.outcomes)]
            for t, tree in enumerate(own):
                for node, what in tree.items():
                    if isinstance(what, tuple):
                        rows.append((fold, outcome, t, node, self.features[what[0]], float(self.cuts[fold, what[0]][what[1]]), None))
                    else:
                        rows.append((fold, outcome, t, node, None, None, what))
        return spark.createDataFrame(rows, "fold int, outcome string, tree int, node int, feature string, cut double, value double")

    def predict(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        """``df`` with p_<outcome>, the probability under the models of the row's ``fold`` (or of the only fold).

        Rows without a feature, or of a fold that has no model, are left out.
        """
        probs = [f"p_{o}" for o in self.outcomes]
        own = F.col(fold).cast("int") if fold else F.lit(self.folds[0])
        rows = df.dropna(subset=self.features).where(own.isin(self.folds)).select(*df.columns, F.array(*[F.col(f).cast("double") for f in self.features]).alias("_x"), own.alias("_f"))
        schema = T.StructType([*df.schema.fields, *[T.StructField(p, T.DoubleType()) for p in probs]])
        me = self

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                n = b.num_columns - 2
                x = b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                of = b.column(n + 1).to_numpy()
                out = np.zeros((len(me.outcomes), b.num_rows))
                for m, trees in enumerate(me.trees):
                    at, o = np.flatnonzero(of == me.folds[m // len(me.outcomes)]), m % len(me.outcomes)
                    bins = _bins(x[at], me.cuts, me.folds[m // len(me.outcomes)])
                    out[o, at] = 1 / (1 + np.exp(-sum((_values(t, bins, me.settings.depth) for t in trees), np.zeros(len(at)))))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, out)], schema=None, names=schema.fieldNames())

        return rows.mapInArrow(run, schema)


def _bins(x, cuts: dict, fold: int):
    """The bin of every value: how many cut points lie below it."""
    return np.stack([np.searchsorted(cuts[fold, f], x[:, f], "left") for f in range(x.shape[1])], axis=1)


def _nodes(tree: dict, bins, depth: int):
    """The node of ``tree`` in which each row ends."""
    node = np.ones(len(bins), np.int64)
    for _ in range(depth):
        for n, what in tree.items():
            if isinstance(what, tuple):
                here = np.flatnonzero(node == n)
                if len(here):
                    node[here] = 2 * n + (bins[here, what[0]] > what[1])
    return node


def _values(tree: dict, bins, depth: int):
    node = _nodes(tree, bins, depth)
    out = np.zeros(len(bins))
    for n, what in tree.items():
        if not isinstance(what, tuple):
            out[node == n] = what
    return out


def cut_points(rows: DataFrame, features: list[str], folds: list[int], bins: int) -> dict:
    """Cut points per (fold, feature number), from the fold's training rows alone.

    A feature with at most ``bins`` different values has them all; others have evenly spaced approximate quantiles.
    """
    out, wide = {}, []
    for f, name in enumerate(features):
        first = rows.groupBy(F.col(name).alias("x")).agg(F.min("_block").alias("b")).limit(bins + 1).collect()
        if len(first) > bins:
            wide.append(f)
        for k in folds:
            out[k, f] = np.array(sorted(r.x for r in first if r.b < k)[:-1])
    if wide:
        steps = [(i + 1) / bins for i in range(bins - 1)]
        aggs = [F.percentile_approx(F.when(F.col("_block") < k, F.col(features[f])), steps, 10_000).alias(f"c{k}_{f}") for k in folds for f in wide]
        found = rows.agg(*aggs).first()
        for k in folds:
            for f in wide:
                out[k, f] = np.unique(np.array(found[f"c{k}_{f}"] or [], float))
    return out


def fit(df: DataFrame, features: list[str], outcomes: list[str], block: str | None = None, folds: list[int] | None = None, settings: Settings = Settings()) -> Boosted:
    """Boosted trees (logistic loss) per fold and outcome; a fold's models learn from rows whose ``block`` is below it.

    ``outcomes`` are 0/1 columns. Without ``block`` there is one fold with all rows. Rows that lack a feature or an
    outcome are not used. Which rows and features a tree sees follows from hashes of the rows and the seed. Raises
    where a fold's training rows have only one outcome, or there are none; with ``one_sided`` only where there are
    none: trees of one outcome have no split, and each moves all rows towards it by a step.
    """
    s, folds = settings, folds or [1]
    use = df.dropna(subset=[*features, *outcomes])
    near = F.col(block).cast("int") if block else F.lit(0)
    rows = use.where(near < max(folds)).select(
        *[F.col(f).cast("double").alias(f) for f in features], *[F.col(o).cast("int").alias(o) for o in outcomes], near.alias("_block"), F.xxhash64(*use.columns).alias("_row")
    )
    rows = written(rows)
    sides = rows.agg(*[agg(F.when(F.col("_block") < k, F.col(o))).alias(f"{name}{k}{o}") for k in folds for o in outcomes for name, agg in (("a", F.min), ("b", F.max))]).first()
    for k in folds:
        for o in outcomes:
            if sides[f"a{k}{o}"] == sides[f"b{k}{o}"] and not (s.one_sided and sides[f"a{k}{o}"] is not None):
                raise ValueError(f"training rows of fold {k} have only one outcome for {o.strip('_')}")
    cuts = cut_points(rows, features, folds, s.bins)
    models = [(k, o) for k in folds for o in range(len(outcomes))]
    grown = Boosted(list(features), list(outcomes), list(folds), s, cuts, [[] for _ in models])
    staged, done = rows.withColumn("_score", F.array(*[F.lit(0.0)] * len(models))), 0
    for t in range(s.trees):
        if t - done == RESTAGE:
            staged, done = written(_with_scores(staged, grown, done, t)), t
        trees: list[dict] = [{} for _ in models]
        leaves: list[dict] = [{} for _ in models]
        allowed = columns_of(t, len(features), s)
        for level in range(s.depth):
            g, h = _histograms(staged, grown, done, t, trees, level)
            for m in range(len(models)):
                for at in range(1 << level):
                    node = (1 << level) + at
                    if level and not isinstance(trees[m].get(node >> 1), tuple):
                        continue
                    split = best_split(g[m, at], h[m, at], s, allowed)
                    if level == 0:
                        leaves[m][node] = weight(g[m, at, 0].sum(), h[m, at, 0].sum(), s)
                    if split is None:
                        continue
                    trees[m][node] = split
                    leaves[m].pop(node)
                    f, b = split
                    for child, part in ((2 * node, slice(0, b + 1)), (2 * node + 1, slice(b + 1, None))):
                        leaves[m][child] = weight(g[m, at, f, part].sum(), h[m, at, f, part].sum(), s)
        for m in range(len(models)):
            grown.trees[m].append({**trees[m], **leaves[m]})
    return grown


def _batch(b, grown: Boosted, done: int, upto: int):
    """Of a batch: bins per fold, outcomes, blocks, row hashes, and scores under the trees before ``upto``."""
    n_f, n_o = len(grown.features), len(grown.outcomes)
    x = np.stack([b.column(i).to_numpy() for i in range(n_f)], axis=1)
    y = [b.column(n_f + i).to_numpy() for i in range(n_o)]
    block, row = b.column(n_f + n_o).to_numpy(), b.column(n_f + n_o + 1).to_numpy().view(np.uint64)
    score = b.column(n_f + n_o + 2).flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1).copy()
    bins = {k: _bins(x, grown.cuts, k) for k in grown.folds}
    for m, trees in enumerate(grown.trees):
        for tree in trees[done:upto]:
            score[:, m] += _values(tree, bins[grown.folds[m // n_o]], grown.settings.depth)
    return bins, y, block, row, score


def _with_scores(staged: DataFrame, grown: Boosted, done: int, upto: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            score = _batch(b, grown, done, upto)[4]
            ends = np.arange(len(score) + 1, dtype=np.int32) * score.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(score.ravel()))], names=b.schema.names)

    return staged.mapInArrow(run, staged.schema)


def _histograms(staged: DataFrame, grown: Boosted, done: int, tree: int, trees: list[dict], level: int):
    """Sums of gradients and curvatures [model, node of the level, feature, bin], in one pass for all models."""
    s, n_o, n_f = grown.settings, len(grown.outcomes), len(grown.features)
    shape = (len(grown.trees), 1 << level, n_f, s.bins)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((2, int(np.prod(shape))), np.int64)
        for b in batches:
            bins, y, block, row, score = _batch(b, grown, done, tree)
            seen = sampled(row, tree, s)
            for m in range(shape[0]):
                k = grown.folds[m // n_o]
                own = np.flatnonzero(seen & (block < k))
                node = _nodes(trees[m], bins[k][own], level) - (1 << level)
                own, node = own[node >= 0], node[node >= 0]  # rows that have not ended in a leaf above
                p = 1 / (1 + np.exp(-score[own, m]))
                parts = np.rint((p - y[m % n_o][own]) * UNIT), np.rint(p * (1 - p) * UNIT)
                for f in range(n_f):
                    at = ((m * shape[1] + node) * n_f + f) * s.bins + bins[k][own, f]
                    for i, v in enumerate(parts):
                        total[i] += np.bincount(at, weights=v, minlength=total.shape[1]).astype(np.int64)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["at", "g", "h"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("g", "h")]
    out = np.zeros((2, int(np.prod(shape))))
    for r in staged.mapInArrow(run, "at long, g long, h long").groupBy("at").agg(*whole).collect():
        out[:, r["at"]] = float(r.g) / UNIT, float(r.h) / UNIT
    return out.reshape(2, *shape)
