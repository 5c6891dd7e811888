"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value significance."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import worker_cache, written

PER_CLASS = 15_000  # about so many labelled documents of either class fit the model
PRIOR = 0.05  # strength of the Dirichlet prior, in documents per labelled document
LEAST_Z = 3.0
PREFIXES = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings that stand in for words the labels do not show
DRIFT = 0.25  # taken from every word, so that a segment must earn its length
SIGNIFICANT = 0.01
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    """Weights by word or ``beginning*``, the null law's rate and scale, the calibration, the share of toxic labels."""

    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 0.01
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class Lookup(dict):
    """Score of a run of signs between white space; fills itself and starts anew when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def word(self, w: str) -> float:
        if (own := self.weights.get(w)) is not None:
            return own - DRIFT
        for n in reversed(PREFIXES):
            if len(w) > n and (own := self.weights.get(w[:n] + "*")) is not None:
                return own - DRIFT
        return -DRIFT

    def __missing__(self, raw: str) -> float:
        found = [self.word(w) for w in _WORD.findall(raw)]
        score = sum(found) if found else 0.0
        if len(raw) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[raw] = score
        return score


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, disjoint, in linear time.

    Candidates are kept with their running totals left and right; a new positive score joins back to the last
    candidate that began lower, while its end is higher.
    """
    total, kept, back = 0.0, [], []
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = at, before
        # the nearest candidate to the left whose own left total is lower; ``back`` links each one to its own
        j = len(kept) - 1
        while j >= 0 and kept[j][2] >= left:
            j = back[j]
        while j >= 0 and kept[j][3] < total:
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
            j = back[j]
            del back[len(kept):]
            while j >= 0 and kept[j][2] >= left:
                j = back[j]
        del back[len(kept):]
        kept.append((start, at + 1, left, total))
        back.append(j)
    return [(a, b, r - x) for a, b, x, r in kept]


def passages(model: Model, text: str, lookup: Lookup) -> tuple[int, float, float, list[tuple[int, int, float]]]:
    """(words, highest normalised score, sum of significant normalised scores, significant segments)."""
    scores = list(map(lookup.__getitem__, text.lower().split()))
    n = len(scores)
    if not n or max(scores) <= 0:
        return n, 0.0, 0.0, []
    edge = math.log(model.scale * n)
    found = [(a, b, model.rate * s - edge) for a, b, s in segments(scores)]
    # chance that clean text of this length has such a segment: 1 - exp(-exp(-normalised))
    bar = -math.log(-math.log1p(-SIGNIFICANT))
    strong = [f for f in found if f[2] > bar]
    return n, max(0.0, max(f[2] for f in found)), sum(f[2] for f in strong), strong


def probability(model: Model, top: float, total: float) -> float:
    a, b, c = model.curve
    x = a + b * math.log1p(max(top, 0.0)) + c * math.log1p(max(total, 0.0))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _lookup(model: Model) -> Lookup:
    cache = worker_cache("toxicity")
    if model.key not in cache:
        cache.clear()
        cache[model.key] = Lookup(model.weights)
    return cache[model.key]


def word_weights(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of words and word beginnings in toxic against clean documents (doc_id, text, toxic).

    Counts are documents; the prior spreads PRIOR documents per document by overall frequency. Kept is every
    weight with |z| of LEAST_Z at least; the sample is bounded in documents, and so are these.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    def beginnings(n: int):
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    begin = [beginnings(n) for n in PREFIXES]
    terms = sample.select("toxic", F.explode(F.array_distinct(F.concat(words, *begin))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c >= 3")
    prior = PRIOR * (toxic + clean)
    own = F.lit(prior / (toxic + clean)) * (F.col("t") + F.col("c"))
    t, c = F.col("t") + own, F.col("c") + own
    delta = F.log(t / (toxic + prior + 0.5 - t)) - F.log(c / (clean + prior + 0.5 - c))
    rated = counts.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / t + 1 / c))
    return {r.term: round(r.delta, 6) for r in rated.where(F.abs("z") >= LEAST_Z).select("term", "delta").collect()}


def _null_law(top: list[tuple[float, int]]) -> tuple[float, float]:
    """Rate and scale of the law of the highest segment score in clean documents of n words, by maximum
    likelihood: P(score < x) = exp(-scale n exp(-rate x))."""
    import numpy as np

    x, n = np.array([t[0] for t in top]), np.array([max(t[1], 1) for t in top], float)
    if len(x) < 10 or x.std() < 1e-6:
        return 1.0, 0.01
    rates = np.geomspace(0.02, 20, 200)
    scale = np.array([len(x) / np.sum(n * np.exp(-r * x)) for r in rates])
    fit = [len(x) * (math.log(r) + math.log(k)) - r * x.sum() for r, k in zip(rates, scale)]
    at = int(np.argmax(fit))
    return float(rates[at]), float(scale[at])


def _curve(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic regression with a small ridge on the logs of highest and summed normalised scores."""
    import numpy as np

    x = np.array([[1.0, math.log1p(max(a, 0.0)), math.log1p(max(b, 0.0))] for a, b, _ in rows])
    y, w = np.array([r[2] for r in rows], float), np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1; others are ignored).

    About ``per_class`` documents of either class are taken by the hash of their id; all words of these count.
    Of repeated labels the higher holds. With one class only, or none, the model knows no words and gives every
    text the share of toxic labels.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(share=1.0 if toxic else 0.0)
    part = lambda n: min(1.0, per_class / n)
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about twice per_class ids of 12 bytes, whatever the table's size
    taken = known.where(draw < F.when(F.col("toxic") == 1, part(toxic)).otherwise(part(clean)))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = written(texts.join(F.broadcast(taken), "_id").select(F.col("_id").alias("doc_id"), "text", "toxic"))
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(share=float(sizes.get(1, 0) > 0))
    model = Model(weights=word_weights(sample, sizes[1], sizes[0]), share=sizes[1] / sum(sizes.values()))
    raw = Model(weights=model.weights, rate=1.0, scale=1.0)  # normalised score = segment score - log n

    def measure(m: Model) -> list[tuple]:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            lookup = _lookup(m)
            for b in batches:
                out = [passages(m, t, lookup)[:3] + (y,) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64(), pa.int32()))], ["n", "top", "total", "toxic"])

        rows = sample.select("text", "toxic").mapInArrow(run, "n long, top double, total double, toxic int")
        return [tuple(r) for r in rows.collect()]  # four numbers of each sampled document

    tops = [(top + math.log(n) if top > 0 else 0.0, n) for n, top, _, y in measure(raw) if y == 0 and n]
    rate, scale = _null_law(tops)
    model = Model(model.weights, rate, scale, share=model.share)
    curve = _curve([(top, total, y) for _, top, total, y in measure(model)])
    return Model(model.weights, rate, scale, curve, model.share)


def score(docs: DataFrame, model: Model, column: str = "toxicity", spans: bool = False) -> DataFrame:
    """``docs`` with all its columns and ``column``: the probability of being toxic, 0 to 1.

    With ``spans`` also ``<column>_passages``: first word, word after the last and normalised score of every
    significant passage. Each row is scored by its text alone; null counts as empty, which has no passage.
    Columns of ``docs`` that have the names of the new ones are replaced.
    """
    docs = docs.drop(column, *[f"{column}_passages"] * spans)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    place = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lookup = _lookup(model)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            scores, found = [], []
            for t in b.column(place).to_pylist():
                _, top, total, strong = passages(model, t or "", lookup)
                scores.append(probability(model, top, total) if model.weights else model.share)
                found.append([{"first": x, "after": y, "score": s} for x, y, s in strong])
            more = [pa.array(scores, pa.float64())] + ([pa.array(found, kind)] if spans else [])
            yield pa.RecordBatch.from_arrays(b.columns + more, b.schema.names + [column] + [f"{column}_passages"] * spans)

    out = f"{fields}, `{column}` double" + (f", `{column}_passages` array<struct<first: int, after: int, score: double>>" if spans else "")
    return docs.mapInArrow(run, out)


def drop_toxic(docs: DataFrame, model: Model, bar: float = 0.7) -> DataFrame:
    """``docs`` with its columns, without rows that score ``bar`` or more."""
    column = "_toxicity"
    while column in docs.columns:
        column += "_"
    return score(docs, model, column).where(F.col(column) < bar).select(*[F.col(f"`{c}`") for c in docs.columns])
