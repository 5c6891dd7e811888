"""Secret scans: candidates by pattern, false positives removed by a random forest on what they look like.

DataFrame functions and JVM-side models only.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelcast.llm.common import maybe_in, salted_join, written

#: A candidate: sixteen or more signs of the kinds that keys are made of, or a run of twelve to fifteen with a digit.
#: Equals signs belong to it as padding, not where a value follows them.
_SIGN = r"[A-Za-z0-9_/+.\-]"
VALUE = rf"(?<!{_SIGN})(?={_SIGN}{{12}})(?:{_SIGN}{{16,}}|(?=[A-Za-z_/+.\-]*[0-9]){_SIGN}{{12,15}})(?:={{1,2}}(?![A-Za-z0-9_/+.\-=]))?"
BEFORE, AFTER = 48, 24  # code points of the text on either side that a candidate is judged by
#: Words before a candidate that speak for a secret, and places that speak for or against one. Fixed values.
KEY_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private)[^A-Za-z0-9]{0,12}$"
CONFIG_PATH = r"(?i)(config|secret|cred|\.env|\.pem|\.ya?ml|\.ini|\.properties)"
TRIAL_PATH = r"(?i)(test|example|sample|mock|doc)"
FEATURES = [
    "length", "transitions", "digits", "uppers", "lowers", "distinct_signs", "pairs", "dictionary", "slashes", "dots",
    "config_path", "trial_path", "key_word", "assigned", "quoted", "word_before", "word_after",
]
TRAINING_ROWS = 20_000  # labelled findings of either class that fit the forest, at most about
COMMON_WORD = 3  # documents that hold a word of the dictionary
COMMON_PAIRS = 300  # letter pairs that count as usual, of at most 676


def _row_key() -> Column:
    """Names a row by id and text, whatever is null; repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def candidates(docs: DataFrame, path: str | None = "source") -> DataFrame:
    """One row per candidate: _key, doc_id, start (code points before it), value, before, after, path.

    Whole texts are cut at the candidates once; places are running sums of the lengths. ``before`` and ``after``
    are the BEFORE and AFTER code points of the text beside the value, other candidates included: as each has at
    least twelve, the last four and next two hold enough. Repeated rows give their candidates once; null and
    empty texts have none; a missing ``path`` column counts as null.
    """
    where = F.col(path).cast("string") if path and path in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", where.alias("path")).where(F.col("text").rlike(VALUE))
    rows = rows.select(_row_key().alias("_key"), "doc_id", "path", F.split("text", VALUE, -1).alias("_gaps"), F.regexp_extract_all("text", F.lit(VALUE), F.lit(0)).alias("_values"))
    gap, value = (lambda i: F.get("_gaps", i)), (lambda i: F.get("_values", i))
    ending = lambda i: F.concat_ws("", *[F.right(part(i - k), F.lit(BEFORE)) for k in range(4, 0, -1) for part in (gap, value)], F.right(gap(i), F.lit(BEFORE)))
    opening = lambda i: F.concat_ws("", *[F.left(part(i + k), F.lit(AFTER)) for k in (1, 2) for part in (gap, value)])
    found = F.transform("_values", lambda v, i: F.struct(
        i.alias("i"), v.alias("value"), F.length(gap(i)).alias("gap"),
        F.right(ending(i), F.lit(BEFORE)).alias("before"), F.left(opening(i), F.lit(AFTER)).alias("after"),
    ))
    each = rows.select("_key", "doc_id", "path", F.explode(found).alias("c")).groupBy("_key", F.col("c.i").alias("i")).agg(
        F.min("doc_id").alias("doc_id"), F.min("path").alias("path"), F.first("c").alias("c"))
    passed = W.partitionBy("_key").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("c.gap") + F.length("c.value")).over(passed), F.lit(0)) + F.col("c.gap")
    return each.select("_key", "doc_id", start.cast("long").alias("start"), "c.value", "c.before", "c.after", "path")


def _letters(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), "[^a-z]+"), lambda w: F.length(w) >= 4)


def dictionary(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Words of letters, of those inside the candidates, that at least COMMON_WORD documents hold.

    A bit filter spares the shuffle most other words; the join then leaves exactly the wanted ones, so that
    unrelated text changes no feature.
    """
    wanted = written(found.select(F.explode(F.array_distinct(_letters(F.col("value")))).alias("word")).distinct().withColumn("_h", F.xxhash64("word")))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", VALUE, " ")), r"[^\p{L}]+"))).alias("word"))
    own = docs.select(F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("text", F.lit(VALUE), F.lit(0)), lambda v: F.filter(F.split(F.lower(v), r"[^\p{L}]+"), lambda w: w.rlike("^[a-z]{4,}$")))))).alias("word"))
    both = maybe_in(words.unionByName(own).withColumn("_h", F.xxhash64("word")), "_h", wanted, "_h")
    common = both.groupBy("word").count().where(F.col("count") >= COMMON_WORD).select("word")
    return common.join(wanted.select("word"), "word", "left_semi")


def features(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` plus the columns FEATURES.

    ``transitions`` counts changes between lower case, upper case, digits and others; ``pairs`` is the share of
    neighbouring letters that are usual pairs of the dictionary; ``dictionary`` the share of the candidate's
    signs in words of the dictionary; the rest are shares, counts and 0/1 marks of path and neighbours.
    """
    words = written(dictionary(docs, found))
    pair = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = words.where(F.length("word") >= 2).select(F.explode(pair).alias("p")).where(F.col("p").rlike("^[a-z]{2}$")).groupBy("p").count()
    usual = [r.p for r in counted.orderBy(F.desc("count"), "p").limit(COMMON_PAIRS).collect()]
    value = F.col("value")
    held = found.select("_key", "start", F.explode(_letters(value)).alias("word"))
    runs = salted_join(held, words, ["word"], F.struct("_key", "start"), "inner").groupBy("_key", "start").agg(F.sum(F.length("word")).alias("_known"))
    n = F.length(value)
    count = lambda signs: n - F.length(F.regexp_replace(value, signs, ""))
    kinds = value
    for signs, kind in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), (r"[^aA0]", "-")):
        kinds = F.regexp_replace(kinds, signs, kind)
    low = F.lower(value)
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(low, i, F.lit(2))), lambda p: p.rlike("^[a-z]{2}$"))
    common = F.array(*[F.lit(p) for p in usual]) if usual else F.array().cast("array<string>")
    mark = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    out = found.join(runs, ["_key", "start"], "left").withColumn("_pairs", pairs)
    return out.withColumns({
        "length": n.cast("double"), "transitions": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1).cast("double"),
        "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n, "lowers": count("[a-z]") / n,
        "distinct_signs": F.size(F.array_distinct(F.split(value, ""))) / n,
        "pairs": F.size(F.filter("_pairs", lambda p: F.array_contains(common, p))) / F.greatest(F.size("_pairs"), F.lit(1)),
        "dictionary": F.coalesce(F.col("_known"), F.lit(0)) / n,
        "slashes": count("/").cast("double"), "dots": count(r"\.").cast("double"),
        "config_path": mark(F.col("path").rlike(CONFIG_PATH)), "trial_path": mark(F.col("path").rlike(TRIAL_PATH)),
        "key_word": mark(F.col("before").rlike(KEY_WORDS)), "assigned": mark(F.col("before").rlike(r"[=:]\s{0,3}[\"'`]?$")),
        "quoted": mark(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "word_before": mark(F.col("before").rlike(r"\p{L}\s$")), "word_after": mark(F.col("after").rlike(r"^\s\p{Ll}")),
    }).drop("_pairs", "_known")


def train(labelled: DataFrame, trees: int = 40, depth: int = 8, rows: int = TRAINING_ROWS) -> PipelineModel | None:
    """A forest from findings with FEATURES and ``label`` (1 a secret, 0 none; others are left out).

    About ``rows`` of either class are taken by the hash of row and place. None if a class is missing.
    """
    known = labelled.where("label IN (0, 1)")
    sizes = {int(r.label): r["count"] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("_key", "start"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bar = F.when(F.col("label") == 1, min(1.0, rows / sizes[1])).otherwise(min(1.0, rows / sizes[0]))
    sample = known.where(draw < bar).select("_key", "start", F.col("label").cast("double").alias("label"), *FEATURES)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted", numTrees=trees, maxDepth=depth, seed=11)
    ordered = assembler.transform(written(sample.orderBy("_key", "start").coalesce(1)))  # bounded; one order, one forest
    return PipelineModel([assembler, forest.fit(ordered)])


def judge(found: DataFrame, model: PipelineModel | None, bar: float = 0.5) -> DataFrame:
    """Findings with ``score`` (the forest's share for a secret) and ``is_secret``; without a model none is one."""
    if model is None:
        return found.withColumns({"score": F.lit(0.0), "is_secret": F.lit(False)})
    scored = model.transform(found).withColumn("score", vector_to_array("_probability")[1])
    return scored.drop("_features", "_raw", "_probability", "_predicted").withColumn("is_secret", F.col("score") >= bar)


def format_labels(found: DataFrame) -> DataFrame:
    """``found`` plus ``label`` where a published format or plain sight decides, else null.

    The tables hold no labelled findings, so these stand in for them. Secrets: an issuer's key format, or twelve
    or more hexadecimal digits of one case (letters and digits) given to a key word. None: words of letters only, digits
    only, hosts and addresses.
    """
    v, before = F.col("value"), F.col("before")
    secret = v.rlike("^(AKIA[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,})$") | (before.rlike(KEY_WORDS) & v.rlike("^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]{12,}|[0-9A-F]{12,})$"))
    plain = v.rlike(r"^[A-Za-z.\-_/]+$") | v.rlike(r"^[0-9.\-/+]+$") | v.rlike(r"^[a-z0-9.\-]+\.[a-z]{2,}$")
    return found.withColumn("label", F.when(secret, 1).when(plain, 0))


def scan(docs: DataFrame, path: str | None = "source", label=format_labels, bar: float = 0.5) -> DataFrame:
    """Every candidate of ``docs`` with place, features, score and decision.

    ``label`` adds the labels to train from, for example by a join with reviewed findings on doc_id and start.
    Null and empty texts have no candidates, a null doc_id is kept, repeated rows count once; without labels of
    both classes, and so for no rows, nothing is called a secret. Other columns of ``docs`` are not read.
    """
    found = written(features(docs, written(candidates(docs, path))))
    return judge(found, train(label(found)), bar)


def redact(docs: DataFrame, findings: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with its columns, every secret of a row's findings masked wherever it stands in the row's text.

    Rows without secrets stay as they are; ``n_chars``, where there is one, follows the text. Longer secrets are
    masked first, so that one inside another leaves no rest.
    """
    values = written(findings.where("is_secret").groupBy("_key").agg(F.collect_set("value").alias("_secrets")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _row_key().alias("_own_key"))
    marked = maybe_in(rows, "_own_key", values, "_key", flag="_maybe")
    plain = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rest = marked.where("NOT _maybe").select(*plain)
    hit = marked.where("_maybe").join(values, F.col("_own_key") == F.col("_key"), "left")
    longest = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(longest, F.col("_row.text"), lambda t, v: F.replace(t, v, F.lit(mask)))
    new = {"text": masked, "n_chars": F.length(masked)}
    changed = [F.when(F.col("_secrets").isNull(), F.col(f"_row.`{c}`")).otherwise(new[c].cast(docs.schema[c].dataType)).alias(c) if c in new else p for c, p in zip(docs.columns, plain)]
    return rest.unionByName(hit.select(*changed))
