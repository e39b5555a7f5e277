"""Operator 12, personal data: spans of fixed formats, and spans that boosted trees pick among candidates, in DataFrame functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns that pass their test. Generators of high recall
propose further candidates, which overlap base spans and each other: numbers of any grouping, and runs of letters and digits. Gradient-boosted
trees judge a candidate by format (length, shares of digits, letters and capitals, variety, separators) and by context (a naming word,
a quote or a sign of assignment before it). No row is labelled by hand: labelling functions mark candidates by check sums,
number ranges and naming words, or abstain; trees learn from the marked ones of all texts. Each kind gets the lowest threshold at which ``precision`` of
the selected are right, by the scores that trees of the other folds give; a kind that reaches it nowhere selects nothing. What a labelling function rules out (a number with a wrong check sum, say) is never selected. Selected candidates that overlap no base span are
redacted too: as ``secret``, which wins over ``number`` where they overlap.

The trees run as an expression over the array of a text's candidates: one pass over the texts, without a shuffle. Positions come from
the lengths of matches and of what lies between, by prefix sums in two levels. Patterns consume what they read (possessive quantifiers, starts after another character
only), so that a text of any length takes linear time and no stack; a test shows that they match as the plain ones. A text with n matches takes n to the power 1.5 steps at most.

Defined results: a null text counts as empty and has no spans; repeated rows get the same result each; an empty table gives an empty result and
learns nothing; null doc_ids stay null; other columns play no part. Positions count code points, the end is exclusive. Spans that tie in start are ordered by kind
(email, ip, card, phone, secret, number). Texts of all lengths are scanned whole; one task holds a text, its candidates and their features.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._batches import with_checkpoints

#: Kinds in the order of their listing.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns, each equal in its matches to the plain form: ``\G`` admits a start just after the match before.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{12,}+={0,2}",
    "number": r"(?<![A-Za-z0-9])[0-9(](?:[\x20().-]{0,2}[0-9]){5,}+(?![A-Za-z0-9])",
}
#: What a text must hold to be scanned at all.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
NAMING = r"(?i)(?:key|token|secret|passw|passphrase|pwd|auth|bearer|credential)[A-Za-z_]{0,8}[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$"
CALLING = r"(?i)(?:phone|tel|call|fax|mobile|card|account|iban|visa)[A-Za-z.]{0,8}\s{0,2}[:=]?\s{0,2}[(+]?$"
FEATURES = ("length", "digits", "letters", "capitals", "variety", "separators", "named", "called", "quoted", "assigned", "signed", "secret")
_BLOCK = 256
#: Folds of the marked candidates by their text; the trees that judge one for a threshold learned from the others.
FOLDS = 3


@dataclass(frozen=True)
class PiiParams:
    """The trees' number and depth; ``proof`` held-out candidates, ``precision`` of them right, prove a threshold."""

    trees: int = 10
    depth: int = 4
    precision: float = 0.95
    proof: int = 3


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of an array of longs; in blocks, so that no long array is copied for each element."""
    grow = lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x)))
    scan = lambda a: F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1), grow)
    starts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
    inner = lambda v: F.transform(starts(v), lambda b: scan(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = lambda blocks: scan(F.transform(blocks, lambda b: F.element_at(b, -1)))
    moved = lambda blocks, sums: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(sums, i - 1), x)))))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f of x, with x built once
    sums = lambda v: bound(inner(v), lambda blocks: bound(before(blocks), lambda s: moved(blocks, s)))
    return bound(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(sums(v)))


def with_matches(df: DataFrame, pattern: str, name: str, needed: str | None = None) -> DataFrame:
    """Adds the matches of a pattern in ``text``: start, end, s and up to 32 characters before and 2 after, not beyond the matches beside it."""
    parts = F.split("text", pattern, -1)
    df = df.withColumn("__parts", F.when(F.contains("text", F.lit(needed)), parts).otherwise(F.array("text")) if needed else parts)
    df = df.withColumn("__found", F.when(F.size("__parts") > 1, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__ends", running(F.transform("__found", lambda m, i: (F.length(m) + F.length(F.get("__parts", i))).cast("bigint")), lambda a, b: a + b))
    end = lambda i: F.get("__ends", i)
    span = lambda m, i: F.struct((end(i) - F.length(m)).alias("start"), end(i).alias("end"), m.alias("s"), F.substring(F.get("__parts", i), -32, 32).alias("before"), F.substring(F.get("__parts", i + 1), 1, 2).alias("after"))
    return df.withColumn(name, F.transform("__found", span)).drop("__parts", "__found", "__ends")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    value = lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def passes(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits_of(s)).between(14, 19), luhn(digits_of(s))).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(s)).between(10, 15)
    return F.lit(True)


def with_base(df: DataFrame) -> DataFrame:
    """Adds the base spans of each kind, in columns of their names."""
    for kind in PATTERNS:
        df = with_matches(df, PATTERNS[kind], kind, NEEDED.get(kind))
        df = df.withColumn(kind, F.transform(F.filter(kind, lambda m: passes(kind, m["s"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))))
    return df


def features(c: Column, secret: bool) -> Column:
    s = c["s"]
    n = F.length(s).cast("double")
    share = lambda drop: (F.length(s) - F.length(F.regexp_replace(s, drop, ""))) / n
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return F.array(
        n,
        share("[0-9]"),
        share("[A-Za-z]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(F.substring(s, 1, 256), ""))) / F.least(n, F.lit(256.0)),
        (1 - share("[A-Za-z0-9]")) * n,
        flag(c["before"].rlike(NAMING)),
        flag(c["before"].rlike(CALLING)),
        flag(c["before"].rlike("[\"']$") | c["after"].rlike("^[\"']")),
        flag(c["before"].rlike("[:=]\\s{0,2}[\"']?$")),
        flag(c["before"].endswith("+")),
        F.lit(float(secret)),
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds each generator's candidates with their features x, in columns of the kinds' names."""
    for kind, pattern in GENERATORS.items():
        df = with_matches(df, pattern, f"__{kind}")
        df = df.withColumn(kind, F.transform(f"__{kind}", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"].alias("s"), c["before"].alias("before"), features(c, kind == "secret").alias("x")))).drop(f"__{kind}")
    return df


def marked(kind: str, c: Column) -> Column:
    """Labelling functions: 1, 0, or null where they abstain."""
    s, before = c["s"], c["before"]
    has = lambda p: s.rlike(p)
    if kind == "secret":
        mixed = has("[0-9]") & has("[A-Za-z]")
        return F.when(mixed & (F.length(s) >= 16) & before.rlike(NAMING), 1.0).when(~has("[0-9]") | ~has("[A-Za-z]"), 0.0)
    d = digits_of(s)
    dotted = has(r"^[0-9]+(?:\.[0-9]+){3}$")
    return (
        F.when(dotted, passes("ip", s).cast("double"))
        .when(before.endswith("+") & F.length(d).between(10, 15), 1.0)
        .when(F.length(d).between(14, 19), luhn(d).cast("double"))
        .when((F.length(d) < 9) | (F.length(d) > 19), 0.0)
    )


def marked_candidates(documents: DataFrame) -> DataFrame:
    """kind, x, label, fold of the marked candidates of all texts, equal ones as one row with their number n; the same on every run."""
    cands = with_candidates(documents.select(F.coalesce("text", F.lit("")).alias("text")))
    entry = lambda kind: lambda c: F.struct(F.lit(kind).alias("kind"), c["x"].alias("x"), marked(kind, c).alias("label"), F.pmod(F.xxhash64(c["s"]), F.lit(FOLDS)).alias("fold"))
    each = F.concat(*[F.transform(kind, entry(kind)) for kind in GENERATORS])
    return cands.select(F.explode(each).alias("c")).select("c.*").where("label IS NOT NULL").groupBy("kind", "x", "label", "fold").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Model:
    """Trees with their weights, as (feature, threshold, left, right) or a number, and the threshold of each kind."""

    trees: tuple = ()
    weights: tuple = ()
    thresholds: tuple = ()


def tree_of(described: str):
    """A tree from its description by Spark."""
    lines = iter([x.strip() for x in described.splitlines()[1:] if x.strip()])

    def read():
        line = next(lines)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = read()
        next(lines)  # Else
        return int(feature), float(limit), left, read()

    return read()


def probability(x: Column, model: Model) -> Column:
    """The boosted trees as an expression over an array of features."""

    def value(tree) -> Column:
        return F.lit(tree) if isinstance(tree, float) else F.when(F.get(x, F.lit(tree[0])) <= tree[1], value(tree[2])).otherwise(value(tree[3]))

    margin = sum((value(t) * w for t, w in zip(model.trees, model.weights)), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))


def fit(documents: DataFrame, params: PiiParams = PiiParams()) -> Model:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    with_checkpoints(documents.sparkSession)
    rows = marked_candidates(documents).checkpoint()
    learner = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=1, featuresCol="v", labelCol="label", weightCol="n")

    def learned(rows: DataFrame) -> Model | None:
        if len(rows.select("label").distinct().collect()) < 2:
            return None
        trees = learner.fit(rows.select(array_to_vector("x").alias("v"), "label", F.col("n").cast("double").alias("n")))
        return Model(tuple(tree_of(t.toDebugString) for t in trees.trees), tuple(trees.treeWeights))

    model, scores = learned(rows), []
    for fold in range(FOLDS):
        if other := model and learned(rows.where(F.col("fold") != fold)):
            bins = rows.where(F.col("fold") == fold).groupBy("kind", F.floor(probability(F.col("x"), other) * 200).alias("bin"))
            scores += bins.agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()  # 201 rows a kind at most
    if not model:
        return Model()
    thresholds = []
    for kind in GENERATORS:
        bins = sorted((r for r in scores if r["kind"] == kind), key=lambda r: -r["bin"])
        n = right = 0
        best = None
        for r in bins:
            n, right = n + r["n"], right + r["right"]
            if right >= params.precision * n and n >= params.proof:
                best = r["bin"] / 200
        thresholds.append((kind, best))
    return Model(model.trees, model.weights, tuple(thresholds))


def clear_of(cands: Column, winners: Column) -> Column:
    """The spans of ``cands`` that overlap none of ``winners``; both in any order, in n log n."""
    entry = lambda own: lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(own).alias("own"))
    merged = F.array_sort(F.concat(F.transform(winners, entry(False)), F.transform(cands, entry(True))))

    def kept(every: Column) -> Column:
        ends = running(F.transform(every, lambda c: F.when(c["own"], F.lit(-1)).otherwise(c["end"]).cast("bigint")), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(every), lambda c: F.when(c["own"], F.lit(1 << 60)).otherwise(c["start"]).cast("bigint")), F.least))
        both = F.transform(F.array(F.struct(ends.alias("ends"), starts.alias("starts"))), lambda b: F.filter(every, lambda c, i: c["own"] & (F.get(b["ends"], i) <= c["start"]) & (F.get(b["starts"], i) >= c["end"])))
        return F.transform(F.get(both, F.lit(0)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))

    return F.when(F.size(cands) == 0, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.get(F.transform(F.array(merged), kept), F.lit(0)))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' spans, by start, then kind."""
    entry = lambda n: lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))
    every = F.concat(*[F.transform(k, entry(n)) for n, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(documents: DataFrame, model: Model | None = None, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row. ``redact`` gives the texts without them."""
    return spans(documents, model or fit(documents, params)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(listed(tuple(PATTERNS)).cast("binary"), 256).alias("base_sha256"),
        listed(KINDS).alias("spans"),
    )


def spans(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and an array of spans for each kind."""
    df = with_base(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    limits = dict(model.thresholds)
    winners = list(PATTERNS)
    df = with_candidates(df)
    for kind in GENERATORS:
        if limits.get(kind) is None:
            df = df.withColumn(kind, F.array().cast("array<struct<start:bigint,end:bigint>>"))
        else:
            df = df.withColumn(kind, F.filter(kind, lambda c: (probability(c["x"], model) >= limits[kind]) & ~F.coalesce(marked(kind, c) == 0, F.lit(False))))
            df = df.withColumn(kind, clear_of(F.col(kind), F.concat(*winners)))
        winners.append(kind)
    return df


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets; of overlapping spans the first, longer one."""
    df = spans(documents, model)
    entry = lambda k: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(k).alias("kind"))
    every = F.concat(*[F.transform(k, entry(k)) for k in KINDS])
    df = df.withColumn("__all", F.array_sort(every))
    df = df.withColumn("__ends", running(F.transform("__all", lambda s: -s["back"]), F.greatest))
    free = F.filter("__all", lambda s, i: (i == 0) | (F.get("__ends", i - 1) <= s["start"]))
    cut = F.split("text", "")  # code points, so that each is found at once
    first = F.when(F.size("__free") == 0, F.col("text")).otherwise(F.array_join(F.slice(cut, F.lit(1), F.get("__free", F.lit(0))["start"].cast("int")), ""))
    rest = F.transform("__free", lambda s, i: F.concat(F.lit("["), s["kind"], F.lit("]"), F.array_join(F.slice(cut, (1 - s["back"]).cast("int"), (F.coalesce(F.get("__free", i + 1)["start"], F.length("text").cast("bigint")) + s["back"]).cast("int")), "")))
    return df.withColumn("__free", free).select("doc_id", F.concat(first, F.array_join(rest, "")).alias("text"))
