"""Operator 8, URL filters: suffix rules, and gradient-boosted trees on lexical features for what no rule covers.

A rule (host, path, verdict) fits its host and all subdomains of it if the URL's path starts with the rule's; the longest rule
wins. The trees learn from the URLs that rules cover and judge the others. The shares of blocked URLs of suffixes and domains,
their prior and whether there are two verdicts at all come from every covered row; the trees are grown on about ``sample``
distinct covered URLs, the least by hash of each verdict, weighted back to the verdicts' numbers of distinct URLs. While the trees
learn, a URL's rates come from the four fifths of the covered URLs that it is not in (folds by the URL's hash, so that all its copies
are left out). Everything, training included, is DataFrame functions and Spark's own ML in the JVM.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Defined
results: a null URL or one without ``://`` has an empty host and path and fits no rule that names a host; its verdict is the
method's. If the rules cover URLs of one verdict only, that is every verdict; if they cover none, every verdict
is ``allow``. Repeated rows get the same verdict each. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._batches import with_checkpoints


@dataclass(frozen=True)
class UrlParams:
    """``sample`` bounds the distinct URLs that the trees are grown on; a table of rates of up to ``broadcast_bytes`` is broadcast."""

    sample: int = 20_000
    broadcast_bytes: int = 32 << 20
    trees: int = 12
    depth: int = 4
    smoothing: float = 4.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, r"(?s)\A[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest fitting rule; null if none fits."""
    out = F
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return out if rules else F.lit(None).cast("struct<rule:string,verdict:string>")


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate", "domain_rate")


def named(df: DataFrame) -> DataFrame:
    """Adds the two suffixes of the host, without a port or a user's name; the shorter is one of the longer's too."""
    name = F.regexp_replace(F.substring_index("host", "@", -1), r":\d*$", "")
    return df.withColumns({"suffix": F.substring_index(name, ".", -1), "domain": F.substring_index(name, ".", -2)})


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features and the two suffixes of url, host and path."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    part = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda total, c: total - F.when(c == "", 0.0).otherwise(part(c) * F.log2(F.greatest(part(c), F.lit(1e-12)))))
    return named(df).withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "labels": count(F.col("host"), ".").cast("double"),
            "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
            "entropy": entropy,
            "parameters": (count(url, "&") + count(url, "?")).cast("double"),
            "hyphens": (count(url, "-") + count(url, "_")).cast("double"),
        }
    )


#: Folds of the covered URLs; the trees learn from rates of the folds that a URL is not in.
FOLDS = 5
#: A suffix or domain of at least one row in so many is frequent; there are at most so many of them.
FREQUENT = 1000


@dataclass(frozen=True)
class Rates:
    """Blocked shares of one kind of suffix; ``frequent`` and ``rare`` ones apart if they are too many to be broadcast."""

    kind: str
    name: str
    small: DataFrame | None
    frequent: DataFrame | None = None
    rare: DataFrame | None = None

    def join(self, df: DataFrame, spread: Column, prior: float) -> DataFrame:
        """Adds the share, the prior for unseen ones. ``spread`` deals rows of frequent ones over tasks."""
        if self.small is not None:
            return df.join(F.broadcast(self.small), self.kind, "left").withColumn(self.name, F.coalesce(self.name, F.lit(prior)))
        df = df.join(F.broadcast(self.frequent), self.kind, "left")
        away = F.concat(F.lit("/"), F.pmod(spread, F.lit(4096)).cast("string"))  # no host holds a slash, so none of these is found
        df = df.withColumn("__key", F.when(F.col("__share").isNotNull(), away).otherwise(F.col(self.kind))).join(self.rare, "__key", "left")
        return df.withColumn(self.name, F.coalesce("__share", self.name, F.lit(prior))).drop("__key", "__share")


def rates_of(counted: DataFrame, kind: str, name: str, rows: int, prior: float, params: UrlParams) -> Rates:
    """The rates of all suffixes of a kind from the counts of each domain."""
    share = F.coalesce((F.sum("blocked") + params.smoothing * prior) / (F.sum("n") + params.smoothing), F.lit(prior))
    table = counted.groupBy(kind).agg(share.alias(name), F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
    known = table.where("n > 0").select(kind, name)
    if (known.agg(F.sum(F.octet_length(kind) + 32)).first()[0] or 0) <= params.broadcast_bytes:
        return Rates(kind, name, known)
    often = F.col("n_rows") * FREQUENT >= rows
    return Rates(kind, name, None, table.where(often).select(kind, F.col(name).alias("__share")), table.where(~often & (F.col("n") > 0)).select(F.col(kind).alias("__key"), name))


def other_folds(counted: DataFrame, sample: DataFrame, kind: str, name: str, prior: float, params: UrlParams) -> DataFrame:
    """Adds to the sample the share of its suffix among the URLs of other folds than its own, so that no URL's verdict is
    in what the trees learn from. The sample is bounded; the counts are joined by suffix, not broadcast."""
    folds = counted.groupBy(kind, "fold").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    every = folds.groupBy(kind).agg(F.sum("n").alias("__n"), F.sum("blocked").alias("__blocked"))
    own = folds.select(kind, "fold", F.col("n").alias("__own_n"), F.col("blocked").alias("__own_blocked"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = sample.join(every, kind, "left").join(own, [kind, "fold"], "left")
    n, blocked = zero("__n") - zero("__own_n"), zero("__blocked") - zero("__own_blocked")
    return joined.withColumn(name, (blocked + params.smoothing * prior) / (n + params.smoothing)).drop("__n", "__blocked", "__own_n", "__own_blocked")


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def tree_sample(labelled: DataFrame, params: UrlParams) -> tuple[DataFrame, Column]:
    """About ``sample`` distinct URLs of ``labelled``, half of each verdict or what it has, persisted; and their weights."""
    one = labelled.agg(*[F.approx_count_distinct(F.when(F.col("label") == v, F.col("url"))) for v in (0, 1)]).first()
    most = [int(1.2 * n) + 10 for n in one]  # more than there are
    half = params.sample // 2
    quota = [max(half, params.sample - most[1]), max(half, params.sample - most[0])]
    drawn = labelled.withColumn("draw", F.pmod(F.xxhash64("url"), F.lit(1 << 30)))
    parts = []
    for v in (0, 1):
        below = int((1 << 30) * min(1.0, (2 * quota[v] + 50) / max(1, one[v])))
        parts.append(drawn.where((F.col("label") == v) & (F.col("draw") < below)).dropDuplicates(["url"]).orderBy("draw", "url").limit(quota[v]))
    sample = lexical(parts[0].unionByName(parts[1])).persist()
    taken = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    weight = [max(1.0, one[v] / taken[v]) if taken.get(v, 0) >= quota[v] > 0 else 1.0 for v in (0, 1)]
    return sample, F.when(F.col("label") == 1, weight[1]).otherwise(weight[0])


def judge(pages: DataFrame, rules: list[Rule], params: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's, from 0, allow, to 1, block) for each row of ``pages``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    with_checkpoints(pages.sparkSession)
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    ruled = split.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    verdict, rule = F.col("by.verdict"), F.col("by.rule")
    label = (verdict == "block").cast("double").alias("label")
    counted = named(ruled.select("host", label, fold_of(F.coalesce("url", F.lit(""))).alias("fold"))).groupBy("suffix", "domain", "fold").agg(F.count("*").alias("n_rows"), F.count("label").alias("n"), F.sum("label").alias("blocked")).checkpoint()
    seen = counted.agg(F.sum("n_rows").alias("rows"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    prior = (seen["blocked"] or 0.0) / (seen["n"] or 1)
    if prior in (0.0, 1.0):
        fixed = F.lit("block" if prior else "allow")
        return ruled.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, fixed).alias("verdict"), F.lit(float(prior)).alias("score"))
    rates = [rates_of(counted, kind, name, seen["rows"], prior, params) for kind, name in (("suffix", "suffix_rate"), ("domain", "domain_rate"))]

    def rated(df: DataFrame, spread: Column) -> DataFrame:
        for r in rates:
            df = r.join(df, spread, prior)
        return df

    sample, weight = tree_sample(ruled.where("by IS NOT NULL").select(F.coalesce("url", F.lit("")).alias("url"), "host", "path", label), params)
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    learner = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=1, featuresCol="features", labelCol="label", weightCol="weight")
    taught = sample.withColumns({"weight": weight, "fold": fold_of(F.col("url"))})
    for kind, name in (("suffix", "suffix_rate"), ("domain", "domain_rate")):
        taught = other_folds(counted, taught, kind, name, prior, params)
    trees = learner.fit(gather.transform(taught))
    sample.unpersist()
    judged = trees.transform(gather.transform(rated(lexical(ruled), F.xxhash64("page_id", "url"))))
    score = vector_to_array("probability")[1]
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
