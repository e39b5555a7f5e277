"""Ordered rewrite rules: validation, token and chunk mode, previews.

Rules are few (300 a scope at most) and known when the plan is made, so they become one expression that Catalyst compiles;
nothing is joined and no row meets a Python function.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.functions import text as T
from leafmill.operators.model import paragraph_array


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    replacement: str
    source: str = "regex"
    enabled: bool = True
    case_insensitive: bool = True


#: Shapes that may backtrack without end: a quantified group with a quantifier or an alternation inside, a back reference.
UNSAFE = (r"\((?:[^()\\]|\\.)*[+*{](?:[^()\\]|\\.)*\)\s*[+*{]", r"\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)\s*[+*{]", r"\\[1-9]")


def unsafe_regex(c: str | Column) -> Column:
    out = F.lit(False)
    for shape in UNSAFE:
        out = out | T.col(c).rlike(shape)
    return out


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries and an end anchor that means the end."""
    edge = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    return re.sub(r"\\b|\\\\", lambda m: edge if m[0] == r"\b" else m[0], pattern)


def rule_error(rule: Rule) -> str | None:
    """Why a rule is refused; None for a good one."""
    pattern = rule.pattern.strip()
    if not pattern:
        return "Pattern is required"
    if len(pattern) > S.RULE_PATTERN_CHARS:
        return f"Pattern is too long (max {S.RULE_PATTERN_CHARS} chars)"
    if len(rule.replacement) > S.RULE_REPLACEMENT_CHARS:
        return f"Replacement is too long (max {S.RULE_REPLACEMENT_CHARS} chars)"
    if any(re.search(u, pattern) for u in UNSAFE):
        return "Regex looks potentially unsafe for live playback. Try a simpler pattern."
    if why := syntax_error(java(pattern)):
        return f"Invalid regex: {why}"
    return None


def syntax_error(pattern: str) -> str | None:
    """What the engine that will run the pattern, the JVM's, says against it."""
    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        return str(e).split(" near index")[0].split("\n")[0]
    return None


def active(global_rules: list[Rule], book_rules: list[Rule]) -> list[Rule]:
    """Enabled rules in order, the global ones first; bad ones are left out."""
    return [replace(r, pattern=r.pattern.strip()) for r in [*global_rules, *book_rules] if r.enabled and rule_error(r) is None]


def _flags(r: Rule) -> str:
    return "(?i)" if r.case_insensitive else ""


def _dollars(replacement: str) -> str:
    """A replacement whose $&, $1 and $$ mean the match, a group and a dollar, for Java."""
    out = re.sub(r"\\", r"\\\\", replacement)
    return re.sub(r"\$(\$|&|[0-9]{1,2})|\$", lambda m: r"\$" if m[1] in (None, "$") else "$0" if m[1] == "&" else f"${m[1]}", out)


def _within(r: Rule, preview: bool) -> str:
    """The pattern of a rule for a token: simple rules look inside it, unless for a preview; others must fit it whole."""
    return _flags(r) + (java(r.pattern) if r.source == "simple" and not preview else rf"\A(?:{java(r.pattern)})\z")


def fitting(word: Column, rules: list[Rule], preview: bool = False) -> Column:
    """The number of the first rule that fits a token; null for none."""
    out = F.when(F.lit(False), -1)
    for i, r in enumerate(rules):
        out = out.when(word.rlike(_within(r, preview)), i)
    return out


def rewritten(word: Column, number: Column, rules: list[Rule], preview: bool = False) -> Column:
    """A token rewritten by the rule of that number; as it is without one."""
    out = F.when(F.lit(False), word)
    for i, r in enumerate(rules):
        out = out.when(number == i, F.regexp_replace(word, _within(r, preview), _dollars(r.replacement)))
    return out.otherwise(word)


def apply_token(word: Column, rules: list[Rule], preview: bool = False) -> Column:
    """struct<spoken, matched>: the first rule that fits a token rewrites it."""
    spoken, matched = F, F
    for r in rules:
        fits = word.rlike(_within(r, preview))
        spoken, matched = spoken.when(fits, F.regexp_replace(word, _within(r, preview), _dollars(r.replacement))), matched.when(fits, True)
    return F.struct((spoken.otherwise(word) if rules else word).alias("spoken"), (matched.otherwise(False) if rules else F.lit(False)).alias("matched"))


def apply_chunk(text: Column, rules: list[Rule]) -> Column:
    """struct<spoken, matches>: every rule in turn on what the one before left; replacements are taken literally.

    A fold over the rules' numbers: each step picks its rule from one list of cases, so the expression grows with the number
    of rules and not with its power, and every pattern is compiled once.
    """
    start = F.struct(text.alias("spoken"), F.lit(0).alias("matches"))
    if not rules:
        return start

    def step(now: Column, number: Column) -> Column:
        out = F
        for i, r in enumerate(rules):
            pattern = _flags(r) + java(r.pattern)
            done = F.regexp_replace(now["spoken"], pattern, r.replacement.replace("\\", "\\\\").replace("$", "\\$"))
            found = F.coalesce(F.regexp_count(now["spoken"], F.lit(pattern)), F.lit(0))
            out = out.when(number == i, F.struct(done.alias("spoken"), (now["matches"] + found).alias("matches")))
        return out.otherwise(now)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), start, step)


def preview(documents: DataFrame, rules: list[Rule], key: str = "doc_id", examples: int = 20) -> DataFrame:
    """key, total_matches, affected_paragraphs, unique_words, percent (of the book's words), high_impact and examples: the
    first ``examples`` rewritten words as (before, after), in reading order.

    Counted inside each document's own arrays: one scan, no shuffle.
    """
    tokens = F.transform(paragraph_array("text"), T.tokenize)
    own = documents.select(key, tokens.alias("tokens"))
    tried = F.flatten(F.transform("tokens", lambda words, p: F.filter(F.transform(words, lambda w: F.struct(p.alias("paragraph"), w.alias("before"), fitting(w, rules, True).alias("rule"))), lambda h: h["rule"].isNotNull())))
    hits = own.select(key, F.aggregate("tokens", F.lit(0), lambda n, words: n + F.size(words)).alias("total_words"), tried.alias("hits"))
    n = F.size("hits").cast("long")
    share = n / F.greatest(F.lit(1), F.col("total_words")) * 100
    return hits.select(
        key,
        n.alias("total_matches"),
        F.size(F.array_distinct(F.transform("hits", lambda h: h["paragraph"]))).cast("long").alias("affected_paragraphs"),
        F.size(F.array_distinct(F.transform("hits", lambda h: F.lower(h["before"])))).cast("long").alias("unique_words"),
        share.alias("percent"),
        ((n > 500) | (share > 5)).alias("high_impact"),
        F.transform(F.slice("hits", 1, examples), lambda h: F.struct(h["before"].alias("before"), rewritten(h["before"], h["rule"], rules, True).alias("after"))).alias("examples"),
    )


def migrate_simple_pattern(pattern: str | Column) -> Column:
    """The pattern of a simple rule as it is written today: older ones stood between word edges or between runs of other characters."""
    trimmed = F.trim(T.col(pattern))
    edges, runs = F.regexp_extract(trimmed, r"^\\b(.+)\\b\z", 1), F.regexp_extract(trimmed, r"^\[\^\\w\]\*(.+)\[\^\\w\]\*\z", 1)
    today = lambda old: F.coalesce(F.nullif(T.simple_word_pattern(F.regexp_replace(old, r"\\(.)", "$1")), F.lit("")), trimmed)
    return F.when(edges != "", today(edges)).when(runs != "", today(runs)).otherwise(trimmed)


def sanitized(raw: DataFrame) -> DataFrame:
    """The rules of a store that can be used: (scope, pos, id, pattern, replacement, source, enabled, case_insensitive), at most 300 of each scope, the first by pos.

    ``raw``: the same columns as they were stored; scope null is for all books, a blank one is none. A rule needs an id, texts within their lengths and both switches; an unknown source counts as ``regex``, simple patterns
    are brought up to date. The cap is a top-k a scope, so tasks drop the rest before rows are exchanged.
    """
    from pyspark.sql import Window

    source = F.when(F.col("source") == "simple", "simple").otherwise("regex")
    pattern = F.when(F.col("source") == "simple", migrate_simple_pattern("pattern")).otherwise(F.col("pattern"))
    at = raw.select("scope", "pos", "id", pattern.alias("pattern"), "replacement", source.alias("source"), "enabled", "case_insensitive")
    good = (F.trim("id") != "") & (F.length("replacement") <= S.RULE_REPLACEMENT_CHARS) & (F.length("pattern") <= S.RULE_PATTERN_CHARS) & F.col("enabled").isNotNull() & F.col("case_insensitive").isNotNull()
    kept = at.where(good & (F.col("scope").isNull() | (F.trim("scope") != "")))
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("scope").orderBy("pos", "id"))).where(F.col("__n") <= S.RULES_PER_SCOPE).drop("__n")


def without_scopes(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rules without those of some books. ``scopes``: scope."""
    return rules.join(scopes.select("scope"), "scope", "left_anti")
