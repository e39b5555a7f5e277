"""Text functions as Column expressions; everything stays inside the JVM.

White space is one explicit class, so that results don't depend on an engine's ``\\s``; ``\\z`` is the end of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill import schemas as S

#: White space by code point; Java and RE2 read the class alike.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same without the blank.
_OTHER = SPACE.replace(r"-\r ", r"-\r")
#: What may not be white space is told by one range before the class, which has many; most characters are in that range.
SPACES = rf"(?![!-~]){SPACE}+"
#: White space that normalising changes: all but a lone blank between other characters. A text without any is not copied.
UNEVEN = rf"(?![!-~])(?:{_OTHER}{SPACE}*| (?![!-~]){SPACE}+)"
#: The same within lines.
_IN_LINE = SPACE.replace(r"\t-\r", r"\t\x0B-\r")
_UNEVEN_IN_LINE = rf"(?![!-~])(?:{_IN_LINE.replace(r'-\r ', r'-\r')}{_IN_LINE}*| (?![!-~]){_IN_LINE}+)"
#: What a text must hold to match that pattern, as UTF-8: two blanks or one of these; the wide ones, by their first bytes, in texts with wide characters only.
_NARROW_UNEVEN = (b"  ", b"\t", b"\x0b", b"\x0c", b"\r")
_WIDE_UNEVEN = (b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
ORNAMENT = r"[*\x{2042}\x{2022}\x{25C6}\x{25C7}\x{25CA}\x{2766}\x{2767}\x{00B7}]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(c + 0.5).cast("long")


def normalize_text(c: str | Column) -> Column:
    """Soft hyphens go, white space collapses to one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.replace(col(c), F.lit("\u00ad"), F.lit("")), UNEVEN, " "))


def _holds(t: Column, some: tuple[bytes, ...]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in some]), lambda x: F.contains(t.cast("binary"), x))


def _uneven(t: Column, narrow: tuple[bytes, ...]) -> Column:
    """Whether a pattern of uneven white space may match; searches for fixed strings tell that at a fraction of its time."""
    return _holds(t, narrow) | ((F.octet_length(t) > F.length(t)) & _holds(t, _WIDE_UNEVEN))


def normalized_lines(c: str | Column) -> Column:
    """``normalize_text`` of each line that is not blank, in order. The pattern walks over texts only that hold something it may match."""
    even = lambda t: F.when(_uneven(t, _NARROW_UNEVEN), F.regexp_replace(t, _UNEVEN_IN_LINE, " ")).otherwise(t)
    once = F.array(F.replace(col(c), F.lit("\u00ad"), F.lit("")))
    return F.filter(F.transform(F.split(F.get(F.transform(once, even), F.lit(0)), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def with_normalized(c: str | Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the ``normalize_text`` of a text, which is made once however often ``f`` asks for it; the pattern walks over texts only that hold something it may match."""
    even = lambda t: F.trim(F.when(_uneven(t, (*_NARROW_UNEVEN, b"\n")), F.regexp_replace(t, UNEVEN, " ")).otherwise(t))
    once = F.array(F.replace(col(c), F.lit("\u00ad"), F.lit("")))
    return F.get(F.transform(F.transform(once, even), f), F.lit(0))


def tokenize(c: str | Column) -> Column:
    """Words between white space, without quote runs at either end; empty ones go."""
    words = F.transform(F.split(col(c), SPACES), lambda w: F.btrim(w, F.lit("\"'")))
    return F.filter(words, lambda w: w != "")


def count_words(c: str | Column) -> Column:
    return F.size(tokenize(c))


def letters(c: str | Column) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^\p{L}]+", ""))


def usable(words: Column, n_letters: Column) -> Column:
    return (words >= S.MIN_USABLE_WORDS) & (n_letters >= S.MIN_USABLE_LETTERS)


def safe_uri_decode(c: str | Column) -> Column:
    """Percent decoding that keeps ``+`` and gives back what it cannot decode."""
    return F.coalesce(F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B"))), col(c))


def path_normalize(c: str | Column) -> Column:
    """POSIX path without ``.``, ``..`` (which never leaves the root) and doubled slashes."""
    parts = F.split(col(c), "/")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when((p == "") | (p == "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.array_join(fold, "/")


def path_basename(c: str | Column) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def path_dirname(c: str | Column) -> Column:
    return F.when(F.instr(col(c), "/") > 0, F.regexp_replace(col(c), r"/[^/]*\z", "")).otherwise("")


def path_extname(c: str | Column) -> Column:
    """The last dot and what follows it, lower-cased; none for a leading dot."""
    return F.lower(F.regexp_extract(path_basename(c), r"[^.].*?(\.[^.]*)\z", 1))


def path_join(a: str | Column, b: str | Column) -> Column:
    return path_normalize(F.concat_ws("/", col(a), col(b)))


def filename_title(c: str | Column) -> Column:
    """A readable title from a file name: no extension, separators become blanks, else ``Untitled``."""
    stem = F.regexp_replace(path_basename(c), r"(?i)\.(epub|pdf)\z", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(stem, r"[_-]+", " "), r"\s+", " ")), F.lit("")), F.lit("Untitled"))


#: Media types by extension.
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".svg": "image/svg+xml", ".bmp": "image/bmp", ".avif": "image/avif"}


def media_type(path: str | Column, declared: str | Column | None = None) -> Column:
    """The declared type (image/jpg is image/jpeg), else the one of the extension."""
    by_name = reduce(lambda out, kv: out.when(path_extname(path) == kv[0], kv[1]), MEDIA_TYPES.items(), F)
    if declared is None:
        return by_name
    given = F.lower(F.trim(col(declared)))
    return F.coalesce(F.nullif(F.when(given == "image/jpg", "image/jpeg").otherwise(given), F.lit("")), by_name)


def dedup_strings(c: str | Column) -> Column:
    """Normalised strings of an array, the first of each regardless of case; empty ones go."""
    return F.aggregate(
        F.transform(col(c), normalize_text),
        F.array().cast("array<string>"),
        lambda out, x: F.when((x == "") | F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x))),
    )


def token_set(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(col(c))), SPACES), lambda w: w != ""))


def nav_kind(c: str | Column) -> Column:
    """Kind of a navigation entry by its title."""
    t = F.lower(normalize_text(c))
    starts = lambda *words: t.rlike(rf"^(?:{'|'.join(words)})(?![A-Za-z0-9_])")
    return (
        F.when(starts("contents", "title page", "copyright", "dedication", "preface", "foreword", "introduction"), "frontmatter")
        .when(starts("notes", "endnotes", "bibliography", "index", "colophon", "about the author"), "backmatter")
        .when(starts("book", "part", "volume"), "part")
        .when(starts("scene"), "scene")
        .when(starts("section", "appendix"), "section")
        .otherwise("chapter")
    )


def _by_kind(kind: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), kind)


def nav_precedence(kind: Column) -> Column:
    return _by_kind(kind, S.NAVIGATION_PRECEDENCE)


def nav_level(kind: Column) -> Column:
    return _by_kind(kind, S.NAVIGATION_LEVEL)


#: Labels of the navigation kinds.
NAVIGATION_LABELS = {"frontmatter": "Front matter", "part": "Part", "chapter": "Chapter", "section": "Section", "scene": "Scene", "backmatter": "Back matter"}


def nav_label(kind: Column) -> Column:
    return _by_kind(kind, NAVIGATION_LABELS)


def comparable_heading(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", " "))


def sane_title(c: str | Column) -> Column:
    return with_normalized(c, lambda t: F.length(t).between(1, 240) & t.rlike(r"[\p{L}\p{N}]"))


def scene_ornament(c: str | Column) -> Column:
    """A line of ornaments only: one asterism, or three marks or more with nothing but separators between."""
    t = normalize_text(c)
    marks = F.regexp_count(t, F.lit(ORNAMENT))
    rest = F.regexp_replace(t, ORNAMENT + r"|[\s_.~-]", "")
    return ~t.rlike(r"[\p{L}\p{N}]") & ((t == "⁂") | ((marks >= 3) & (rest == "")))


def raw_ornament(c: str | Column) -> Column:
    """No letter or digit, and three ornament marks or more."""
    t = normalize_text(c)
    return ~t.rlike(r"[\p{L}\p{N}]") & (F.regexp_count(t, F.lit(ORNAMENT)) >= 3)


#: Numbers in words, one to twenty.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")


def ordinal_parse(c: str | Column) -> Column:
    """Digits, one to twenty, or a Roman number as an integer; else null."""
    t = F.lower(F.trim(col(c)))
    word = F.nullif(F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), t), F.lit(0))
    value = lambda ch: _by_kind(ch, {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000})
    digits = F.transform(F.filter(F.split(t, ""), lambda x: x != ""), value)
    roman = F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda sum_, i: sum_ + F.when(F.coalesce(F.get(digits, i), F.lit(0)) > F.get(digits, i - 1), -F.get(digits, i - 1)).otherwise(F.get(digits, i - 1)))
    return F.coalesce(F.when(t.rlike(r"^[0-9]{1,9}\z"), t.try_cast("int")), word.cast("int"), F.when(t.rlike(r"^[ivxlcdm]+\z"), roman))


def furniture_signature(c: str | Column) -> Column:
    """Repeated page lines under one name: a lone page number, or digits as ``#`` from three words on."""
    t = F.lower(normalize_text(c))
    return F.when(t.rlike(r"^(?:page )?[0-9ivxlcdm]{1,7}\z"), "<page-number>").when(count_words(t) >= 3, F.regexp_replace(t, "[0-9]+", "#")).otherwise(t)


def sentence_split(c: str | Column) -> Column:
    """Sentences: after . ! ? and a closing mark, before a blank and a capital or an opening quote."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[.!?\x{2026}]|[.!?\x{2026}][\x{201D}\x{2019})])\s+(?=[\p{Lu}\x{201C}\x{2018}\"'(])"), lambda s: F.trim(s)), lambda s: s != "")


def join_wrapped(lines: str | Column) -> Column:
    """Lines joined by blanks; a hyphen between a letter and a small letter is a word break and goes."""
    return F.aggregate(
        F.transform(col(lines), lambda s: F.trim(s)),
        F.lit(""),
        lambda out, x: F.when(out == "", x).when(out.rlike(r"\p{L}-\z") & x.rlike(r"^\p{Ll}"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), x)).otherwise(F.concat(out, F.lit(" "), x)),
    )


def simple_word(c: str | Column) -> Column:
    t = F.trim(col(c))
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""), F.lit("")), t)


def simple_word_pattern(c: str | Column) -> Column:
    word = simple_word(c)
    return F.when(word == "", "").otherwise(F.concat(F.lit(r"\b"), F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\b")))


def excerpt(c: str | Column, n: int = 180) -> Column:
    return F.substring(normalize_text(c), 1, n)


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def split_authors(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(col(c), r"(?i)\s*(?:;|\n|\band\b)\s*"), normalize_text), lambda x: x != "")


def fnv1a(c: str | Column) -> Column:
    """32-bit FNV-1a over characters (those beyond the first plane count by code point)."""
    return F.aggregate(
        F.filter(F.split(col(c), ""), lambda x: x != ""),
        F.lit(2166136261).cast("long"),
        lambda h, ch: F.pmod(h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(16777619).cast("long"), F.lit(4294967296)),
    )


def data_url(content: str | Column, mime: str | Column) -> Column:
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.base64(col(content)))


def css_hidden(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(r"(?i)(?:display\s*:\s*none|visibility\s*:\s*hidden)"), F.lit(False))


def image_caption(c: str | Column) -> Column:
    return F.trim(col(c)).rlike(r"(?i)^(?:fig(?:ure)?|plate|table|illustration|photo(?:graph)?|map|chart|diagram)(?![A-Za-z0-9_])")


def srcset_best(c: str | Column) -> Column:
    """The candidate of the largest descriptor; the first of equals."""
    parts = F.filter(F.transform(F.split(col(c), ","), lambda s: F.trim(s)), lambda x: x != "")
    weighed = F.transform(parts, lambda x, i: F.struct(-F.coalesce(F.nullif(F.regexp_extract(x, r"\s([0-9.]+)[wx]\z", 1), F.lit("")).try_cast("double"), F.lit(1.0)), i, F.split(x, r"\s+")[0].alias("url")))
    return F.get(F.array_sort(weighed), F.lit(0))["url"]
