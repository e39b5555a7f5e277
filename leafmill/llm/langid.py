"""Operator 2, language: rank-order n-gram profiles and the out-of-place distance.

A profile lists the most frequent 1- to 3-grams of letters (a word is padded by a blank on both sides), most
frequent first. The distance of a document to a language adds up, over the document's own most frequent n-grams,
how far each is out of its place in the language's profile; an n-gram that the profile lacks costs the most.

Defined results: null texts and texts without any letter give ``und`` with score 0; ties of counts go by the
n-gram's code points, ties of distances by the language's name; repeated rows get the same result each; an empty table
gives an empty result; without any training row everything is ``und``. The score is 1 for a perfect fit of
the best language and 0 where the runner-up fits as well. A null doc_id belongs to no fold: it teaches nothing and its ``held_out`` is
null. A very long text is held whole by one task, at about 60 bytes a character. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._batches import crc32_mod, excerpt, map_rows, small_enough, with_checkpoints

UNKNOWN = "und"
#: Bytes of text whose n-grams one step of the fit holds at once, at some 100 bytes a byte.
FIT_BYTES = 256 << 10
#: Languages beyond which their counts are not broadcast.
BROADCAST_LANGUAGES = 100_000


@dataclass(frozen=True)
class LanguageParams:
    """``sample_docs`` and ``sample_chars`` bound the labelled rows that the fit reads for each language: about so many documents, and
    of a longer text so many characters, in four parts spread over it. Every language with a labelled document is learned.
    Prediction has no bound."""

    profile: int = 400
    top: int = 300
    sample_docs: int = 2000
    sample_chars: int = 20_000


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return table


def grams(text: str) -> np.ndarray:
    """Keys of all 1- to 3-grams of the text's words, 21 bits a code point; blanks alone are no n-gram."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    points = np.concatenate([[32], np.where(letter, points, 32), [32]]).astype(np.int64)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]  # one blank between words
    if len(points) < 2:
        return np.zeros(0, np.int64)
    one = points[points != 32]
    two = (points[:-1] << 21) | points[1:]
    three = ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[points[1:-1] != 32]
    return np.concatenate([one, two, three])


def ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent keys, most frequent first, ties by key."""
    found, counts = np.unique(keys, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class LanguageModel:
    """For each language its ranked profile of at most ``profile`` keys, 3.2 kB; the only thing the driver gathers."""

    languages: tuple[str, ...]
    profiles: tuple[tuple[int, ...], ...]
    params: LanguageParams


class Ranker:
    """Profiles merged to one table sorted by key, a row for each key of each language."""

    def __init__(self, model: LanguageModel):
        self.model, self.missing = model, model.params.profile
        keys = np.array([k for p in model.profiles for k in p], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.language = np.repeat(np.arange(len(model.profiles)), [len(p) for p in model.profiles])[order]
        self.place = np.array([i for p in model.profiles for i in range(len(p))], np.int64)[order]

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the largest possible; None without any letter."""
        own = ranked(grams(text), self.model.params.top)
        if not len(own):
            return None
        low, high = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        n = high - low
        place = np.repeat(np.arange(len(own)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        gain = np.bincount(self.language[at], self.missing - np.minimum(self.missing, np.abs(self.place[at] - place)), len(self.model.languages))
        return 1 - gain / (self.missing * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages or (d := self.distances(text)) is None:
            return UNKNOWN, 0.0
        order = np.argsort(d, kind="stable")
        best, second = d[order[0]], d[order[1]] if len(order) > 1 else 1.0
        return self.model.languages[order[0]], float(min(1.0, max(0.0, 1 - best / second if second > 0 else 0.0)))


def fit_rows(rows: list[tuple[str, str]], params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Profiles of (text, language) rows."""
    by: dict[str, list[str]] = {}
    for text, lang in rows:
        by.setdefault(lang, []).append(text)
    names = tuple(sorted(x for x in by if any(len(grams(t)) for t in by[x])))
    return LanguageModel(names, tuple(tuple(ranked(np.concatenate([grams(t) for t in by[n]]), params.profile).tolist()) for n in names), params)


def training_rows(documents: DataFrame, fold: int = 3, held: int = 1, params: LanguageParams = LanguageParams()) -> DataFrame:
    """lang and (an excerpt of) text of a repeatable sample: of each language the usable documents whose hash is in a range that
    about ``sample_docs`` of them fall into; a language of no more documents is taken whole. Nothing is gathered but a count a language."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod("doc_id", fold) != held))
    with_checkpoints(documents.sparkSession)
    counts = usable.groupBy("lang").agg(F.count("*").alias("__count")).checkpoint()
    counts = F.broadcast(counts) if small_enough(counts, BROADCAST_LANGUAGES) else counts
    share = F.least(F.lit(1.0), F.lit(float(params.sample_docs)) / F.col("__count"))
    drawn = usable.select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("__draw")).join(counts, "lang")
    return drawn.where(F.col("__draw") < share).select("lang", excerpt(F.col("text"), params.sample_chars).alias("text"))


def fit(documents: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Profiles from the sample's n-gram counts, which executors make and add up; ``profile`` keys a language reach the driver."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            found = [(lang, *np.unique(np.concatenate(g), return_counts=True)) for lang, g in by.items()]
            return {"lang": [lang for lang, keys, _ in found for _ in range(len(keys))], "key": np.concatenate([k for _, k, _ in found]), "n": np.concatenate([n for _, _, n in found])}

        return work

    counted = map_rows(training_rows(documents, params=params), "text", "lang string, key long, n long", make, FIT_BYTES).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counted.withColumn("place", place).where(F.col("place") <= params.profile).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("profile"))
    by = {r["lang"]: tuple(x["key"] for x in r["profile"]) for r in sorted(top.collect(), key=lambda r: r["lang"])}
    return LanguageModel(tuple(by), tuple(by.values()), params)


def accepter(model: LanguageModel) -> Callable[[list[bytes | None]], list[bool]]:
    """A function that tells of texts whether they have a language."""
    ranker = Ranker(model)
    return lambda texts: [t is not None and ranker.predict(t.decode("utf-8", "replace"))[0] != UNKNOWN for t in texts]


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``documents``; one pass, no shuffle."""

    def make():
        ranker = Ranker(model)

        def work(part: pa.RecordBatch) -> dict:
            got = [ranker.predict(t) for t in part.column("text").to_pylist()]
            return {"doc_id": part.column("doc_id"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    return map_rows(documents.select("doc_id", "text"), "text", f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double", make)
