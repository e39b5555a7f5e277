"""Pacing of rapid word display: pauses, ramps and settings, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import js_round, letters

#: Limits and defaults of the tempo settings (name: least, most, step, default).
TEMPO = {
    "commaBreakMs": (0, 200, 10, 30),
    "semicolonBreakMs": (0, 200, 10, 30),
    "sentenceBreakMs": (0, 300, 10, 60),
    "paragraphBreakMs": (0, 800, 20, 180),
    "chapterBreakMs": (0, 1600, 25, 425),
    "longWordDelayMsAtTenLetters": (0, 80, 5, 20),
    "chapterStartSlowdownPercent": (0, 35, 1, 15),
    "chapterRampWords": (1, 40, 1, 18),
}
START_SLOWDOWN, START_WORDS = 30, 25
WPM = (100, 600, 5, 250)
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "etc.", "e.g.", "i.e.", "vs.", "no.", "vol.")


@dataclass(frozen=True)
class Tempo:
    comma: int = 30
    semicolon: int = 30
    sentence: int = 60
    paragraph: int = 180
    chapter: int = 425
    long_word: int = 20
    slowdown: int = 15
    ramp: int = 18


def clamp_step(c: Column, least: float, most: float, step: float) -> Column:
    """Into the range, then to the next multiple of the step."""
    return js_round(F.greatest(F.lit(least), F.least(F.lit(most), c)) / step) * step


def clamp_wpm(c: Column) -> Column:
    """Words a minute, 250 where unknown or not finite, from 100 to 600."""
    finite = c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.when(finite, F.greatest(F.lit(WPM[0]), F.least(F.lit(WPM[1]), c))).otherwise(WPM[3])


def normalize_wpm(c: Column) -> Column:
    return js_round(clamp_wpm(c) / WPM[2]) * WPM[2]


def step_wpm(c: Column, direction: int) -> Column:
    return clamp_wpm(normalize_wpm(c) + 10 * direction)


def normalize_rate(c: Column) -> Column:
    """Speech rate from 1.0 to 3.0 in tenths."""
    finite = c.isNotNull() & ~F.isnan(c.cast("double"))
    return F.when(finite, js_round(F.greatest(F.lit(1.0), F.least(F.lit(3.0), c)) * 10) / 10).otherwise(F.lit(1.0))


def tempo_sanitize(json: Column) -> Column:
    """Settings from JSON: missing ones by default, all missing gives null, each clamped to its range and step."""
    raw = F.from_json(json, ", ".join(f"{k} DOUBLE" for k in TEMPO))
    some = F.coalesce(*[F.when(raw[k].isNotNull(), F.lit(True)) for k in TEMPO], F.lit(False))
    return F.when(some, F.struct(*[clamp_step(F.coalesce(raw[k], F.lit(float(d))), lo, hi, st).alias(k) for k, (lo, hi, st, d) in TEMPO.items()]))


def long_word_pause(word: Column, at_ten: int) -> Column:
    n = letters(word)
    return F.when((n <= 0) | F.lit(at_ten <= 0), F.lit(0).cast("long")).otherwise(js_round(at_ten * F.greatest(F.lit(4), n) / 10))


def sentence_break(word: Column, following: Column) -> Column:
    """Whether a pause for a sentence's end follows the word."""
    bare = F.regexp_replace(word, r"[)\]]+\z", "")
    stop = bare.rlike(r"\.(?:[\"')\]]+)?\z")
    never = F.lower(bare).isin(*ABBREVIATIONS) | bare.rlike(r"^(?:[A-Z]\.)+\z") | bare.rlike(r"^[0-9]+\.[0-9]+\z")
    capital = F.coalesce(following.rlike(r"^[(\[{]*[A-Z]"), F.lit(False))
    return F.when(bare.rlike(r"[!?](?:[\"')\]]+)?\z"), True).when(~stop | never, False).otherwise(capital)


def ramp_delay(wpm: Column, index: Column, words: int, slowdown: int) -> Column:
    """Milliseconds a word while the speed rises linearly over the first ``words`` words."""
    target = clamp_wpm(wpm)
    start = F.greatest(F.lit(1.0), target * (1 - max(0, min(100, slowdown)) / 100))
    progress = F.lit(1.0) if words <= 1 else index / float(max(1, words - 1))
    return F.when(index >= max(1, words), js_round(60000 / target)).otherwise(js_round(60000 / (start + (target - start) * progress)))


def next_word_delay(wpm: Column, since_start: Column, since_chapter: Column, tempo: Tempo = Tempo()) -> Column:
    """The slower of the start's ramp and the chapter's; a null ``since_chapter`` means that no chapter has begun."""
    start = ramp_delay(wpm, since_start, START_WORDS, START_SLOWDOWN)
    return F.when(since_chapter.isNull(), start).otherwise(F.greatest(start, ramp_delay(wpm, since_chapter, tempo.ramp, tempo.slowdown)))


def structural_pause(word: Column, next_word: Column, same_paragraph: Column, same_chapter: Column, next_kind: Column, scene: Column, tempo: Tempo = Tempo()) -> Column:
    """Chapter, then scene, paragraph, sentence, semicolon, comma; 0 after the last word."""
    middle = (tempo.paragraph + tempo.chapter + 1) // 2
    return (
        F.when(next_word.isNull(), 0)
        .when(~same_chapter & next_kind.isin("scene", "section"), middle)
        .when(~same_chapter, tempo.chapter)
        .when(F.coalesce(scene, F.lit(False)), middle)
        .when(~same_paragraph, tempo.paragraph)
        .when(sentence_break(word, next_word), tempo.sentence)
        .when(word.rlike(r";(?:[\"')\]]+)?\z"), tempo.semicolon)
        .when(word.rlike(r",(?:[\"')\]]+)?\z"), tempo.comma)
        .otherwise(0)
        .cast("long")
    )


def priority_pause(structural: Column, word: Column, tempo: Tempo = Tempo()) -> Column:
    return F.when(structural > 0, structural).otherwise(long_word_pause(word, tempo.long_word))


def speech_pause(starts: Column, nav_kind: Column, scene: Column) -> Column:
    """Milliseconds of silence before a paragraph that is spoken."""
    return F.when(starts, 0).when(nav_kind.isin("scene", "section"), 650).when(nav_kind.isNotNull(), 1000).when(scene, 650).otherwise(280)
