"""Operator 13 against brute force, with both ways to encode, and its sort against sorted()."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import collocations as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long"


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score), straight from the definition."""
    f, total = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside.get(p[i : i + m], 0), a)
        kept = []
        for p, a in found.items():
            score, _, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, k) for k in range(1, len(p)))
            if 100 * inside.get(p, 0) < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "Sea", "sea", "é", "日本", "a\x01", "a", "zz" * 400, "\x00", "b"]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "de", None])))
    rows += [("hot pair " * 500, "en"), (None, "en"), ("", None), (";;;", "fr"), ("hot pair", "en"), ("hot pair", "en"), ("New York is one word " * 9, "en")]
    return rows


@pytest.mark.parametrize("dictionary_rows, filter_bits, block", [(400_000, 1 << 26, 1 << 20), (0, 1 << 12, 50)])
def test_phrases(spark, dictionary_rows, filter_bits, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", 0, "clash", 5) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    params = C.PhraseParams(least=6, top=40, dictionary_rows=dictionary_rows, filter_bits=filter_bits, block=block, range_rows=300)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.phrases(docs, params).collect())
    want = brute(rows, 6, 40)
    assert got == want and len(want) > 60


def test_very_long_text(spark):
    rows = [("one two three. " * 60_000 + "x" * 100_000, "en")]
    docs = spark.createDataFrame([(1, *rows[0])], "doc_id long, text string, lang string")
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.phrases(docs).collect()]
    assert got == brute(rows, 30, 2000)


def test_empty_table(spark):
    assert C.phrases(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert C.phrases(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).count() == 0


def test_radix_order():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) % np.uint64(97), rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    order = C.radix_order(high, low)
    assert list(zip(high[order], low[order])) == sorted(zip(high, low))
    h, lo, n = C.run_lengths(high % np.uint64(3), low % np.uint64(5))
    assert dict(zip(zip(h.tolist(), lo.tolist()), n.tolist())) == Counter(zip((high % np.uint64(3)).tolist(), (low % np.uint64(5)).tolist()))


def test_large_counts_do_not_overflow(spark):
    big = 4 * 10**18
    pair = spark.createDataFrame([(bytes([0, 0, 0, 1, 0, 0, 0, 2]) + bytes(8), big)], "key binary, f long")
    words = spark.createDataFrame([(bytes([0, 0, 0, i]) + bytes(12), 2 * big) for i in (1, 2)], "key binary, f long")
    assert [r["score"] for r in C.scored(pair, words, C.PhraseParams()).collect()] == [500_000]


def test_a_word_is_joined_once_a_step(spark):
    # 40 texts of 3,000 words, 30 distinct ones: the join takes a row for each distinct word of a step, not for each of 120,000 places
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [("en", " ".join(rng.choice(words) + rng.choice(["", "", "."]) for _ in range(3000)).encode()) for _ in range(40)]
    docs = spark.createDataFrame(texts, "lang string, text binary").repartition(2)
    dictionary = spark.createDataFrame([("en", w.encode(), i + 1, 7) for i, w in enumerate(words[:25])], "lang string, word binary, id long, n long")
    C.with_checkpoints(spark)

    def written() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def pairs(encoded) -> Counter:
        found = Counter()
        for r in encoded.collect():
            for high, low in C.phrase_keys(bytes(r["ids"]), (2, 3, 4), None, 0):
                found.update(zip(high.tolist(), low.tolist()))
        return found

    want, before = pairs(C.encode_by_broadcast(docs, dictionary)), written()
    assert pairs(C.encode_by_join(docs, dictionary)) == want
    assert written() - before < 5_000
    assert pairs(C.encode_by_join(docs, dictionary, longest=100)) == want
