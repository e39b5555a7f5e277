"""Features, fits and whole queries against plain versions; very long texts and clashing columns for every operator on texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from leafmill.llm import langid, licenses, media, mixing, pieces, probminhash, quality, sketch, tokencount, urlfilter
from leafmill.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_quality_features_and_calibration():
    texts = ["", "a", "plain words in a row " * 400, "%%% ### " * 300, "é日本" * 5000]
    model = quality.fit_rows([("good plain words in a row, and more of them. " * 9, 1), ("%%% ### $$$ &&& ***" * 9, 0)] * 30)
    scorer = quality.Scorer(model.good, model.bad, model.params)
    size = {}
    for name, content in (("good", model.good), ("bad", model.bad)):
        squeeze = zstandard.ZstdCompressor(level=model.params.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        size[name] = squeeze.compress
    for t in texts:
        raw = t.encode()
        blocks = [raw[i : i + model.params.block] for i in range(0, len(raw), model.params.block)]
        g, b = [len(size["good"](x)) for x in blocks], [len(size["bad"](x)) for x in blocks]
        if raw:
            d = (sum(b) - sum(g)) / max(sum(b), sum(g))
            ratio = sum(g) / (len(raw) + 12 * len(blocks))
            want = [d, sum(len(x) for x, p, q in zip(blocks, g, b) if q < p) / len(raw), ratio, max(0.0, 0.3 - ratio), d * min(1.0, len(raw) / 200)]
        else:
            want = [0.0] * 5
        assert scorer.features(raw) == pytest.approx(want)
        z = sum(w * x for w, x in zip(model.weights, [*want, 1.0]))
        assert quality.score_texts(model, [raw])[0] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=300) > 0.3).astype(float)
    w = quality._logistic(x, y)
    full = np.hstack([x, np.ones((300, 1))])
    p = 1 / (1 + np.exp(-(full @ w)))
    assert np.abs(full.T @ (y - p) - 1e-3 * w).max() < 1e-6


def test_quality_query_scores_every_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in Q.op1_quality_classifier(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, s in zip(texts, quality.score_texts(model, [t.encode() for t in texts.values()])):
        assert got[i]["score"] == s and got[i]["predicted"] == (s >= 0.3)


def test_language_profiles_from_the_same_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["text"], r["lang"]) for r in langid.training_rows(docs).collect()]
    own, plain = langid.fit(docs), langid.fit_rows(rows)
    assert own.languages == plain.languages and own.profiles == plain.profiles


def test_url_features(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url")
    odd = spark.createDataFrame([("",), ("x",), ("http://a",), ("http://User@A.b-c.example:80/p_q/1/?a=1&b=2&c#f",), ("https://ü.example/日本",)], "url string")
    host, path = urlfilter.parts(F.col("url"))
    rows = urlfilter.lexical(pages.unionByName(odd).withColumns({"host": host, "path": path})).collect()
    for r in rows:
        url = r["url"]
        after = url.partition("://")[2] if "://" in url else ""
        h = re.match(r"[^/?#]*", after)[0]
        p = re.match(r"[^?#]*", after[len(h) :])[0]
        counts, n = Counter(url), max(1, len(url))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        assert (r["host"], r["path"]) == ("".join(c.lower() if "A" <= c <= "Z" else c for c in h), p)
        want = {"length": len(url), "host_length": len(h), "path_length": len(p), "depth": p.count("/"), "labels": h.count("."), "digit_ratio": sum(c in "0123456789" for c in url) / n, "entropy": entropy, "parameters": url.count("&") + url.count("?"), "hyphens": url.count("-") + url.count("_")}
        for k, v in want.items():
            assert r[k] == pytest.approx(v), (k, url)


LONG = "Eine Zeile Text, the MIT License and more. " * 12_000  # half a million characters
CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, sketch string, size long, class_id long, ids string, feature string, n_tokens long, path string, labels string"


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([LONG, LONG + "the end", "short", None])]
    return spark.createDataFrame([(*r, 0.5, "x", 1, 2, "y", "z", 3, "p", "l") for r in rows], CLASH)


def test_long_texts_and_clashing_columns(spark, long_docs):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    model = quality.fit_rows([("good plain words in a row, and more of them. " * 9, 1), ("%%% ### $$$ &&& ***" * 9, 0)] * 30)
    assert by(quality.classify(long_docs, model))[0]["score"] == quality.score_texts(model, [LONG.encode()])[0]
    languages = langid.fit_rows([("the MIT License and more words", "en"), ("eine Zeile und der Text", "de")])
    assert by(langid.identify(long_docs, languages))[0]["lang_pred"] == langid.Ranker(languages).predict(LONG)[0]
    got = by(media.text_media(long_docs))
    assert got[0]["n_bytes"] == len(LONG) and got[3]["n_bytes"] == 0 and got[3]["payload_bytes"] == 64
    got = by(licenses.scan_licenses(long_docs, with_spans=False))
    assert (got[0]["n_base"], got[0]["n_words"], got[0]["base_labels"]) == (12_000, len(LONG.split()), "mit")
    got = by(pieces.encode_pieces(long_docs, Q.tokenizer_path("piece_bpe_32k.model")))
    assert got[0]["round_trip"] and got[0]["n_bytes"] == len(LONG) and len(got[0]["ids"]) == got[0]["n_pieces"]
    got = by(probminhash.near_classes(long_docs))
    assert got[0]["class_id"] == got[1]["class_id"] == 0 and got[2]["class_id"] == 2
    got = by(sketch.fingerprints(long_docs))
    assert got[0]["n_chars"] == len(LONG) and got[0]["near_next"] > 0.9
    got = by(tokencount.count_tokens(long_docs, Q.tokenizer_path("piece_bpe_32k.model")))
    assert got[0]["over_limit"] and not got[2]["over_limit"] and got[3]["n_tokens"] == 0
    got = by(mixing.mix(long_docs))
    assert got[0]["size"] == len(LONG.split()) and sum(r["taken"] for r in got.values()) > 0
