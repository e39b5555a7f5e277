"""The ten operators against brute force, round trips and held-out labels, with nulls, empties, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import langid, license_rules, licenses, media, mixing, pieces, probminhash, quality, shingles, sketch, tokencount, urlfilter
from leafmill.llm import queries as Q
from leafmill.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "null id", "en", "a", 7), (3, "x" * 70_000, None, "b", 0), (4, "Ünïcode ß 日本\x00\n\t", "de", "b", 9), (5, "same words here now ok fine", "en", "a", 5), (5, "same words here now ok fine", "en", "a", 5), (6, "... !!!", "fr", "a", 2), (7, "😀 emoji", "fr", "", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# 1 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.9
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_quality_difference_carries_the_score():
    """Held-out area under the curve by the normalised size difference alone, without the compressibility that sharpens it."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    rows = [(r["doc_id"], text[r["doc_id"]], r["quality"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = quality.fit_rows([(t, q) for i, t, q in rows if not held(i)])
    scorer = quality.Scorer(model.good, model.bad, model.params)
    good, bad = [[scorer.features(t.encode())[0] for i, t, q in rows if held(i) and q == k] for k in (1, 0)]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.93


def test_quality_cases(spark, odd):
    model = quality.fit_rows([("good plain words in a row. " * 8, 1), ("%%% ### $$$ &&& ***" * 9, 0)] * 12)
    rows = quality.classify(odd.withColumn("score", F.lit(9)), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score_texts(model, [b"good plain words in a row."])[0] > quality.score_texts(model, [b"%%% ### $$$ &&&"])[0]
    assert quality.score_texts(quality.fit_rows([]), [b"x"]) == [0.5] and quality.score_texts(quality.fit_rows([("a", 1)]), [None])[0] > 0.99
    empty = odd.limit(0)
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "doc_id long, quality int")
    assert quality.classify(empty, quality.fit(empty, labels)).count() == 0


def test_long_labelled_texts_are_learned(spark):
    good, bad = "good plain words in a row of many more. ", "%%% ### $$$ &&& ***"
    rows = [(i, good * 10, "en") for i in range(60)] + [(i, bad * 2000, "zz") for i in range(60, 120)] + [(i, "ждущий текст длинной книги " * 1500, "ru") for i in range(120, 180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(i, 0) for i in range(1000, 1400)], "doc_id long, quality int")
    model = quality.fit(docs, labels, quality.QualityParams(sample_docs=40))
    assert model.good and model.bad
    assert quality.score_texts(model, [good.encode() * 9])[0] > 0.5 > quality.score_texts(model, [bad.encode() * 9])[0]
    assert max(len(t) for t, _ in quality.training_rows(docs, labels)) <= 20_003
    assert langid.Ranker(langid.fit(docs)).predict("длинный текст")[0] == "ru"


# 2 language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95


def brute_language(text, profiles, params):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    line = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if (n == 1 and g == " ") or (n == 3 and g[1] == " "):
                continue
            grams[g] += 1
    if not grams:
        return "und"
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    own = sorted(grams, key=lambda g: (-grams[g], key(g)))[: params.top]
    cost = lambda p: sum(abs(p.index(key(g)) - i) if key(g) in p else params.profile for i, g in enumerate(own))
    return min(sorted(profiles), key=lambda name: cost(profiles[name]))


def test_language_brute_force(texts, docs):
    params = langid.LanguageParams(profile=60, top=40)
    model = langid.fit_rows([(r["text"], r["lang"]) for r in docs.limit(60).collect()], params)
    ranker = langid.Ranker(model)
    profiles = {n: list(p) for n, p in zip(model.languages, model.profiles)}
    for t in [*list(texts.values())[60:90], "", None, "?!", "É"]:
        assert ranker.predict(t)[0] == brute_language(t or "", profiles, params)


def test_language_cases(odd):
    model = langid.fit(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[6]["lang_pred"] == "und" and got[1]["score"] == 0
    assert langid.identify(odd.limit(0), langid.fit(odd.limit(0))).count() == 0


# 3 media


def test_media_round_trip(spark, odd, docs):
    for df in (odd, docs.limit(50)):
        want = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
        for r in media.text_media(df).collect():
            data = want[r["doc_id"]]
            payload = data + bytes(-len(data) % 64 or (0 if data else 64))
            assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload)) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def bmp(bits, rows, palette=b""):
    h, w = len(rows), len(rows[0])
    body = b""
    for row in reversed(rows):
        if bits == 24:
            line = b"".join(bytes(p[::-1]) for p in row)
        elif bits == 8:
            line = bytes(row)
        else:
            line = np.packbits(np.array(row, np.uint8)).tobytes()
        body += line + bytes(-len(line) % 4)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(palette) + len(body), 0, 0, 54 + len(palette)) + head + palette + body


def test_decoders():
    assert media.decode(b"P2 # c\n2 2\n255\n0 1\n2 255").tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 1, 0]] and media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]] and media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert media.decode(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 2\nMAXVAL 255\nENDHDR\nab").tolist() == [[[97, 98]]]
    assert media.decode(bmp(24, [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (0, 0, 0)]])).tolist() == [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [0, 0, 0]]]
    pal = bytes([0, 0, 0, 0, 255, 255, 255, 0])
    assert media.decode(bmp(8, [[0, 1, 0]], pal)).tolist() == [[[0] * 3, [255] * 3, [0] * 3]] and media.decode(bmp(1, [[1, 0]], pal)).tolist() == [[[255] * 3, [0] * 3]]
    for bad in (b"", b"P5", b"P5\n9 9\n255\n1", b"P5\n99999999 99999999\n255\n", b"P9\n", b"BM", b"BM" + bytes(80), b"GIF89a"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def masked(bits, masks, pixels):
    body = b"".join(p.to_bytes(bits // 8, "little") for p in pixels)
    body += bytes(-len(body) % 4)
    head = struct.pack("<IiiHHIIiiII", 40, len(pixels), 1, 1, bits, 3, len(body), 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 66 + len(body), 0, 0, 66) + head + struct.pack("<III", *masks) + body


def test_bmp_masks():
    assert media.decode(masked(16, (0xF800, 0x07E0, 0x001F), [0xF800, 0x07E0, 0x001F, 0x8410])).tolist() == [[[255, 0, 0], [0, 255, 0], [0, 0, 255], [132, 130, 132]]]
    assert media.decode(masked(32, (0x0000FF, 0x00FF00, 0xFF0000), [0x030201])).tolist() == [[[1, 2, 3]]]
    for masks in ((0, 0x07E0, 0x1F), (0xF0F0, 0x07E0, 0x1F), (0x1F0000, 0x07E0, 0x1F)):
        with pytest.raises(media.MediaError):
            media.decode(masked(16, masks, [0]))


def test_text_features_brute_force(docs, odd):
    """Every column of the query from the bytes alone; one text of 5 MB."""
    rows = [(1000 + r["doc_id"], r["text"]) for r in docs.limit(40).collect()] + [(d[0], d[1]) for d in ODD] + [(99, "a longer text. " * 340_000)]
    got = media.text_media(odd.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], len((r[1] or "").encode()), r[1] or "")), sorted(got, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_sha256"]))):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        a = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
        h = len(a)
        weigh = lambda n, cells: np.array([[max(0.0, min(i + 1, (c + 1) * n / cells) - max(i, c * n / cells)) for i in range(n)] for c in range(cells)])
        want = (doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(r)[:7] == want
        if h < 3000:
            small = weigh(h, 8) @ a @ weigh(64, 9).T * (8 * 9 / h / 64)
            near = np.abs(np.diff(small)) < 1e-5
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["feature"].split(":")[1]), np.uint8)).reshape(8, 8)
            assert r["feature"].split(":")[0] == f"64x{h}" and ((bits == (np.diff(small) > 0)) | near).all()


def test_area_resize():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (3, 64), (17, 23), (64, 64)):
        a = rng.integers(0, 256, (h, w))
        big = np.kron(a, np.ones((8, 9)))  # each target cell covers whole cells of this
        want = big.reshape(8, h, 9, w).mean((1, 3))
        assert np.allclose(media.area_resize(a, 8, 9), want)


def test_text_media_tiles_and_long_texts(monkeypatch):
    image = np.arange(600 * 300, dtype=np.uint32).reshape(600, 300)
    assert (media.from_tiles(media.tiles(image)) == image).all()
    monkeypatch.setattr(media, "MAX_PIXELS", 1000)
    cut = []
    monkeypatch.setattr(media, "tiles", lambda image, size=256, real=media.tiles: cut.append(image.shape) or real(image, size))
    data = b"a longer text than the bound " * 1000
    assert media.text_row(data, 64)[:2] == (29_000, 29_056) and cut == [(454, 64)]
    with pytest.raises(media.MediaError):
        media.decode(media.encode_pgm(bytes(1024), 64))


def test_media_table(spark):
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(bytes(range(64)) * 3, 64)), "w"), (2, None, "w"), (3, bytearray(b"junk"), "w")], "id int, content binary, width string")
    got = {r["id"]: r for r in media.decode_media(df).collect()}
    assert (got[1]["width"], got[1]["height"]) == (64, 3) and got[2]["error"] is None and got[3]["error"]
    tiles = media.decode_media(df, tile=40).where("id = 1").collect()
    import io

    assert sorted(np.load(io.BytesIO(t["npy"])).shape for t in tiles) == [(3, 24), (3, 40)]


# 4 licences


def test_licenses_prefilter_loses_nothing(texts):
    scanner = licenses.Scanner()
    examples = ["Apache License, Version 2.0", "GNU General Public License, version 3.", "CC BY-NC-SA 4.0", "https://opensource.org/licenses/MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0)", "Permission is hereby granted, free of charge, to any person obtaining a copy", "released into the public domain", "X11 License", "All Rights Reserved", "Mozilla Public License, v. 2.0", "zlib License BSD 3-Clause License"]
    for text in [*texts.values(), *examples, " ".join(examples)]:
        low = text.encode().lower()
        every = [licenses.Detection(*m.span("at" if "at" in r.find.groupindex else 0), r.priority, i, r.label) for i, r in enumerate(scanner.rules) for m in r.find.finditer(low)]
        assert scanner.detections(low) == every
        kept = licenses.settle(every)
        for d in every:  # brute force: d stays unless something better contains it
            better = any(e.start <= d.start and d.end <= e.end and (e.priority > d.priority or e.priority == d.priority and (e.end - e.start > d.end - d.start or (e.end - e.start == d.end - d.start and e.order < d.order))) for e in every)
            assert (d in kept) == (not better)


def alternatives(tree):
    """Texts of a parsed bytes pattern that together take every alternative, option and absence of an option; lookaround is left out."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            kind, value = arg[0]
            parts.append([" " if str(kind) == "CATEGORY" else chr(value if str(kind) == "LITERAL" else value[0])])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "BRANCH":
            parts.append([t for one in arg[1] for t in alternatives(one)])
        elif name == "SUBPATTERN":
            parts.append(alternatives(arg[3]))
        elif name == "ATOMIC_GROUP":
            parts.append(alternatives(arg))
        elif name.endswith("REPEAT"):
            parts.append(([""] if arg[0] == 0 else []) + [t * max(1, arg[0]) for t in alternatives(arg[2])])
        else:
            assert name.startswith("ASSERT"), name
    first = [p[0] for p in parts]
    return list(dict.fromkeys("".join(first[:i] + [t] + first[i + 1 :]) for i, p in enumerate(parts) for t in p))


def test_license_keywords_of_every_alternative():
    scanner = licenses.Scanner()
    for i, r in enumerate(scanner.rules):
        made = [t.encode("latin-1") for t in alternatives(re._parser.parse(r.find.pattern, re.S))]
        fit = [t for t in made if r.find.search(t)]
        assert fit and (r.priority == 60 or len(fit) > len(made) // 2), r
        for t in fit:
            assert i in {d.order for d in scanner.detections(t)}, (r.label, t)
    scan = lambda t: scanner.scan(t)["labels"].split(",")
    for text, label in ((b"not without the prior written consent of", "proprietary"), (b"without any warranties", "no-warranty"), (b"unpublished proprietary source code", "proprietary"), (b"see the licence for the specific language", "generic-license")):
        assert label in scan(text)


def test_license_gaps_of_any_length():
    scanner = licenses.Scanner()
    scan = lambda t: scanner.scan(t.encode())["labels"].split(",")
    assert "apache-2.0" in scan(" " * 33 + "Apache License\n" + " " * 27 + "Version 2.0, January 2004\n" + " " * 24 + "http://www.apache.org/licenses/")
    assert "gpl-3.0" in scan(" " * 20 + "GNU GENERAL PUBLIC LICENSE\n" + " " * 28 + "Version 3, 29 June 2007")
    box = "\n" + "/*" + "*" * 70 + "*/\n" + "#" * 40 + "\n"
    notices = [line for line in license_rules.NOTICES.strip().splitlines() if line.startswith("permission_is_hereby") or line.startswith("redistribution_and_use")]
    for gap in (" " * 60, "\n" + " " * 60 + "* ", box):
        assert {"mit", "bsd-2-clause"} <= set(scan("\n\n".join(n.replace(",?", "").replace("_", gap) for n in notices)))
        for text, label in (("ICU License{}-{}ICU", "icu"), ("CERN Open Hardware Licence Version 2{}-{}Permissive", "cern-ohl-p-2.0"), ("Eclipse Public License{}-{}v 2.0", "epl-2.0"), ("Boost Software License{}-{}Version 1.0", "bsl-1.0"), ("{}{}licensed under{}the terms of x", "generic-license")):
            assert label in scan(text.format(*[gap] * text.count("{}"))), (text, gap)
    found = lambda t: {d.label: t[d.start : d.end] for d in scanner.detections(t)}
    assert found(b"icu license - icu")["icu"] == b"icu license - icu" and "cern-ohl-p-2.0" not in found(b"cern open hardware licence version 2 permissive")
    assert scanner.detections(b"boost software license" + b" - " * 50_000 + b"gnu gpl is copyright" + b"\n" * 200_000 + b"linking licensed under" + b"*" * 200_000)


def test_license_addresses():
    scanner = licenses.Scanner()
    for line in license_rules.FAMILIES.strip().splitlines():
        label, _, address = line.split(" | ")
        for url in alternatives(re._parser.parse(address)) if address != "-" else []:
            assert any(d.label == label and d.priority == 48 for d in scanner.detections(f"see https://{url} here".encode())), url
    for url, label in (("http://www.boost.org/LICENSE_1_0.txt", "bsl-1.0"), ("http://www.php.net/license/3_01.txt", "php-3.01"), ("http://www.cecill.info/licences/Licence_CeCILL_V2.1-en.html", "cecill-2.1"), ("http://zlib.net/zlib_license.html", "zlib")):
        assert label in scanner.scan(url.encode())["labels"].split(","), url


def test_license_base(odd, texts):
    scanner = licenses.Scanner()
    tricky = ["MIT license, mit  LICENSE mit-license", "permit license", "mit licenses", "general public license apache\nlicense", "mit", "ümit license", "", "mit mit license license"]
    for text in [*texts.values(), *tricky]:
        import re

        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase)
        got = scanner.scan(text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert got["base_labels"] == ",".join(sorted({p[1] for p in places})) and set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(","))
    assert licenses.scan_licenses(odd).count() == len(ODD) and len(licenses.rules()) > 300


def test_license_labels():
    scan = lambda t: licenses.Scanner().scan(t.encode())["labels"].split(",")
    assert "gpl-3.0" in scan("licensed under the GNU General Public License, version 3.") and "apache-2.0" in scan("Apache License, Version 2.0") and {"mit", "bsd-3-clause"} <= set(scan("SPDX-License-Identifier: BSD-3-Clause OR MIT"))
    assert scan("a plain text about permits and a general public") == [""]


# 5 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load(Q.tokenizer_path("piece_bpe_32k.model"))


def unigram_twin():
    """The library's own N-best search over the same pieces: the model with its type field set to unigram."""
    import sentencepiece

    raw = open(Q.tokenizer_path("piece_bpe_32k.model"), "rb").read()

    def varint(i):
        n = s = 0
        while True:
            n, s, i = n | (raw[i] & 127) << s, s + 7, i + 1
            if raw[i - 1] < 128:
                return n, i

    i, out = 0, b""
    while i < len(raw):
        key, j = varint(i)
        n, j = varint(j)
        out += raw[i:j] + (raw[j : j + n].replace(b"\x18\x02", b"\x18\x01", 1) if key >> 3 == 2 else raw[j : j + n])
        i = j + n
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def as_ids(b):
    return np.frombuffer(b, "<i4").tolist()


def test_pieces_against_the_library(model, texts):
    sp, rng = unigram_twin(), random.Random(2)
    words = sorted({w for t in list(texts.values())[:80] for w in t.split()})
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for w in rng.sample(words, 300):
        mine, theirs = model.search(" " + w, 5), sp.nbest_encode(w, nbest_size=5, out_type=int)
        assert [s for s, _ in mine] == [score(x) for x in theirs] and all(score(as_ids(b)) == s for s, b in mine)
        best = model.best(" " + w)
        assert best.score == mine[0][0] == score(as_ids(best.ids)) and (len(mine) < 2 or best.gap == mine[0][0] - mine[1][0])
    some = [" " + w for w in rng.sample(words, 400)] + ["  x", "日本 ", "\n", " " * 9]
    assert [(b.score, b.gap) for b in model.best_many(some)] == [(b.score, b.gap) for b in map(model.best, some)]


def test_whole_text_equals_one_lattice(model):
    """N best of a chain of units against A* over the whole text as one lattice."""
    for text in ("the cat sat on the mat", "a  b", "x", "Ünï ß", "end\nnew line", "word*** and more&&& xxxxxxxx"):
        ids, nbest = model.encode(text, 4)
        seen = set()
        whole = model.search(model.prepared(text), 4)
        assert [s for s, _, _ in nbest] == [s for s, _ in whole]
        for (s, n, changes), _ in zip(nbest, whole):
            out, shift = as_ids(ids), 0
            for first, replaced, new in changes:
                out[first + shift : first + shift + replaced] = new
                shift += len(new) - replaced
            assert len(out) == n and model.decode(out) == text.encode() and tuple(out) not in seen
            seen.add(tuple(out))


def test_n_best_by_enumeration(model):
    """The N best of short units against all their segmentations, and long units without a blank in bounded memory."""

    def every(unit):
        if not unit:
            yield 0.0, ()
        for k in range(1, len(unit) + 1):
            found = model.pieces.get(unit[:k]) or ((-1, model.unknown_score) if k == 1 else None)
            if found:
                for score, rest in every(unit[k:]):
                    yield found[1] + score, (found[0], *rest)

    for unit in (" there", "aaaaaaaa", "  a", "日本x", "e", "== ==", "=========", " intern"):
        want = sorted((s for s, _ in every(unit)), reverse=True)
        got = model.search(unit, 7)
        assert [s for s, _ in got] == want[:7] and len({b for _, b in got}) == len(got)
        best = model.best(unit)
        assert best.score == want[0] and best.gap == (want[0] - want[1] if len(want) > 1 else math.inf)
    import tracemalloc

    rng = random.Random(4)
    for text in ("a" * 16_000, "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=16_000)), "日本語" * 5_000):
        model.young, model.old, model.searched = {}, {}, {}
        tracemalloc.start()
        ids, nbest = model.encode(text, 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80 * len(text) + 50_000 and model.decode(as_ids(ids)) == text.encode() and nbest[0][0] >= nbest[-1][0]


def test_pieces_round_trip(model, odd, texts):
    rows = pieces.encode_pieces(odd, Q.tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    back = pieces.decode_pieces(odd.sparkSession.createDataFrame([(r["doc_id"], r["ids"]) for r in rows], "doc_id long, ids array<int>"), Q.tokenizer_path("piece_bpe_32k.model"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((d[0] or 0, d[1] or "") for d in ODD)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    for t in list(texts.values())[:40]:
        ids = as_ids(model.encode(t, 1)[0])
        assert model.decode(ids).decode() == t == sp.decode(ids)


# 6 near duplicates


def brute_shingles(text, n=5):
    import re

    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def brute_similarity(a, b):
    if not a or not b:
        return float(not a and not b)
    x, y = sum(a.values()), sum(b.values())
    return sum(1 / sum(max(a[d] / x / (a[s] / x), b[d] / y / (b[s] / y)) for d in a.keys() | b.keys()) for s in a.keys() & b.keys())


def variants(seed, n, edits, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n - 1):
        v = list(base)
        for _ in range(edits):
            v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
        out.append(v)
    return [" ".join(v) for v in out]


def test_shingles_and_similarity():
    texts = [t.encode() for t in variants(1, 4, 3)] + [b"", b"one two", b"One, TWO!", b"a b c d e a b c d e a b c d e", "é É ß 日本 x y".encode(), b"...", variants(2, 1, 0)[0].encode() * 2]
    owner, value, weight = shingles.shingles(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    bags = [(value[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
    brute = [brute_shingles(t) for t in texts]
    for i, a in enumerate(brute):
        assert sorted(bags[i][1]) == sorted(a.values())
        for j, b in enumerate(brute):
            assert math.isclose(probminhash.similarity(bags[i], bags[j]), brute_similarity(a, b), abs_tol=1e-9)


def test_registers_estimate_similarity():
    texts = [t.encode() for t in variants(3, 6, 4)]
    owner, value, weight = shingles.shingles(texts)
    sign = probminhash.signatures(owner, value, weight, len(texts), 3000)
    for i in range(6):
        for j in range(i):
            assert abs((sign[i] == sign[j]).mean() - brute_similarity(brute_shingles(texts[i]), brute_shingles(texts[j]))) < 0.05


def brute_classes(rows):
    bags = [brute_shingles((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or bags[i] and bags[j] and brute_similarity(bags[i], bags[j]) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {rows[k][0]: min(rows[i][0] for i in range(len(rows)) if top(i) == top(k)) for k in range(len(rows))}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_classes(spark, block):
    texts = variants(5, 12, 2) + variants(6, 12, 4) + variants(7, 8, 5) + variants(8, 5, 30) + ["", "", None, "tiny", "tiny!", "a b c d", "..."] + [variants(9, 1, 0)[0]] * 4
    rows = [(100 + 7 * i % 53 * 3 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r["doc_id"]: r for r in probminhash.near_classes(df, probminhash.NearParams(block=block)).collect()}
    want = brute_classes(rows)
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (k == want[k]) for k, r in got.items())
    kept = probminhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_cases(spark, odd):
    got = probminhash.near_classes(odd).collect()
    assert len(got) == len(ODD) and {r["class_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    kept = probminhash.keep_one(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 3, 4, 5, 6, 7]
    assert probminhash.near_classes(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def top(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        if a and b and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(k, k) == top(k) for k in root)


# 7 sketches


def test_sketch_contract(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in sketch.fingerprints(docs, sketch.SketchParams(bucket_rows=13)).collect()}
    assert len(got) == len(rows)
    near = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        if got[i]["n_hashes"] >= 40:
            a, b = brute_shingles(t.encode()), brute_shingles(edited.encode())
            near.append(got[i]["near_edited"] - len(a.keys() & b.keys()) / len(a))
    assert near and abs(sum(near) / len(near)) < 0.03 and max(map(abs, near)) < 0.4
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_sketch_cases(spark, odd):
    got = sketch.fingerprints(odd).collect()
    assert len(got) == len(ODD) and all(r["fingerprint"] and 0 <= r["near_next"] <= 1 for r in got)
    assert sketch.fingerprints(odd.limit(0)).count() == 0
    one = sketch.fingerprints(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0
    a = sketch.with_sketch(odd, "text", "s", 2)
    assert len(a.select(sketch.merged(F.col("s"), 2).alias("m")).first()["m"]) >= 1


# 8 URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def test_urls(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(9001, None), (9002, "no scheme"), (9003, ""), (9004, "x://EXAMPLE.org"), (9005, "x://a.Example.ORG/es/1?x#y"), (9006, "x://com/fr/"), (9007, "x://notcom/fr/"), (9008, "a://b://c/d"), (9009, "http://h?/q"), (9005, "x://example.org/en/15")], "page_id long, url string")
    df = pages.unionByName(extra).withColumn("host", F.lit("clash"))
    urls = df.select("page_id", "url").collect()
    got = urlfilter.judge(df, Q.RULES).collect()
    assert len(got) == len(urls)
    want = set()
    for r in urls:
        host, path = brute_url(r["url"])
        fits = [x for x in Q.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        want.add((r["page_id"], host, path, best.name if best else None, best.verdict if best else None))
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got} == want
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    # the trees learn what the labels' features tell
    ruled = [r for r in got if r["rule"]]
    assert sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in ruled) / len(ruled) > 0.85


def test_url_rates_out_of_fold(spark):
    """A URL's own verdict, and its copies', are not in the rates that the trees learn from."""
    rng = random.Random(8)
    urls = [f"x://h{rng.randrange(6)}.{rng.choice(['a', 'b', 'c'])}:80/{k}" for k in range(200)]
    rows = [(u, float(rng.random() < 0.4)) for u in urls for _ in range(rng.randrange(1, 3))]
    rows = [(u, dict(rows)[u]) for u, _ in rows]
    covered = spark.createDataFrame(rows, "url string, label double").withColumns({"host": urlfilter.parts(F.col("url"))[0], "fold": urlfilter.fold_of(F.col("url"))})
    counted = urlfilter.named(covered).groupBy("suffix", "domain", "fold").agg(F.count("label").alias("n"), F.sum("label").alias("blocked"))
    params = urlfilter.UrlParams()
    got = urlfilter.other_folds(counted, urlfilter.named(covered).dropDuplicates(["url"]), "domain", "rate", 0.25, params).collect()
    fold = {r["url"]: r["fold"] for r in got}
    assert len(got) == len(set(urls)) and len(set(fold.values())) == urlfilter.FOLDS and {r["suffix"] for r in got} == {"a", "b", "c"}
    for r in got:
        others = [y for u, y in rows if u.split("/")[2].split(":")[0] == r["domain"] and fold[u] != r["fold"]]
        assert math.isclose(r["rate"], (sum(others) + 4 * 0.25) / (len(others) + 4))


def test_url_cases(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty, Q.RULES).count() == 0
    one = spark.createDataFrame([(1, "x://a.com/de/"), (2, "x://z")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(one, Q.RULES).collect()} == {1: "block", 2: "block"}
    assert {r["verdict"] for r in urlfilter.judge(one, []).collect()} == {"allow"}


def test_url_statistics_cover_all_rows(spark):
    rules = [urlfilter.Rule("org", "/a/", "allow"), urlfilter.Rule("org", "/b/", "block")]
    bad = lambda i: zlib.crc32(b"%d" % i) % 2
    rows = [(f"x://n{i:04d}.org/{'ab'[bad(i)]}/{k}",) for i in range(1500) for k in range(4)] + [(f"x://n{i:04d}.org/c/1",) for i in range(1500)]
    pages = spark.createDataFrame(rows, "url string").withColumn("page_id", F.monotonically_increasing_id())
    got = {}
    for name, params in (("broadcast", urlfilter.UrlParams()), ("joined", urlfilter.UrlParams(broadcast_bytes=0)), ("sampled", urlfilter.UrlParams(sample=400))):
        got[name] = sorted((r["page_id"], r["host"], r["verdict"], round(r["score"], 9)) for r in urlfilter.judge(pages, rules, params).where("rule IS NULL").collect())
        assert sum((v == "block") == bad(int(h[1:5])) for _, h, v, _ in got[name]) > 1490
    assert got["broadcast"] == got["joined"] and len(got["joined"]) == 1500
    # a rare verdict beside a hot URL that a sample of rows would hold alone
    hot = spark.range(500).select(F.concat(F.lit("x://hot.org/a/"), "id").alias("url")).orderBy(F.xxhash64("url")).first()["url"]
    rare = [(hot,)] * 3000 + [(f"x://bad.org/b/{k}",) for k in range(8)] + [("x://bad.org/c/1",), ("x://hot.org/c/1",), (None,)]
    few = spark.createDataFrame(rare, "url string").withColumn("page_id", F.monotonically_increasing_id())
    scores = {r["host"]: r["score"] for r in urlfilter.judge(few, rules, urlfilter.UrlParams(sample=6)).where("rule IS NULL").collect()}
    assert scores["bad.org"] > 0.5


# 9 tokens


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_spliced_counts(name, texts):
    counter = tokencount.load(Q.tokenizer_path(name))
    long = sorted(texts.values(), key=len)[-12:] + ["a" * 3000 + " b" * 20 + "é" * 2000 + "   " * 900, " " * 5000, "日本" * 2500, "x\n" * 3000, "", "<s> </s> <unk> ▁▁ <|endoftext|> " * 60]
    whole = (lambda t: len(counter.model.encode(t))) if name.endswith(".model") else (lambda t: len(counter.model.encode(t, add_special_tokens=False).ids))
    for chunk, overlap in ((300, 16), (1000, 64), (4000, 256)):
        for t in long:
            assert tokencount.count_spliced(t, counter, tokencount.TokenParams(chunk=chunk, overlap=overlap)) == whole(t)


def test_production_windows_are_spliced(texts):
    counter = tokencount.load(Q.tokenizer_path("piece_bpe_32k.model"))
    params, made = tokencount.TokenParams(), []
    real = counter.starts
    counter.starts = lambda data, begin, end: made.append((begin, end)) or real(data, begin, end)
    long = [t for t in texts.values() if len(t.encode()) > params.chunk]
    assert long and all(tokencount.count_spliced(t, counter, params) == len(counter.model.encode(t)) for t in long)
    assert len(made) > len(long) and max(b - a for a, b in made) <= params.chunk
    huge = " ".join(texts.values()) * 4
    huge = (huge * (5_000_000 // len(huge) + 1))[:5_000_000]
    assert tokencount.count_spliced(huge, counter, params) == len(counter.model.encode(huge))


def test_unproven_models_are_not_spliced():
    """A normaliser that changes lengths: windows are given up and the text is encoded whole."""

    class Folding(tokencount.SentencePieceCounter):
        def starts(self, data, begin, end):
            return super().starts(data, begin, end) if b"  " not in data[begin:end] else None

    counter = Folding(Q.tokenizer_path("piece_bpe_32k.model"))
    text = "some words of text " * 500 + "  " + "more words here " * 500
    assert tokencount.count_spliced(text, counter, tokencount.TokenParams()) == len(counter.model.encode(text))
    counter.provable = False
    assert tokencount.count_spliced(text, counter, tokencount.TokenParams()) == len(counter.model.encode(text))


def test_token_table(odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_path("piece_bpe_32k.model"))
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.count_tokens(odd, Q.tokenizer_path("piece_bpe_32k.model")).collect())
    want = sorted((d[0] or 0, len((d[1] or "").encode()), n := len(sp.encode(d[1] or "")), n > 4096) for d in ODD)
    assert got == want


# 10 mixing


def mix_oracle(df, params):
    import duckdb

    con = duckdb.connect()
    documents = df.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con.register("documents", documents)
    return sorted(map(repr, con.sql(mixing.oracle(params)).fetchall()))


@pytest.mark.parametrize("block,grid", [(2000, 4096), (3, 4), (1, 2)])
def test_mixture(spark, docs, odd, block, grid):
    params = mixing.MixParams(block=block, grid=grid)
    for df in (docs, odd, docs.limit(1), docs.where("doc_id < 40").withColumn("source", F.lit("one")).withColumn("size", F.lit(1))):
        got = mixing.mix(df, params)
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        rows = got.collect()
        assert sorted(repr((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in rows) == mix_oracle(df, params)
        assert all(r["taken"] <= 2 * r["size"] for r in rows)


def test_mixture_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        x = by.setdefault(r["source"], [r["target"], 0, r["source_size"], 0])
        x[1], x[3] = x[1] + r["taken"], max(x[3], r["size"])
    assert math.isclose(sum(x[0] for x in by.values()), 1.5 * total) and all(abs(t - taken) <= biggest / 2 + 1 and t <= 2 * size for t, taken, size, biggest in by.values())


def test_mixture_rows(spark, odd):
    wide = odd.withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    taken = {}
    for r in mixing.mix(odd).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + (r["taken"] // r["size"] if r["size"] else 0)
    got = mixing.repeat_rows(wide)
    assert got.columns == wide.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({k: v for k, v in taken.items() if v})
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.repeat_rows(odd.limit(0)).count() == 0
