"""Short sketches, many detections, broken image headers, and whole queries against plain versions."""

import math
import random
import struct
import time

import numpy as np
import pytest
import xxhash

from leafmill.llm import licenses, media, sketch

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain_sketch(text, scale=8):
    """The retained hashes of a text, by XXH64 (seed 42, longs chained) word by word."""
    words, now = [], ""
    for c in text.lower():
        if (c.isascii() and c.isalnum()) or not c.isascii():
            now += c
        elif now:
            words.append(now)
            now = ""
    words += [now] if now else []
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]

    def chain(values):
        out = 42
        for v in values:
            out = xxhash.xxh64(struct.pack("<Q", v), seed=out).intdigest()
        return signed(out)

    every = {chain(h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {chain(h)} if h else {signed(xxhash.xxh64(text.encode(), seed=42).intdigest())}
    limit = -(1 << 63) + (1 << 64) // scale
    return every, sorted(x for x in every if x < limit) or [min(every)]


def texts():
    rng = random.Random(8)
    words = ["the", "Sea", "über", "rock", "42", "日本", "x"]
    out = ["", "...", "one two", "a b c d e"]
    out += [" ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    return out + ["very long " * 20_000]


def test_sketches_by_hand(spark):
    every = texts()
    got = {r["doc_id"]: r for r in sketch.fingerprints(spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(every)], "doc_id long, text string, sketch string, near_next string")).collect()}
    limit = -(1 << 63) + (1 << 64) // 8
    for i, t in enumerate(every):
        following = every[(i + 1) % len(every)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        mine, low = plain_sketch(t)
        assert got[i]["fingerprint"] == f"{len(low)}:" + "".join(f"{x & MASK:016x}" for x in low)
        assert got[i]["edited_fingerprint"].split(":")[0] == str(len(plain_sketch(edited)[1]))
        for name, other in (("near_next", following), ("near_edited", edited)):
            a, b = (set(low), set(plain_sketch(other)[1])) if low[0] < limit else (mine, plain_sketch(other)[0])
            assert math.isclose(got[i][name], len(a & b) / len(a))


def test_short_texts_within_the_next(spark):
    rows = []
    for i in range(100):
        words = [f"w{i}x{k}" for k in range(40)]
        rows += [(2 * i, " ".join(words[10:18])), (2 * i + 1, " ".join(words))]
    got = sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["near_next"] for r in got if r["doc_id"] % 2 == 0} == {1.0}


def test_many_detections_in_seconds():
    rng = random.Random(1)
    found = []
    for i in range(100_000):
        start = rng.randint(0, 2_000_000)
        found.append(licenses.Detection(start, start + rng.randint(5, 60), rng.choice([40, 48, 50, 60]), i, "x"))
    began = time.time()
    kept = licenses.settle(found)
    assert time.time() - began < 20 and 1000 < len(kept) < len(found)


def bitmaps():
    pal = b"".join(bytes([i, i, i, 0]) for i in range(4))
    head = lambda bits, packed, extra, w=3, h=2: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + extra) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packed, 0, 0, 0, 4 if bits == 8 else 0, 0)
    return [head(24, 0, 0) + bytes(range(24)), head(8, 0, 16) + pal + bytes([0, 1, 2, 0, 3, 1, 0, 0]), head(32, 3, 12) + struct.pack("<III", 0xFF0000, 0xFF00, 0xFF) + bytes(range(24))]


@pytest.mark.parametrize("which", [0, 1, 2])
def test_broken_bitmaps_are_refused(which):
    data = bitmaps()[which]
    assert media.decode(data).shape[:2] == (2, 3)
    rng = random.Random(which)
    for _ in range(4000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 3)):
            bad[rng.randrange(len(bad))] = rng.choice([0, 1, 255, rng.randrange(256)])
        try:
            out = media.decode(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])]))
        except media.MediaError:
            continue
        assert isinstance(out, np.ndarray)


def test_a_mapped_step_has_its_own_limit(spark):
    from leafmill.llm._batches import map_rows

    def make():
        return lambda part: {"n": [part.num_rows], "size": [sum(len(t) for t in part.column("text").to_pylist())]}

    texts = spark.createDataFrame([("x" * 400,) for _ in range(9)] + [("y" * 5000,)], "text string").coalesce(1)
    rows = map_rows(texts, "text", "n int, size int", make, 1000).collect()
    assert sum(r["n"] for r in rows) == 10 and all(r["size"] <= 1000 or r["n"] == 1 for r in rows)
