"""Operator 11 against a brute-force trie, with buckets that recurse and buckets that don't."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from leafmill.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, seq string, depth long, bucket string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    least = {p: min(m) for p, m in members.items()}
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, p in built.items():
        ends[p].append(c)
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def found(spark, rows, params=T.TrieParams()):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in T.trie(df, params).collect())


def made(seed, n, alphabet, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        shared = rng.random() < 0.4
        for t in range(rng.randint(0, longest) if not shared else longest):
            rows.append((c * rng.choice([1, 1, 3]), t, "user", f"hot {t}") if shared and t < 6 else (c, t, rng.choice(["user", "a"]), rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize("params", [T.TrieParams(), T.TrieParams(rows=3, size=64, chunk=4), T.TrieParams(rows=1, size=1, chunk=1)])
def test_random(spark, params):
    rows = made(1, 150, ["", "a", "b", "é", "日本"], 12)
    got = found(spark, rows, params)
    assert got == brute(rows) and len(got) > 300


def test_hot_and_odd(spark):
    rows = [(c, t, "system", "same") for c in range(5, 600, 5) for t in range(12)]  # one conversation of many
    rows += [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "", ""), (7, 1, None, "x"), (8, 3, "u", "tie"), (8, 3, "v", "tie"), (8, 3, "u", "tie"), (-3, 0, "u", "z" * 70_000), (2, 0, "u:1", "a"), (3, 0, "u", ":1a"), (10**15 + 4, 1, "u", "far")]
    for params in (T.TrieParams(), T.TrieParams(rows=2, size=100, chunk=16)):
        assert found(spark, rows, params) == brute([r for r in rows])


def test_long_conversation(spark):
    rows = [(1, t, "u", str(t % 3)) for t in range(90)] + [(6, t, "u", str(t % 3)) for t in range(60)] + [(11, 0, "u", "x")]
    assert found(spark, rows, T.TrieParams(rows=1)) == brute(rows)
    got = found(spark, [(1, t, "u", "ab") for t in range(20_000)] + [(6, t, "u", "ab") for t in range(19_000)])
    lost = [zlib.crc32(c) % 9 for c in (b"1", b"6")]
    assert len(got) == 20_001 - lost[0] and got[0][6] == 2 * (19_000 - lost[1])


def test_empty(spark):
    assert found(spark, []) == [] == found(spark, [(None, 1, "u", "t")])
    only = [(4, 0, "u", "x")]  # turns before h are lost where the group's first conversation is absent
    assert found(spark, only) == brute(only)


def test_same_rows_whatever_the_buckets(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    a, b = (sorted(map(tuple, T.trie(df, p).collect()), key=repr) for p in (T.TrieParams(), T.TrieParams(rows=5)))
    assert a == b
