"""Operator 12: base spans against plain patterns, positions, trees as an expression, thresholds, overlaps, odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.llm import pii as P
from leafmill.llm import queries as Q

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, spans string, email string"


def luhn(d):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def base(text):
    out = sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0]))
    return [(list(PLAIN)[k], s, e) for s, k, e in out]


def check(rows, texts):
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN], (r, want)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), (r, want)
        every = [x.split(":") for x in r["spans"].split(",") if x]
        assert [(k, int(s), int(e)) for k, s, e in every if k in PLAIN] == want
        taken = [(int(s), int(e)) for k, s, e in every if k in PLAIN]
        for k, s, e in every:
            assert k in PLAIN or all(int(e) <= a or b <= int(s) for a, b in taken)


@pytest.fixture(scope="module")
def model(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans_on_random_text(spark, model):
    rng = random.Random(12)
    bits = ["a", "b.c", "@", "@x.yz", "_q", ".", "..", "1", "25", "256", "4111111111111111", "5500 0000 0000 0004", "378282246310005", "-", " ", "  ", "+1 (017) 555-7713", "+", "(", ")", "é", "😀", "\n", "10.0.0.7", "001.02.3.4", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "x@", "9"]
    texts = {i: "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for i in range(1500)}
    docs = spark.createDataFrame([(i, t, None, "", 0, 1, "clash", "clash") for i, t in texts.items()], DOCS)
    got = P.find(docs, model).collect()
    assert len(got) == len(texts)
    check(got, texts)


def test_on_the_table(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = Q.op12_personal_data(spark, "/root/testdata/sf0.01").collect()
    check(got, texts)
    secrets = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in got for x in r["spans"].split(",") if x.startswith("secret")}
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
    assert planted and secrets == planted
    assert not any(x.startswith("number") and not valid("card", texts[r["doc_id"]][int(x.split(":")[1]) : int(x.split(":")[2])]) for r in got for x in r["spans"].split(",") if x and re.fullmatch("[0-9]{14,19}", texts[r["doc_id"]][int(x.split(":")[1]) : int(x.split(":")[2])]))


def test_odd_rows(spark, model):
    long = "x" * 3_000 + "@" + "y" * 3_000 + " " + "1" * 3_000 + " a@b" + ".c" * 30_000 + " " + "1 " * 50_000 + "+1" + " " * 60_000 + " 10.1.2.3"
    many = "10.0.0.7 a@b.co " * 8_000
    texts = {1: None, 2: "", 3: long, 4: many, 5: "a@b.co", 6: "+" * 50_000}
    docs = spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in [*texts.items(), (5, "a@b.co")]], DOCS)
    got = P.find(docs, model).collect()
    assert len(got) == 7
    check(got, texts)
    huge = ["x" * 2_000_000 + "@" + "y" * 2_000_000, "1" * 2_000_000, "." * 500_000 + "1." * 500_000, "(" * 1_000_000, "+1" * 500_000, "10.0.0.7 " * 100_000]  # backtracking or squares would take hours
    found = P.find(spark.createDataFrame(list(enumerate(huge)), "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found} == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 125_000, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 100_000, 0, 0)}
    null = P.find(spark.createDataFrame([(None, "a@b.co")], "doc_id long, text string"), model).collect()
    assert null[0]["doc_id"] is None and null[0]["n_email"] == 1
    assert P.find(docs.limit(0)).count() == 0 and P.fit(docs.limit(0)) == P.Model()


def test_trees_as_expression(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(3)
    rows = [([rng.random() for _ in range(4)],) for _ in range(400)]
    df = spark.createDataFrame(rows, "x array<double>").withColumn("label", ((F.get("x", F.lit(0)) > 0.4) != (F.get("x", F.lit(2)) > 0.7)).cast("double")).withColumn("v", array_to_vector("x"))
    learned = GBTClassifier(maxIter=5, maxDepth=3, seed=1, featuresCol="v").fit(df)
    model = P.Model(tuple(P.tree_of(t.toDebugString) for t in learned.trees), tuple(learned.treeWeights))
    got = learned.transform(df).select(vector_to_array("probability")[1].alias("a"), P.probability(F.col("x"), model).alias("b")).collect()
    assert max(abs(r["a"] - r["b"]) for r in got) < 1e-12


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 70_000])
def test_running(spark, n):
    values = [(i * 7919) % 1001 - 300 for i in range(n)]
    r = spark.createDataFrame([(values,)], "v array<bigint>").select(P.running(F.col("v"), lambda a, b: a + b).alias("s"), P.running(F.col("v"), F.greatest).alias("m")).first()
    sums, most, s, m = [], [], 0, -(10**9)
    for v in values:
        s, m = s + v, max(m, v)
        sums.append(s)
        most.append(m)
    assert r["s"] == sums and r["m"] == most


def test_overlaps(spark):
    rng = random.Random(5)
    spans = lambda n: [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(n))]
    rows = [(i, spans(rng.randint(0, 6)), spans(rng.randint(0, 6))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, c array<struct<start:bigint,end:bigint>>, w array<struct<start:bigint,end:bigint>>")
    for r in df.select("i", P.clear_of(F.col("c"), F.col("w")).alias("k")).collect():
        _, c, w = rows[r["i"]]
        assert sorted(map(tuple, r["k"])) == sorted(x for x in c if all(x[1] <= a or b <= x[0] for a, b in w))


def test_redact(spark, model):
    texts = ["😀 mail a.b@c.de, or 10.0.0.7!", "nothing here", "a@b.co", None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "+1 (017) 555-7713, 10.0.0.1 +1 23 10.0.0.1"]
    got = {r["doc_id"]: r["text"] for r in P.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got == {0: "😀 mail [email], or [ip]!", 1: "nothing here", 2: "[email]", 3: "", 4: 'token = "[secret]" end', 5: "[phone], [ip] +1 23 [ip]"}


def test_trees_learn_from_all_texts(spark):
    # 21,000 texts without candidates and a few with: a sample of 20,000 would hold only some of these
    plain = spark.range(21_000).select(F.concat(F.lit("text "), F.col("id").cast("string").substr(1, 4)).alias("text"))
    some = spark.range(600).select(F.concat(F.lit("token = \""), F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 40), F.lit("\" and the abcdefghijklmnopq")).alias("text"))
    rows = P.marked_candidates(plain.unionAll(some)).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r["kind"], r["label"]): r["n"] for r in rows} == {("secret", 1.0): 600, ("secret", 0.0): 600}
