"""The corpus pipeline: each stage's decisions against brute force on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from leafmill.llm import langid, mixing, probminhash, quality
from leafmill.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        assert i == 4 or kept[-1].columns == columns
    rows = [[tuple(r) for r in k.select("doc_id", "text").collect()] for k in kept[:5]]

    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = quality.score_texts(model, [t.encode() for _, t in rows[0]])
    assert sorted(rows[1]) == sorted(r for r, s in zip(rows[0], scores) if s >= 0.3) and len(rows[1]) < len(rows[0])

    ranker = langid.Ranker(langid.fit(docs))
    assert sorted(rows[2]) == sorted(r for r in rows[1] if ranker.predict(r[1])[0] != "und")

    classes = {r["doc_id"]: r["class_id"] for r in probminhash.near_classes(kept[2]).collect()}
    assert sorted(i for i, _ in rows[3]) == sorted(set(classes.values()))

    repeats = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(kept[3]).collect() if r["size"]}
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, n in repeats.items() for _ in range(n))

    out = kept[5].select("doc_id", "round_trip", F.size("ids").alias("n")).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in rows[4]) and all(r["round_trip"] and r["n"] for r in out)
    assert tokenizer_path("piece_bpe_32k.model").endswith(".model")


def test_empty_and_nulls(spark, sf):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words of text in here", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf).count() <= 2 * df.count()
