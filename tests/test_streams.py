"""Streams equal their batch forms, and what they keep goes; imports with cancels, attempts and a byte bound; stored versions."""

import pytest
from test_assembly import PROSE, package

from leafmill import schemas as S
from leafmill.operators import repository as R
from leafmill.sources import epub
from leafmill.streaming import jobs


def fed(spark, tmp_path, parts, schema, run):
    """Rows of a query over a stream that takes one part after another, and the state rows after each."""
    folder = tmp_path / "events"
    folder.mkdir()
    name = f"out_{abs(hash(str(tmp_path)))}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = run(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    kept = []
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"w{i}"))
            file = next((tmp_path / f"w{i}").glob("part*"))
            file.rename(folder / f"{i}.json")
            query.processAllAvailable()
            kept.append(sum(s.numRowsTotal for s in query.lastProgress.stateOperators))
        rows = [tuple(r) for r in spark.table(name).collect()]
    finally:
        query.stop()
    return rows, kept


RULES = "key string, ms long, seq long, value string"


def test_rule_persistence(spark, tmp_path):
    parts = [
        [("a", 1000, 1, "1"), ("a", 1050, 2, "2"), ("b", 1000, 3, "x")],
        [("a", 1170, 4, "3"), ("a", 1291, 5, "4"), ("b", 5000, 6, "y"), ("b", 5000, 7, "z")],  # 120 ms after the last change, and 121
        [("end", 200_000, 8, "w")],  # the watermark passes all timers
        [("end", 400_000, 9, "w")],
    ]
    got, kept = fed(spark, tmp_path, parts, RULES, lambda s: jobs.rule_persist_debounce(s, watermark="1 second"))
    batch = [tuple(r) for r in jobs.rule_persist_batch(spark.createDataFrame([r for p in parts for r in p], RULES)).collect()]
    assert sorted(got) == sorted(r for r in batch if r[1] < 300_000)
    assert sorted(got) == [("a", 1290, 4, "3"), ("a", 1411, 5, "4"), ("b", 1120, 3, "x"), ("b", 5120, 7, "z"), ("end", 200_120, 8, "w")]
    assert kept[0] > 0 and kept[-1] <= 1  # the last key alone


SCROLL = "key string, ms long, seq long, top double"


def test_idle_readers_leave_no_state(spark, tmp_path):
    parts = [
        [("a", 10_000, 1, 0.0), ("a", 10_050, 2, 30.0), ("b", 10_000, 3, 0.0)],
        [("a", 10_100, 4, 60.0), ("b", 10_040, 5, 10.0)],
        [("a", 15_000, 6, 90.0), ("a", 15_050, 7, 140.0), ("c", 90_000, 8, 0.0)],  # idle: begins anew
        [("d", 900_000, 9, 0.0)],
        [("d", 1_900_000, 10, 1.0)],
    ]
    got, kept = fed(spark, tmp_path, parts, SCROLL, lambda s: jobs.scroll_intents(s, idle_ms=2_000, watermark="1 second"))
    batch = [tuple(r) for r in jobs.scroll_intents_batch(spark.createDataFrame([r for p in parts for r in p], SCROLL), idle_ms=2_000).collect()]
    assert sorted(got) == sorted(batch) == [("a", 10_100, 4, "forward")]
    assert kept[1] == 2 and kept[-1] <= 1  # a and b; in the end the last reader alone


def test_imports(spark, tmp_path):
    source, cancels = tmp_path / "in", tmp_path / "cancels"
    good = package([("d.xhtml", True, f"<p>{PROSE}</p>")])

    def put(folder, name, data):
        (source / folder).mkdir(parents=True, exist_ok=True)
        (source / folder / name).write_bytes(data)

    def run(size=1024):
        q = jobs.import_queue(spark, str(source), str(tmp_path / "jobs"), str(tmp_path / "content"), str(tmp_path / "cp"), epub.read_epubs, size, str(cancels))
        q.awaitTermination(120)
        return q, sorted((r["book_id"], r["attempt"], r["status"]) for r in spark.read.parquet(str(tmp_path / "jobs")).collect())

    put("1", "a.epub", good)
    put("1", "b.epub", b"PK")
    put("1", "c.epub", good)
    spark.createDataFrame([("c.epub", None)], "book_id string, attempt int").write.parquet(str(cancels / "1"))
    cancels_here = "book_id string, attempt int"
    for part in (cancels / "1").glob("part*"):
        part.rename(cancels / part.name)
    q, got = run()
    assert got == [("a.epub", 1, "completed"), ("b.epub", 1, "failed"), ("c.epub", 1, "canceled")]
    assert sum(p.numInputRows > 0 for p in q.recentProgress) >= 2  # a kilobyte admits about one book at a time
    put("2", "b.epub", good)  # again, whole this time
    put("2", "a.epub", good)
    spark.createDataFrame([("a.epub", 2)], cancels_here).coalesce(1).write.parquet(str(tmp_path / "more"))
    for part in (tmp_path / "more").glob("part*"):
        part.rename(cancels / f"2-{part.name}")
    _, got = run(64 << 20)
    assert got == [("a.epub", 1, "completed"), ("a.epub", 2, "canceled"), ("b.epub", 1, "failed"), ("b.epub", 2, "completed"), ("c.epub", 1, "canceled")]
    content = {(r["book_id"], r["attempt"]) for r in spark.read.parquet(str(tmp_path / "content")).where("kind = 'paragraph'").collect()}
    assert content == {("a.epub", 1), ("b.epub", 2)}
    put("3", "d.epub", good)
    spark.createDataFrame([(None, None)], cancels_here).coalesce(1).write.parquet(str(tmp_path / "stop"))
    for part in (tmp_path / "stop").glob("part*"):
        part.rename(cancels / f"3-{part.name}")
    assert ("d.epub", 1, "canceled") in run()[1]


@pytest.fixture
def tables(spark):
    made = {n: spark.createDataFrame([], schema) for n, schema in S.TABLES.items()}
    made["books"] = spark.createDataFrame([{"id": "b", "title": "T"}], S.TABLES["books"])
    made["import_jobs"] = spark.createDataFrame([{"book_id": "b", "attempt": 2, "status": "completed"}], S.TABLES["import_jobs"])
    return made


def test_old_snapshots_are_lifted(spark, tables, tmp_path):
    new = str(tmp_path / "new")
    R.write_snapshot(tables, new)
    back = R.read_snapshot(spark, new)
    assert {n: df.collect() for n, df in back.items()} == {n: df.collect() for n, df in tables.items()}
    # version 1: no images, no warnings, jobs without attempts, and a pointer that names no version
    old = tmp_path / "old"
    for name, df in tables.items():
        if name != "book_images":
            df.drop(*{"books": ["processing_warnings"], "import_jobs": ["attempt"]}.get(name, [])).write.parquet(str(old / "v" / name))
    spark.createDataFrame([("v",)], "version string").coalesce(1).write.parquet(str(old / "current"))
    lifted = R.read_snapshot(spark, str(old))
    assert set(lifted) == set(S.TABLES) and all([f.name for f in lifted[n].schema] == [f.name for f in df.schema] for n, df in tables.items())
    assert lifted["books"].first()["processing_warnings"] is None and lifted["import_jobs"].first()["attempt"] == 1 and lifted["book_images"].count() == 0


def test_newer_snapshots_are_refused(spark, tables, tmp_path):
    R.write_snapshot(tables, str(tmp_path / "s"))
    spark.createDataFrame([("x", R.VERSION + 1, "")], "version string, schema int, tables string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "s" / "current"))
    with pytest.raises(ValueError, match="version 5"):
        R.read_snapshot(spark, str(tmp_path / "s"))
