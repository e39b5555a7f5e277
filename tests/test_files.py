"""Folder scans, rows in batches, stored rules: fixed cases."""

from pyspark.sql import functions as F

from leafmill.operators import rules as R
from leafmill.sources import files


def test_scan_takes_the_first_paths(spark, tmp_path):
    for name in ("c.epub", "a.pdf", "b.txt", "sub/d.epub", "sub/a.epub", "z.PDF"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {(r["name"], bytes(r["content"]).decode()) for r in files.scan(spark, str(tmp_path), limit=3).collect()}
    assert got == {("a.pdf", "a.pdf"), ("c.epub", "c.epub"), ("a.epub", "sub/a.epub")}
    assert files.scan(spark, str(tmp_path), limit=None).count() == 5 and files.scan(spark, str(tmp_path), "*.pdf").count() == 1


def test_rows_of_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(40)], "n long").coalesce(1)

    def rows(r):
        if r["n"] == 7:
            raise ValueError("seven")
        return [{"n": r["n"], "k": k} for k in range(r["n"] * 10)]

    got = files.flat_map(df, "n long, k long", rows, lambda r, e: {"n": r["n"], "k": -1}).groupBy("n").agg(F.count("*").alias("c"), F.min("k").alias("k")).collect()
    assert {r["n"]: (r["c"], r["k"]) for r in got} == {n: (1, -1) if n == 7 else (n * 10, 0) for n in range(1, 40)}
    assert files.flat_map(df.limit(0), "n long, k long", rows).count() == 0


def test_stored_rules(spark):
    raw = [("b", 1, "a", r"\bMr\.\b", "Mister", "simple", True, True), ("b", 2, "b", r" [^\w]*St\-[^\w]* ", "Saint", "simple", True, False), ("b", 3, " ", "x", "y", "regex", True, True), ("b", 4, "d", "x" * 201, "y", "regex", True, True), ("b", 5, "e", "x", None, "regex", True, True), ("b", 6, "f", "x", "y", "odd", None, True), (" ", 7, "g", "x", "y", "regex", True, True), (None, 8, "h", "x", "y", "odd", True, True)]
    raw += [("many", i, f"m{i}", "x", "y", "regex", True, True) for i in range(400)]
    df = spark.createDataFrame(raw, "scope string, pos int, id string, pattern string, replacement string, source string, enabled boolean, case_insensitive boolean")
    got = R.sanitized(df)
    assert {(r["scope"], r["id"], r["pattern"], r["source"]) for r in got.where("scope IS NULL OR scope <> 'many'").collect()} == {("b", "a", r"\bMr\b", "simple"), ("b", "b", r"\bSt\b", "simple"), (None, "h", "x", "regex")}
    assert sorted(r["pos"] for r in got.where("scope = 'many'").collect()) == list(range(300))
    left = R.without_scopes(got, spark.createDataFrame([("many",)], "scope string")).collect()
    assert {r["scope"] for r in left} == {"b", None}
