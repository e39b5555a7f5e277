"""Repository, layout, validation and sources on small fixed inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill import schemas as S
from leafmill.operators import evaluate as E
from leafmill.operators import geometry as G
from leafmill.operators import layout as L
from leafmill.operators import repository as R
from leafmill.operators import validate as V
from leafmill.sources import epub, files, html
from leafmill.streaming import jobs


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def tree(spark):
    folders = spark.createDataFrame([("classics", "Classics", None, 0, 0), ("russian", "Russian", "classics", 0, 1), ("tolstoy", " ", "russian", 2, 2), ("empty", "Empty", None, 1, 3), ("orphan", "O", "gone", 0, 4), ("russian", "dup", None, 0, 5)], "id string, label string, parent_id string, ord int, pos int")
    placements = spark.createDataFrame([("anna", "tolstoy", 0, 0), ("war", "tolstoy", 1, 1), ("crime", "russian", 0, 2), ("dune", None, 0, 3), ("lost", "nowhere", 0, 4), ("anna", "empty", 0, 5)], "book_id string, parent_id string, ord int, pos int")
    f = L.repaired(folders)
    return f, L.placed(placements, f)


def test_repair(tree):
    f = {r["id"]: (r["label"], r["parent_id"]) for r in tree[0].collect()}
    assert f["tolstoy"] == ("Untitled folder", "russian") and f["orphan"][1] is None and f["russian"] == ("Russian", "classics")
    p = {r["book_id"]: r["parent_id"] for r in tree[1].collect()}
    assert p == {"anna": "tolstoy", "war": "tolstoy", "crime": "russian", "dune": None, "lost": None}


def test_tree(tree, spark):
    f, p = tree
    assert ids(L.descendants(f, "classics")) == ["classics", "russian", "tolstoy"]
    assert {r["id"]: r["books"] for r in L.subtree_counts(f, p).collect()} == {"classics": 3, "russian": 3, "tolstoy": 2, "empty": 0, "orphan": 0}
    assert ids(L.pruned(f, p, f.select("id"))) == ["classics", "russian", "tolstoy"]
    sel = spark.createDataFrame([("anna",), ("war",)], "book_id string")
    state = {r["id"]: (r["checked"], r["partial"]) for r in L.cascade(f, p, sel, f.where("id = 'empty'").select("id")).collect()}
    assert state["tolstoy"] == (True, False) and state["russian"] == (False, True) and state["empty"] == (True, False) and state["orphan"] == (False, False)
    moved = {r["id"]: r["parent_id"] for r in L.move_folder(f, "classics", "tolstoy").collect()}
    assert moved["classics"] is None  # a folder never moves into itself
    assert {r["id"]: r["parent_id"] for r in L.move_folder(f, "tolstoy", None).collect()}["tolstoy"] is None
    folders, books = L.delete_folder_only(f, p, "russian")
    assert {r["id"]: r["parent_id"] for r in folders.collect()}["tolstoy"] == "classics" and {r["book_id"]: r["parent_id"] for r in books.collect()}["crime"] == "classics"
    loop = spark.createDataFrame([("a", "A", "b", 0), ("b", "B", "a", 0), ("c", "C", None, 0)], "id string, label string, parent_id string, ord int")
    assert ids(L.cyclic(loop)) == ["a", "b"]


def test_repository(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 20, 2), (2, "c", 30, 3)], "id int, title string, created_at int, seq int")
    assert {tuple(r) for r in R.upserted(log, ["id"], ["seq"], ["created_at"]).collect()} == {(1, "b", 10, 2), (2, "c", 30, 3)}
    chunks = spark.createDataFrame([("b", 0, '[{"id":1,"text":"x"},{"id":null,"text":"y"}]'), ("b", 1, "broken")], S.TABLES["book_chunks"])
    assert [(r["paragraph_id"], r["text"]) for r in R.chunk_paragraph_rows(chunks).collect()] == [(1, "x")]
    tables = {k: spark.createDataFrame([], v) for k, v in S.TABLES.items()} | {"book_chunks": chunks}
    R.write_snapshot(tables, str(tmp_path / "s"))
    back = R.read_snapshot(spark, str(tmp_path / "s"))
    assert set(back) == set(S.TABLES) and back["book_chunks"].count() == 2
    with pytest.raises(Exception, match="required value"):
        R.required(spark.createDataFrame([(None,)], "x string"), "x").collect()


def test_validation(spark):
    good = " ".join(f"word{i} goes here now" for i in range(40))
    docs = spark.createDataFrame([(1, good + "\n" + good), (2, "short"), (3, "\n".join(["w " * 1200, "x"])), (4, None), (5, good + "\n* * *\n" + good), (6, good + "�" * 30)], "doc_id int, text string")
    got = {}
    for r in V.text_diagnostics(V.text_facts(docs)).collect():
        got.setdefault(r["doc_id"], []).append((r["code"], r["severity"]))
    assert 1 not in got and got[2] == [("unusable_text", "failure")] and ("collapsed_paragraphs", "failure") in got[3] and got[4] == [("unusable_text", "failure")]
    assert got[5] == [("ornament_junk", "warning")] and got[6] == [("garbled_text", "failure")]
    verdict = {r["doc_id"]: r["pass"] for r in V.verdicts(docs, V.text_diagnostics(V.text_facts(docs))).collect()}
    assert verdict == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_classification(spark):
    d = spark.createDataFrame([(1, 0, V.IMAGES, "failure", None, "m"), (1, 1, V.TEXT, "failure", "garbled_text", "m"), (1, 2, V.IMAGES, "failure", "images_undeclared", "m"), (1, 3, V.COVER, "warning", "cover_missing", "m"), (1, 4, V.TIME, "failure", None, "m"), (1, 5, V.TEXT, "failure", "unusable_text", "m")], "doc_id int, pos int, bucket string, severity string, code string, message string")
    got = V.classify(d).first()
    assert got["warnings"] == "images_missing,garbled_text,cover_missing" and got["hard_code"] == "timeout"


def test_scope(spark):
    one = lambda *v: spark.createDataFrame([v], "w int, c int, t int, n int").select(E.pdf_scope(*map(F.col, "wctn"))).first()[0]
    assert one(384, 384, 1, 275) == "out-of-scope" and one(384, 1832, 9, 10) == "in-scope" and one(10, 1832, 9, 10) == "out-of-scope"


PAGE = """<html><head><title>x</title></head><body><nav hidden>menu</nav><h1 id="t">The Title</h1><p>First one two three four five six<br>seven eight nine ten.</p>
<hr/><p>Second one two three four five six seven eight.</p><img src="a.png" alt="Pic"><p>* * *</p><div><p>Third one two three four five six seven eight.</p><script>no()</script></div><p style="display:none">hidden</p></body></html>"""


def test_html_flow():
    rows = list(html.flow_rows(PAGE))
    paras = [(r["text"], r["extra"]) for r in rows if r["kind"] == "paragraph"]
    assert paras == [("The Title", None), ("First one two three four five six seven eight nine ten.", None), ("Second one two three four five six seven eight.", "horizontal-rule"), ("Third one two three four five six seven eight.", "text-ornament")]
    assert [(r["text"], r["paragraph_id"]) for r in rows if r["kind"] == "heading"] == [("The Title", 1)]
    assert [(r["paragraph_id"], r["extra"]) for r in rows if r["kind"] == "image"] == [(3, "a.png")]
    assert [(r["text"], r["paragraph_id"]) for r in rows if r["kind"] == "anchor"] == [("t", 1)]
    assert list(html.flow_rows("<p>unclosed <b>text")) and list(html.flow_rows("")) == []


def package(extra: str = "", container: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        if container:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        z.writestr("OPS/p.opf", f'<package xmlns="x"><metadata><title>Book &amp; One</title><creator>A</creator><language>en</language>{extra}</metadata><manifest><item id="c" href="Text/c%201.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="i" href="cover.png" media-type="image/png" properties="cover-image"/></manifest><spine><itemref idref="c"/><itemref idref="zz"/></spine></package>')
        z.writestr("OPS/Text/C 1.xhtml", '<html><body><h1 id="a">One</h1><p>Some text here.</p><img src="../cover.png"/></body></html>')
        z.writestr("OPS/nav.xhtml", '<html xmlns:epub="e"><body><nav epub:type="toc"><ol><li><a href="Text/c%201.xhtml#a">One</a></li></ol></nav></body></html>')
    return out.getvalue()


def test_epub(spark):
    books = spark.createDataFrame([("good", package()), ("fixed", package('<meta property="rendition:layout">pre-paginated</meta>')), ("none", package(container=False)), ("bad", b"PKnope")], "path string, content binary")
    rows = epub.read_epubs(books).collect()
    good = [(r["kind"], r["text"], r["extra"], r["paragraph_id"]) for r in rows if r["book"] == "good"]
    assert ("metadata", "Book & One", "title", None) in good and ("paragraph", "Some text here.", None, 2) in good and ("nav", "One", "a", 1) in good and ("image", "", "OPS/cover.png", 2) in good and ("cover", "OPS/cover.png", None, None) in good
    assert any(k == "diagnostic" and "zz" in t for k, t, _, _ in good)
    assert {r["book"]: r["extra"] for r in rows if r["book"] != "good"} == {"fixed": "Other", "none": "Crash / parse error", "bad": "Crash / parse error"}


def test_scroll_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") * 37).alias("ms"), F.col("event_id").alias("seq"), F.col("value").alias("top"))
    events.orderBy("ms").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = jobs.scroll_intents(stream, watermark="1 day").writeStream.format("memory").queryName("intents").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("intents").collect()} == {tuple(r) for r in jobs.scroll_intents_batch(events).collect()}


def test_scroll_machine():
    state, out = (None, None, 0.0, 0, 0), []
    for top, ms in ((0, 0), (30, 50), (60, 100), (50, 120), (10, 200), (5, 900)):
        state, intent = jobs.scroll_step(state, top, ms)
        out.append(intent)
    assert out == [None, None, "forward", None, "backward", None]


def test_status_machine():
    assert jobs.status_valid(None, "queued") and jobs.status_valid("queued", "validating") and not jobs.status_valid("completed", "validating") and jobs.status_valid("validating", "failed")


def test_files(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1"), "a.pdf"), (bytearray(b"PK.."), "a.pdf"), (bytearray(b""), "x")], "c binary, n string")
    assert [tuple(r) for r in df.select(files.detect_format(F.col("c")), files.format_error(F.col("c"), F.col("n")).isNull()).collect()] == [("pdf", True), ("epub", False), (None, False)]
    assert files.decode_markup("é".encode("utf-16")) == "é" and files.decode_markup(b'<?xml encoding="latin-1"?>\xe9')[-1] == "é" and files.decode_markup(b"\xff") == "�"


def test_csv_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Text#,Type,Title,Language\n1,Text,"A ""b""\nc",en\n2,Sound,x,en\n3,Text,y,fr; en\n4,Text,z,fr\n')
    assert ids(files.csv_catalog(spark, str(tmp_path / "c.csv")), "Text#") == ["1", "3"]


def test_clusters(spark):
    assert list(G.clusters([1, 1.5, 5, 1.2, 5.4, 9], 1)) == [[1, 1.2, 1.5], [5, 5.4], [9]]
    items = spark.createDataFrame([(1, 1, 0, "Hel", 0.0, 10.0, 10.0, 10.0), (1, 1, 1, "lo", 10.5, 20.0, 10.5, 10.0), (1, 1, 2, "world", 25.0, 50.0, 10.2, 10.0), (1, 1, 3, "far", 200.0, 220.0, 10.0, 10.0), (1, 1, 4, "next", 0.0, 20.0, 30.0, 10.0)], "book_id long, page long, seq int, text string, x_min double, x_max double, baseline double, font_size double")
    assert [r["text"] for r in G.line_clusters(items).orderBy("line_id").collect()] == ["Hello world", "far", "next"]


def test_oversized(spark):
    text = " ".join(" ".join(["Word"] + ["w"] * 58 + ["end."]) for _ in range(10))
    got = spark.createDataFrame([(text,), ("Short one. Two.",)], "t string").select(G.oversized_split(F.col("t"))).collect()
    assert [len(p.split()) for p in got[0][0]] == [240, 360] and got[1][0] == ["Short one. Two."]


def test_html_css():
    css = "/* x */ .a, .b { background: url('p.png') } .scene-break { height: 0 } @media x { .c { color: red } }"
    assert html.css_image_rules(css) == [(".a", "p.png"), (".b", "p.png")] and html.css_separators(css) == [".scene-break"]


def test_toc_choice(spark):
    e = spark.createDataFrame([("b", "nav", i, f"t{i}", 1) for i in range(5)] + [("b", "ncx", i, f"t{i}", i + 1) for i in range(3)], "book string, source string, ord int, title string, start_paragraph_id int")
    books = spark.createDataFrame([("b",), ("none",)], "book string")
    assert {r["book"]: r["source"] for r in epub.choose_source(e, books).collect()} == {"b": "ncx", "none": "single"}


def test_deep_and_wide_trees(spark):
    """A chain of 500 folders and 1.2 million folders at once; no limit of rows or levels."""
    chain = spark.range(500).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent_id"))
    wide = spark.range(1_200_000).select(F.concat(F.lit("w"), "id").alias("id"), F.when(F.col("id") >= 1000, F.concat(F.lit("w"), F.col("id") % 1000)).alias("parent_id"))
    up = L.ancestors(chain.unionByName(wide)).groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.count_distinct("id").alias("ids"))
    assert {r["kind"]: (r["n"], r["far"], r["ids"]) for r in up.collect()} == {"c": (500 * 501 // 2, 499, 500), "w": (1_200_000 + 1_199_000, 1, 1_200_000)}


def test_patches_set_null_and_refuse(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, error string, created_at int")
    patch = spark.createDataFrame([(1, None, ["error"]), (2, None, []), (9, "x", ["error"])], "id int, error string, given array<string>")
    got = R.patched(rows, patch, ["id"], ["created_at"], "given")
    assert sorted(map(tuple, got.collect())) == [(1, None, 1), (2, "b", 2), (3, "c", 3)]
    assert [r["id"] for r in R.missing_patches(rows, patch, ["id"]).collect()] == [9]
    bad = spark.createDataFrame([(1, None, ["created_at"])], "id int, error string, given array<string>")
    with pytest.raises(Exception, match="may not set created_at"):
        R.patched(rows, bad, ["id"], ["created_at"], "given").collect()


def test_clear_all_keeps_settings(spark):
    df = spark.createDataFrame([(1,)], "book_id int")
    out = R.clear_all_books({"books": df, "book_images": df, "app_settings": df})
    assert [out[n].count() for n in ("books", "book_images", "app_settings")] == [0, 0, 1]


def test_furniture(spark):
    """Headers on 35 % of the pages, or on 60 % of the odd ones, go; body lines and rare headers stay; legal footers take what is below."""
    lines = [(1, p, "The Book 12" if p % 2 else f"Chapter {p}", 5.0) for p in range(1, 9)] + [(1, p, "body text", 50.0) for p in range(1, 9)] + [(1, p, f"{p}", 95.0) for p in range(1, 9)]
    lines += [(1, 1, "© 2001 someone", 90.0), (1, 1, "below", 97.0), (1, 2, "Contents ….. 7", 12.0), (2, 1, "short book", 5.0), (2, 2, "short book", 5.0)]
    df = spark.createDataFrame(lines, "book_id int, page int, text string, baseline double").withColumn("height", F.lit(100.0))
    left = sorted((r["book_id"], r["page"], r["text"]) for r in G.without_furniture(df).collect())
    assert left == sorted([(1, p, "body text") for p in range(1, 9)] + [(1, p, f"Chapter {p}") for p in (2, 4, 6, 8)] + [(1, 2, "Contents ….. 7")] + [(2, 1, "short book"), (2, 2, "short book")])
