"""Titles looked up in one task a book or page: one exchange, and the same rows as by joins, which large groups still go through."""

import random

import pytest

from leafmill.operators import geometry as G
from leafmill.operators import grouped
from leafmill.operators import pdf_text as D

WORDS = "sea land wind rain long way home again my friend night Chapter 12 İstanbul ﬁre Straße".split()


def titles(rnd: random.Random) -> str | None:
    return rnd.choice([None, "", " - ", "Chapter 12"]) if rnd.random() < 0.1 else " ".join(rnd.choices(WORDS, k=rnd.choice([1, 4, 5, 6, 9, 10, 11])))


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("RepartitionByExpression") + plan.count("Join") + plan.count("Aggregate")


@pytest.fixture
def books(spark):
    rnd = random.Random(4)
    place = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([0, 0, 1, None]), i) for i in range(400)]
    outline = spark.createDataFrame([(b, i, titles(rnd), p, rnd.choice([None, float(rnd.randrange(60))])) for b, p, i in place], "book_id long, ord long, title string, page long, y double")
    headings = spark.createDataFrame([(b, p, i, titles(rnd)) for b, p, i in place], "book_id long, page long, paragraph_id int, title string")
    lines = spark.createDataFrame([(b, p, i, float(rnd.randrange(60))) for b, p, i in place if b != 3], "book_id long, page long, paragraph_id int, baseline double")
    return outline, headings, lines


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("most", [10_000, 150, 0])
def test_outline_headings_go_by_book_once(books, monkeypatch, most):
    outline, headings, _ = books
    want = rows(G.outline_match_by_joins(outline, headings))
    monkeypatch.setattr(grouped, "MOST_ROWS", most)
    got = G.outline_match(outline, headings)
    assert rows(got) == want and sum("None" not in r for r in want) > 40
    if most == 10_000:
        assert exchanges(got) == 1


@pytest.mark.parametrize("most", [10_000, 150, 0])
def test_outline_starts_go_by_page_once(books, monkeypatch, most):
    want = rows(D.outline_starts_by_joins(*books))
    monkeypatch.setattr(grouped, "MOST_ROWS", most)
    got = D.outline_starts(*books)
    assert rows(got) == want and len(want) > 100
    if most == 10_000:
        assert exchanges(got) == 1


def test_a_group_is_given_whole(spark, monkeypatch):
    monkeypatch.setattr(grouped, "STEP_ROWS", 3)
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i) for i in range(60)], "k long, v long")
    sizes = grouped.map_groups(df, ["k"], df.schema, lambda at, held: [(at[0], len(held))] * 4).collect()
    assert sorted(r["v"] for r in sizes if r["k"] is not None) == [20] * 8
    assert sum(r["v"] for r in sizes if r["k"] is None) == 80


@pytest.mark.parametrize("most", [10_000, 30, 0])
def test_images_are_anchored_by_book_once(spark, monkeypatch, most):
    rnd = random.Random(5)
    place = lambda: (rnd.choice([1, 1, 2, 3, None]), rnd.choice([0, 1, 2]))
    images = [(*(at := place()), i, rnd.uniform(0, 500), rnd.uniform(0, 100), 500.0 - 50 * at[1]) for i in range(60)] + [(1, None, 60, 1.0, 99.0, 500.0), (9, 1, 61, 1.0, 1.0, 500.0)]
    lines = [(*place(), i, rnd.choice([0, 1, 2]), rnd.uniform(0, 100), x := rnd.uniform(0, 400), x + rnd.uniform(0, 200)) for i in range(60)]
    im = spark.createDataFrame(images, "book_id long, page long, image_id long, x double, y double, width double")
    ln = spark.createDataFrame(lines, "book_id long, page long, paragraph_id long, col int, baseline double, x_min double, x_max double")
    want = rows(D.image_anchors_by_joins(im, ln))
    monkeypatch.setattr(grouped, "MOST_ROWS", most)
    got = D.image_anchors(im, ln)
    assert rows(got) == want and len(want) == 62
    if most == 10_000:
        assert exchanges(got) == 2  # an exchange and the aggregate behind it


def marked(n: int) -> list[tuple]:
    """A book with contents over several paragraphs, numbered paragraphs, a number behind a paragraph's end and a title that runs into the next paragraph."""
    told = [f"Chapter {i}. The part {chr(96 + i)} of it" for i in range(1, 7)]
    texts = ["Before Contents", *told, *(f"{'x' * 90} {i}" for i in range(n))]
    at = len(told) + 3
    for i, t in enumerate(told, 1):
        texts[at + 3 * i] = f"so it ends * * * {t} and goes on"
    texts[at + 6] = "so it ends * * * Chapter"
    texts[at + 7] = "2. The part b of it and goes on"
    texts[at + 9] = "so it ends * * * Chapter 3. The part"
    texts[at + 10] = "c of it, over the edge"
    return [(1, i + 1, None, t) for i, t in enumerate(texts)] + [(2, 1, "strong", "Chapter 1"), (2, 2, None, "prose"), (2, 3, None, "ends with chapter")]


@pytest.mark.parametrize("block", [256, 3, 2])
def test_headings_inside_prose_are_found_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "_BLOCK", block)
    df = spark.createDataFrame(marked(40), "book_id long, para int, heading string, text string")
    got = {(r["book_id"], r["para"], r["piece"]): (r["heading"], r["text"]) for r in D.embedded_headings(df).collect()}
    assert [v for k, v in sorted(got.items()) if v[0] == "strong" and k[0] == 1] == [("strong", f"Chapter {i}. The part {chr(96 + i)} of it") for i in range(1, 6)] + [("strong", "Chapter 6.")]
    assert got[1, 16, 0] == (None, "so it ends") and got[1, 16, 2] == (None, "and goes on") and (1, 17, 0) not in got
    assert got[1, 19, 2] == (None, ", over the edge") and (1, 20, 0) not in got
    assert got[1, 1, 0] == (None, "Before Contents") and not any((1, p, 0) in got for p in range(2, 8))
    assert len([k for k in got if k[0] == 2]) == 3 and len([k for k in got if k[0] == 1]) == 47 - 6 - 2 + 12


def test_headings_inside_prose_exchange_texts_twice(spark):
    import hashlib

    def written():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    noise = lambda *x: "".join(hashlib.sha256(repr((x, k)).encode()).hexdigest() for k in range(16))
    rows = [(b, p, None, (f"Chapter {p // 2}. " if p % 2 else "") + noise(b, p)) for b in range(20) for p in range(1, 40)]
    df = spark.createDataFrame(rows, "book_id long, para int, heading string, text string").persist()
    size = sum(len(r[3]) for r in rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert D.embedded_headings(df).count() > len(rows)
        assert written() - before < 2.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_places_of_files_are_asked_for_pairs_only(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(rnd.choices(["sea", "land", "wind"], k=rnd.choice([1, 2, 3])))
    paras = spark.createDataFrame([(b, i, text(), f"f{i % 3}", i % 3, 30) for b in (1, 2) for i in range(1, 31)], "book_id long, paragraph_id int, text string, file string, spine int, total long")
    toc = spark.createDataFrame([(b, i, text(), f"f{i % 4}", "chapter") for b in (1, 2) for i in range(30)], "book_id long, ord int, title string, file string, kind string")
    files = paras.select("book_id", "file", "spine", "total").distinct()
    want = rows(G.toc_scored_match(toc, paras))
    assert rows(G.toc_scored_match(toc, paras.drop("spine", "total"), files)) == want and len(want) > 40


def test_texts_of_implicit_headings_are_joined_with_their_book_only(spark):
    from leafmill.operators import recovery as R

    p = spark.createDataFrame([(1, 1, "Chapter 1. One", "a"), (1, 2, "prose", "a"), (1, 4, "Chapter 2. Two", "a"), (1, 6, "The  End", "b"), (2, 1, "Chapter 9", "a")], "book_id long, paragraph_id int, text string, file string")
    books = spark.createDataFrame([(1, "The Sea"), (2, None)], "book_id long, title string")
    entry = "book_id long, ord int, title string, file string, depth int, category string, kind string, norm string, fragment boolean"
    got = R.implicit_headings(p, spark.createDataFrame([(1, 7, "The end", "B", 2, "main", "other", "the end", False)], entry), books)
    assert sorted((r["book_id"], r["start"], r["title"], r["depth"], r["ord"]) for r in got.collect()) == [(1, 1, "Chapter 1. One", 1, R.LAST), (1, 6, "The end", 2, 7)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
