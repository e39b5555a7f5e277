"""Queries without SQL against plain loops over the same tables."""

from statistics import median

import pyarrow.parquet as pq
import pytest
import regex

from leafmill.plans.catalog import ORACLE_SQL, QUERIES
from leafmill.sources import html
from leafmill.streaming import jobs

ELSEWHERE = {"recovered_chapters": "test_recovery.py", "page_blocks": "test_store.py"}


def read(sf, name, *columns):
    return pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()


def paragraphs(sf):
    for r in read(sf, "documents", "doc_id", "text"):
        lines = [regex.sub(r"\s+", " ", (x or "").replace("\u00ad", "")).strip() for x in (r["text"] or "").split("\n")]
        yield from ((r["doc_id"], i + 1, t) for i, t in enumerate(x for x in lines if x))


def sentences(text):
    return [s for s in (x.strip() for x in regex.split(r"(?<=[.!?…]|[.!?…][”’)])\s+(?=[\p{Lu}“‘\"\'(])", text)) if s]


def words(text):
    return sum(bool(regex.sub(r"""^["']+|["']+$""", "", w)) for w in regex.split(r"\s+", text))


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLE_SQL) == {"sentences", "page_totals", "gap_clusters", "oversized_paragraphs", "scroll_intents", *ELSEWHERE}


def test_sentences(spark, sf):
    got = sorted(map(tuple, QUERIES["sentences"](spark, sf).collect()))
    want = sorted((d, p, i, s) for d, p, t in paragraphs(sf) for i, s in enumerate(sentences(t)))
    assert [g[:2] for g in got] == [w[:2] for w in want] and sorted(g[-1] for g in got) == sorted(w[-1] for w in want)


def test_page_totals(spark, sf):
    got = {r["page_id"]: (r["words"], r["paragraphs"], r["headings"]) for r in QUERIES["page_totals"](spark, sf).collect()}
    for r in read(sf, "pages", "page_id", "html"):
        rows = list(html.flow_rows(r["html"]))
        if rows:
            kinds = [x["kind"] for x in rows]
            assert got[r["page_id"]] == (sum(words(x["text"]) for x in rows if x["kind"] == "paragraph"), kinds.count("paragraph"), kinds.count("heading"))


def test_gap_clusters(spark, sf):
    gaps = {}
    for r in read(sf, "lineitem", "l_orderkey", "l_quantity"):
        gaps.setdefault(r["l_orderkey"], []).append(float(r["l_quantity"]))
    want = set()
    for book, values in gaps.items():
        groups = []
        for v in sorted(values):
            if groups and v - median(groups[-1]) <= 3.0:
                groups[-1].append(v)
            else:
                groups.append([v])
        want |= {(book, i, len(g), float(median(g))) for i, g in enumerate(groups)}
    assert {(r["book_id"], r["cluster"], r["n"], r["center"]) for r in QUERIES["gap_clusters"](spark, sf).collect()} == want


def pieces(text, least=180, target=280, most=420):
    parts = sentences(text)
    out = []
    for s in parts:
        if out and not (words(out[-1]) >= least and words(out[-1]) + words(s) > target):
            out[-1] += " " + s
        else:
            out.append(s)
    if len(out) >= 2 and words(out[-1]) < least and words(out[-2]) + words(out[-1]) <= most:
        out[-2:] = [" ".join(out[-2:])]
    good = words(text) > 420 and len(parts) >= 3 and all(words(s) <= most for s in parts) and len(out) >= 2 and all(words(s) <= most for s in out)
    return out if good else [text]


def test_oversized(spark, sf):
    got = {(r["doc_id"], r["paragraph_id"], r["piece"]): r["text"] for r in QUERIES["oversized_paragraphs"](spark, sf).collect()}
    assert got == {(d, p, i): s for d, p, t in paragraphs(sf) for i, s in enumerate(pieces(t))}


def test_scroll_intents(spark, sf):
    want, state = set(), {}
    for r in sorted(read(sf, "events", "user_id", "event_id", "value"), key=lambda r: r["event_id"]):
        key, ms = str(r["user_id"]), r["event_id"] * 37
        state[key], intent = jobs.scroll_step(state.get(key, (None, None, 0.0, 0, 0)), r["value"], ms)
        if intent:
            want.add((key, ms, r["event_id"], intent))
    assert want and {tuple(r) for r in QUERIES["scroll_intents"](spark, sf).collect()} == want


@pytest.mark.parametrize("name", sorted(ELSEWHERE))
def test_others_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
