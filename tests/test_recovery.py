"""Recovered chapters against plain loops over small made books."""

import random
import unicodedata

from pyspark.sql import functions as F

from leafmill.operators import chapters as C
from leafmill.operators import recovery as R

BOOK = "A Long Voyage"
TITLES = ["Chapter 1", "Chapter 2: On", "Act I", "Act II", "The Hills", "The Hills", "The River", "The River", "Song of Rain", "Preface", "Poems of Note", "Part One", "Scene 1", "or", "Section 4", "Voyage", "Notes"]
LAST = R.LAST


def norm(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s) if not "\u0300" <= c <= "\u036f").split()).lower()


def matches(p, t):
    number, dot, rest = t.partition(".")
    return bool(p and t) and (p == t or p.startswith(t + " ") or p in (t + ".", t + ",") or (len(p) < len(t) + 15 and t in p) or bool(dot and number.isdigit() and rest.strip() and p in (number, "chapter " + number, rest.strip())))


class Plain:
    """The rules by loops; kinds and fragments are looked up, as they have tests of their own."""

    def __init__(self, kind, fragment, paragraphs):
        self.kind, self.fragment, self.paragraphs = kind, fragment, paragraphs  # paragraphs: (id, text, file) from 1 without gaps

    def best(self, chapters):
        score = {"chapter": 90, "letter": 85, "numbered": 75, "other": 60, "book": 45, "act": 40, "part": 35, "volume": 25, "dramatis": 15, "play-section": 15, "scene": 5}
        rank = lambda c: (score.get(self.kind[c[2]], -50) - 10 * norm(c[2]).startswith(("by ", "or, ")) - 10 * (len(norm(c[2])) < 4), len(c[2]), -c[0])
        by = {}
        for c in chapters:
            if c[1] not in by or rank(c) > rank(by[c[1]]):
                by[c[1]] = c
        return sorted(by.values(), key=lambda c: c[1])

    def primary(self, c):
        return self.kind[c[2]] in ("chapter", "letter", "numbered")

    def unwrap(self, cs):
        cs = list(cs)
        while len(cs) >= 2:
            a, b = cs[:2]
            k = self.kind[a[2]]
            works = any(w in norm(a[2]).split() for w in ("trilogy", "poems", "plays", "stories", "essays", "works"))
            if k in ("front", "back") or self.fragment[a[2]] or (b[1] - a[1] <= 12 and k == "other" == self.kind[b[2]] and works):
                cs.pop(0)
            else:
                break
        return cs

    def finalize(self, cs):
        cs = self.best(cs)
        first = next((i for i, c in enumerate(cs) if self.primary(c)), -1)
        if 0 < first <= 3:
            cs = cs[first:]
        cs = self.unwrap(cs)
        n_primary, n_other = sum(map(self.primary, cs)), sum(self.kind[c[2]] == "other" for c in cs)
        out = []
        for i, c in enumerate(cs):
            k, nx = self.kind[c[2]], cs[i + 1] if i + 1 < len(cs) else None
            near = nx and nx[1] - c[1] <= 3 and (self.primary(nx) or self.kind[nx[2]] == "other")
            if not (k in ("front", "back") or (k in ("part", "book", "volume") and near and (k == "volume" or n_primary >= 5)) or (k in ("act", "scene", "dramatis", "play-section") and n_other >= 5)):
                out.append(c)
        cs, out = out, []
        for i, c in enumerate(cs):
            here = next((t for p, t, _ in self.paragraphs if p == c[1]), None)
            behind = next((t for p, t, _ in self.paragraphs if p == c[1] + 1), None)
            nx = cs[i + 1][1] if i + 1 < len(cs) else 1 << 40
            if here is not None and behind is not None and c[1] + 1 < nx:
                heading = norm(here) == norm(c[2]) or matches(norm(here), norm(c[2])) or (len(here) <= 80 and here == here.upper())
                if heading and norm(behind) != norm(c[2]) and len(behind.strip()) >= 2:
                    c = (c[0], c[1] + 1, c[2])
            out.append(c)
        cs, out = out, []
        song = lambda c: "song" in norm(c[2]) or "chant" in norm(c[2])
        for i, c in enumerate(cs):
            before, nx = cs[i - 1] if i else None, cs[i + 1] if i + 1 < len(cs) else None
            if not (song(c) and ((nx and nx[1] - c[1] <= 2 and not song(nx)) or (before and c[1] - before[1] <= 2 and not song(before)))):
                out.append(c)
        return self.best(self.unwrap(self.late(out)))

    def late(self, cs):
        keep = set()
        for t in {norm(c[2]) for c in cs}:
            g = [c for c in cs if norm(c[2]) == t]
            single = len(g) == 1 or self.primary(g[0]) or self.kind[g[0][2]] in ("front", "back")
            keep |= {(c[1], t) for c in (g if single else [max(g, key=lambda c: c[1])])}
        return [c for c in cs if (c[1], norm(c[2])) in keep]

    def implicit(self, entries):
        out = []
        for i, (p, text, file) in enumerate(self.paragraphs):
            named = sorted(e for e in entries if norm(e[1]) == norm(text) and self.open(e))
            e = named[0] if named else None
            says = self.kind[text.strip()] == "chapter" and len(text.split()) <= 24 and len(text) <= 180 and i + 1 < len(self.paragraphs)
            if says or (e and e[2] == file and len(text) <= len(e[1]) + 40):
                out.append((e[0] if e else LAST, p, e[1] if e else text, e[3] if e else 1, e[4] if e else "unknown"))
        return out

    def open(self, e):
        n = norm(e[1])
        reference = (n.startswith("section ") and n[8:9].isdigit()) or n == "top"
        return not (self.kind[e[1]] in ("front", "back") or self.fragment[e[1]] or reference)

    def recover(self, only, entries):
        """entries: (ord, title, file, depth, category)."""
        if len(entries) <= 4 or norm(only) in (norm(BOOK), "full book") or self.kind[only] not in ("front", "back", "other", "numbered", "scene"):
            return None
        start = {}
        for p, _, f in self.paragraphs:
            start.setdefault(f, p)
        files = sorted(start, key=start.get)
        listed = [e for e in entries if e[4] not in ("front", "back")]
        found = []
        acts = [e for e in listed if self.kind[e[1]] == "act"]
        if len(acts) >= 2:
            found += [(0, e[0], start[e[2]], e[1], e[3], e[4]) for e in acts if e[3] == min(a[3] for a in acts) and e[2] in start]
        pool = [e for e in listed if self.open(e)]
        works = [e for e in pool if self.kind[e[1]] == "other"]
        if len(works) >= 2:
            top = [e for e in works if e[3] == min(w[3] for w in works)]
            groups = [[e for e in top if norm(e[1]) == t] for t in {norm(e[1]) for e in top}]
            latest = [max(g) for g in groups if len(g) >= 2]
            if len(latest) >= 2:
                found += [(1, e[0], start[e[2]], e[1], e[3], e[4]) for e in latest if e[2] in start]
        for e in pool:
            best = None
            for p, text, f in self.paragraphs:
                a, t = norm(text), norm(e[1])
                if matches(a, t):
                    s = 90 * (f == e[2]) + 55 * (a == t) + 25 * a.startswith(t + " ") + 10 * (len(text) <= len(e[1]) + 24) - 30 * (p <= max(20, len(self.paragraphs) // 20)) + (20 if self.kind[e[1]] in ("chapter", "letter", "numbered") else 10 if self.kind[e[1]] == "other" else 0) + 10 * (f == e[2] and files.index(f) > 0)
                    if best is None or s > best[0]:
                        best = (s, p)
            if best:
                found.append((2, e[0], best[1], e[1], e[3], e[4]))
        found += [(3, o, p, t, d, c) for o, p, t, d, c in self.implicit(entries)]
        inner = [f for f in found if f[5] not in ("front", "back")]
        chosen = inner if len(inner) >= 2 else found
        stats = []
        for d in {f[4] for f in chosen}:
            s = sorted(f[2] for f in chosen if f[4] == d)
            gaps = sorted(b - a for a, b in zip(s, s[1:]))
            m = len(gaps) // 2
            if len(s) >= 2:
                stats.append((len(s), (gaps[m] if len(gaps) % 2 else (gaps[m - 1] + gaps[m]) / 2), -d))
        if stats:
            wide = [x for x in stats if x[1] >= 5]
            depth = -max(wide or stats)[2]
            chosen = [f for f in chosen if f[4] == depth]
        ordered = [(i, f[2], f[3]) for i, f in enumerate(sorted(chosen, key=lambda f: f[:3]))]
        got = self.finalize(self.late(sorted(ordered, key=lambda c: (c[1], c[0]))))
        return got if len(got) >= 2 else None


def books(seed):
    rng = random.Random(seed)
    for b in range(24):
        n = rng.randint(3, 60)
        paras = [(i + 1, rng.choice(TITLES + ["CAPITALS ALL", "Some prose that goes on for a while, long enough to be a body.", "chapter 9 of it"] * 4), f"f{i // 9}") for i in range(n)]
        entries = [(i, rng.choice(TITLES), f"f{rng.randint(0, 7)}", rng.randint(1, 2), rng.choice(["unknown", "unknown", "unknown", "front", "main"])) for i in range(rng.randint(2, 14))]
        yield b, paras, entries, rng.choice(["An Essay", "Preface", "Chapter 1", BOOK, "Scene 3"])


def test_recovery(spark):
    every = list(books(5))
    texts = sorted({t for _, ps, es, only in every for t in [only, *[p[1] for p in ps], *[e[1] for e in es]]})
    known = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.chapter_kind(F.col("t"), F.lit(BOOK)).alias("k"), R.title_fragment(F.col("t"), F.lit(BOOK)).alias("f")).collect()
    kind, fragment = {r["t"]: r["k"] for r in known}, {r["t"]: r["f"] for r in known}
    paras = spark.createDataFrame([(b, *p) for b, ps, _, _ in every for p in ps], "book_id int, paragraph_id int, text string, file string")
    entries = spark.createDataFrame([(b, e[0], e[1], e[2], "", e[3], e[4]) for b, _, es, _ in every for e in es], "book_id int, ord int, title string, file string, anchor string, depth int, category string")
    chapters = spark.createDataFrame([(b, 1, 1, only) for b, _, _, only in every], "book_id int, pos int, start int, title string")
    titles = spark.createDataFrame([(b, BOOK) for b, *_ in every], "book_id int, title string")
    got = {}
    for r in R.recover_collapsed(chapters, entries, paras, titles).collect():
        got.setdefault(r["book_id"], []).append((r["start"], r["title"]))
    changed = 0
    for b, ps, es, only in every:
        found = Plain(kind, fragment, ps).recover(only, es)
        changed += found is not None
        assert sorted(got[b]) == sorted((c[1], c[2]) for c in found or [(0, 1, only)]), b
    assert changed > 8


def test_clean_lists(spark):
    rng = random.Random(9)
    every = [(b, [(i + 1, rng.choice(TITLES + ["Some prose that goes on."] * 9), "f") for i in range(50)], [(i, rng.randint(1, 50), rng.choice(TITLES)) for i in range(rng.randint(1, 16))]) for b in range(40)]
    known = spark.createDataFrame([(t,) for t in TITLES + ["Some prose that goes on."]], "t string").distinct().select("t", C.chapter_kind(F.col("t"), F.lit(BOOK)).alias("k"), R.title_fragment(F.col("t"), F.lit(BOOK)).alias("f")).collect()
    kind, fragment = {r["t"]: r["k"] for r in known}, {r["t"]: r["f"] for r in known}
    got = {}
    for r in R.finalize(spark.createDataFrame([(b, *c) for b, _, cs in every for c in cs], "book_id int, pos int, start int, title string"), spark.createDataFrame([(b, *p) for b, ps, _ in every for p in ps], "book_id int, paragraph_id int, text string, file string"), spark.createDataFrame([(b, BOOK) for b, *_ in every], "book_id int, title string")).collect():
        got.setdefault(r["book_id"], []).append((r["start"], r["title"]))
    for b, ps, cs in every:
        assert sorted(got.get(b, [])) == sorted((c[1], c[2]) for c in Plain(kind, fragment, ps).finalize(cs)), b


def test_fragments(spark):
    rows = [("or", True), ("OR", False), ("by the author", True), ("Voyage", True), ("long", False), ("A Long Voyage and more", True), ("Elsewhere", False), ("given in full", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").where(R.title_fragment(F.col("t"), F.lit(BOOK)) != F.col("want")).collect()
    assert got == []
