"""DuckDB fragments that the oracles share."""

from __future__ import annotations

from leafmill.functions.text import ORNAMENT, SPACE

NORM = rf"trim(regexp_replace(regexp_replace({{0}}, '\x{{{{00AD}}}}', '', 'g'), '{SPACE.replace('{', '{{').replace('}', '}}')}+', ' ', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c)


def tokens(c: str) -> str:
    return rf"""list_filter(list_transform(regexp_split_to_array({c}, '{SPACE}+'), lambda w: regexp_replace(w, '^["'']+|["'']+$', '', 'g')), lambda w: w <> '')"""


def letters(c: str) -> str:
    return rf"length(regexp_replace({c}, '[^\p{{L}}]', '', 'g'))"


def ornaments(c: str) -> str:
    return rf"length(regexp_replace({c}, '{ORNAMENT.replace('[', '[^', 1)}', '', 'g'))"


def nav_kind(c: str) -> str:
    t = f"lower({norm(c)})"
    starts = lambda words: rf"regexp_matches({t}, '^(?:{words})\b')"
    return f"""CASE WHEN {starts('contents|title page|copyright|dedication|preface|foreword|introduction')} THEN 'frontmatter'
      WHEN {starts('notes|endnotes|bibliography|index|colophon|about the author')} THEN 'backmatter'
      WHEN {starts('book|part|volume')} THEN 'part' WHEN {starts('scene')} THEN 'scene' WHEN {starts('section|appendix')} THEN 'section' ELSE 'chapter' END"""


#: paragraphs (doc_id, paragraph_id, text)
PARAGRAPHS = f"""p AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS paragraph_id, unnest(l) AS text
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {norm('x')}), lambda x: x <> '') AS l FROM documents))"""
#: with words
COUNTED = PARAGRAPHS + f""", c AS (SELECT *, len({tokens('text')})::INTEGER AS words FROM p)"""
#: with words before and in all
PREFIXED = COUNTED + """, w AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before, sum(words) OVER (PARTITION BY doc_id)::BIGINT AS total_words FROM c)"""
#: chapters at every third paragraph
CHAPTERS = f"""ch AS (SELECT doc_id, ((paragraph_id - 1) // 3)::INTEGER AS chapter_index, substring(text, 1, 40) AS title, paragraph_id AS start_paragraph_id FROM p WHERE (paragraph_id - 1) % 3 = 0),
chk AS (SELECT *, {nav_kind('title')} AS kind FROM ch)"""
#: words one a row
WORDS = PARAGRAPHS + f""", t AS (SELECT doc_id, paragraph_id, {tokens('text')} AS l FROM p),
wd AS (SELECT doc_id, paragraph_id, (generate_subscripts(l, 1) - 1)::INTEGER AS word_index, unnest(l) AS word FROM t)"""
