"""Operator 13, phrase collocation mining: word phrases that stand together more often than apart, for each language.

Four passes, all bounded in memory:

1. Words are counted by language; those that occur ``least`` times get dense ids (1 and up), all others end a piece, as no
   phrase with one of them can occur that often. A dictionary of bounded size is broadcast; a larger one is joined.
2. Texts become ids, four bytes each, 0 between pieces, in blobs that are written to the checkpoint folder.
3. Pairs of ids are packed into keys of 16 bytes (four ids, big endian, 0 at the end), sorted by a radix sort of 16-bit digits, run-length
   counted in blocks, dealt by key ranges, sorted there by Spark and run-length counted again. A hot pair is one row of a
   block, and bounds between ranges come from a bounded sample of places.
4. The same for three and four ids, at places where every pair occurs often enough. A bitmap of bounded size tells these
   places; what it lets through beside them is counted and then dropped as too rare, so it costs time, never a result.

Scores, and the removal of phrases inside longer ones, are joins of the counted phrases, which are few: at most a
``least``-th of all words. Sums of two counts are decimals, products too.

Words are runs of other characters than blanks and tabs, in pieces between ``[.,;:!?]`` and line ends; A-Z are lower-cased. Defined
results: a null or empty text has no words; a null language is ``und``; repeated rows count each; an empty table gives an empty
result; other columns and doc_ids play no part. A text of any length is cut at words by one task, which holds a small multiple of it. Ties of
score and count are ordered by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._batches import bounded_batches, steps, with_checkpoints

#: Stands between pieces; a separator, so no word is or holds one.
BREAK = b";"
_FROM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,:!?\n\x0b\x0c\r" + b"\t"
_TO = b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9 + b" "
_TABLE = bytes.maketrans(_FROM, _TO)
WORDS = 4
_ID_BITS = 33  # of a row's number within its partition, in monotonically_increasing_id


@dataclass(frozen=True)
class PhraseParams:
    """``dictionary_rows`` and ``dictionary_bytes`` bound what is broadcast; ``block`` keys are sorted at once; ``filter_bits`` bounds the bitmap."""

    least: int = 30
    inside_percent: int = 80
    top: int = 2000
    dictionary_rows: int = 400_000
    dictionary_bytes: int = 16 << 20
    block: int = 1 << 20
    filter_bits: int = 1 << 26
    range_rows: int = 4_000_000
    sample: int = 100_000
    counted_words: int = 250_000


def cut(text: bytes) -> list[bytes]:
    """Lower-cased words, and ``BREAK`` at each separator."""
    return text.translate(_TABLE).replace(BREAK, b" ; ").split(b" ")


def count_words(documents: DataFrame, params: PhraseParams) -> DataFrame:
    """lang, word (binary; null for the sum over the language) and n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, c in held.items():
                for gap in (b"", BREAK):
                    c.pop(gap, None)
                langs += [lang] * (len(c) + 1)
                words += [*c, None]
                counts += [*c.values(), sum(c.values())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["lang", "word", "n"])

        for part in steps(batches, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(cut(text))
            if sum(map(len, held.values())) > params.counted_words:
                yield flush()
        yield flush()

    return documents.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame) -> DataFrame:
    """Frequent words with dense ids from 1; the ids stay as they are, since the rows are checkpointed first."""
    numbered = words.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("at", _ID_BITS)
    sizes = sorted((r["part"], r["count"]) for r in numbered.where("word IS NOT NULL").groupBy(part.alias("part")).count().collect())  # a row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    if total >= (1 << 32) - 1:
        raise ValueError("more frequent words than ids of four bytes")
    offsets = F.broadcast(words.sparkSession.createDataFrame(starts or [(0, 0)], "part long, start long"))
    order = Window.partitionBy("part").orderBy("at")
    # numbers in a partition skip rows of sums, so they are counted anew; a partition holds its share of the frequent words only
    placed = numbered.withColumn("part", part).where("word IS NOT NULL").withColumn("nth", F.row_number().over(order))
    return placed.join(offsets, "part").select("lang", "word", "n", (F.col("start") + F.col("nth")).alias("id")).checkpoint()


def _blob(ids: np.ndarray) -> bytes:
    """The ids without places that no phrase covers: single words, and breaks beside breaks."""
    full = np.concatenate([[False], ids > 0, [False]])
    alone = full[1:-1] & ~full[:-2] & ~full[2:]
    ids = np.where(alone, 0, ids).astype("<u4")
    return ids[(ids > 0) | np.concatenate([[False], ids[:-1] > 0])].tobytes()


def encode_by_broadcast(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Blobs of ids, by a dictionary that every worker holds."""
    by_lang: dict[str, dict[bytes, int]] = {}
    for r in dictionary.select("lang", "word", "id").toLocalIterator():
        by_lang.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    shared = documents.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            every = [np.zeros(1, np.int64)]
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words = [w for w in cut(text) if w]
                every += [np.fromiter(map(shared.value.get(lang, {}).get, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([_blob(np.concatenate(every))], pa.binary())], ["ids"])

    return documents.mapInArrow(run, "ids binary")


def cut_to_places(documents: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """Texts a step at a time as rows (places, langs, words): the distinct words of the step, and for each place the number of its word in them (from 1; 0 is a
    break). Of a text of more than ``longest`` words each stretch is a row of its own, with the last three words of the one before in front, and ``again`` is set."""
    back = WORDS - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[tuple[str, list[bytes]]], again: bool) -> pa.RecordBatch:
            number = count(1)
            by_lang: dict[str, defaultdict[bytes, int]] = {}
            every = [] if again else [np.zeros(1, np.int64)]
            for lang, words in parts:
                if lang not in by_lang:
                    by_lang[lang] = defaultdict(number.__next__, {BREAK: 0})
                every += [np.fromiter(map(by_lang[lang].__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
            found = sorted((n, lang, w) for lang, own in by_lang.items() for w, n in own.items() if n)
            columns = [pa.array([np.concatenate(every).astype("<u4").tobytes()], pa.binary()), pa.array([again]), pa.array([[x[1] for x in found]], pa.list_(pa.string())), pa.array([[x[2] for x in found]], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["places", "again", "langs", "words"])

        for part in steps(batches, "text"):
            held: list[tuple[str, list[bytes]]] = []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words = [w for w in cut(text) if w]
                if len(words) <= longest:
                    held.append((lang, words))
                    continue
                for at in range(0, len(words), longest):
                    yield row([(lang, words[max(0, at - back) : at + longest])], at > 0)
            if held:
                yield row(held, False)

    return documents.mapInArrow(run, "places binary, again boolean, langs array<string>, words array<binary>")


def encode_by_join(documents: DataFrame, dictionary: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """The same by a join, for dictionaries too large to broadcast. A word is looked up by (lang, word) once for each step of texts that has it, not at each of its places."""
    cut = cut_to_places(documents, longest).withColumn("key", F.monotonically_increasing_id()).checkpoint()
    words = cut.select("key", F.posexplode(F.arrays_zip("langs", "words")).alias("at", "w")).select("key", "at", F.col("w.langs").alias("lang"), F.col("w.words").alias("word"))
    found = words.join(dictionary.select("lang", "word", "id"), ["lang", "word"]).groupBy("key").agg(F.collect_list(F.struct("at", "id")).alias("ids"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.zeros(batch.column("n")[i].as_py() + 1, np.int64)
                pairs = batch.column("ids")[i].values
                ids[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                placed = ids[np.frombuffer(batch.column("places")[i].as_buffer(), "<u4")]
                blob = struct.pack("<i", -1) + placed.astype("<u4").tobytes() if batch.column("again")[i].as_py() else _blob(placed)
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["ids"])

    return cut.select("key", "places", "again", F.size("words").alias("n")).join(found, "key").select("places", "again", "n", "ids").mapInArrow(pack, "ids binary")


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order of (high, low), from the least 16-bit digit to the greatest; numpy sorts 16-bit integers stably by radix. Digits that all share are skipped."""
    order = np.arange(len(high))
    for word in (low, high):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(high: np.ndarray, low: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    order = radix_order(high, low)
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(high))) if weight is None else np.add.reduceat(weight[order], first) if len(first) else first
    return high[first], low[first], n.astype(np.int64)


def packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Keys of 16 bytes whose order as bytes is that of (high, low)."""
    return np.ascontiguousarray(np.stack([high, low], 1).astype(">u8")).view("S16").ravel()


def _binary(keys: np.ndarray) -> pa.Array:
    offsets = np.arange(0, 16 * (len(keys) + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])


def bits_of(pair: np.ndarray, bits: int) -> np.ndarray:
    """Place of a pair in a bitmap of ``bits`` (a power of two) bits."""
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def places(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a blob with three zeros behind, and from which place on phrases may end. A blob that starts with -1 repeats three words of another."""
    x = np.frombuffer(blob, "<u4")
    first = 0
    if len(x) and x[0] == 0xFFFFFFFF:
        x, first = x[1:], WORDS - 1
    return np.concatenate([x, np.zeros(WORDS - 1, np.uint32)]).astype(np.uint64), np.int64(first)


def phrase_keys(blob: bytes, sizes: tuple[int, ...], allowed: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(high, low) of every phrase of so many words; with ``allowed``, only where the bitmap has all of its pairs."""
    x, first = places(blob)
    n = len(x) - (WORDS - 1)
    a, b, c, d = (x[k : n + k] for k in range(WORDS))
    pair = (x[:-1] << np.uint64(32)) | x[1:]
    good = (x[:-1] > 0) & (x[1:] > 0)
    if allowed is not None:
        at = bits_of(pair, bits)
        good &= (allowed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    start = np.arange(n)
    for size in sizes:
        keep = good[:n] & (start + size > first)
        for k in range(1, size - 1):
            keep = keep & good[k : n + k]
        high = (a[keep] << np.uint64(32)) | b[keep]
        low = (c[keep] << np.uint64(32) if size > 2 else np.zeros(len(high), np.uint64)) | (d[keep] if size > 3 else np.uint64(0))
        yield high, low


def count_phrases(encoded: DataFrame, sizes: tuple[int, ...], words: int, params: PhraseParams, allowed: np.ndarray | None = None) -> DataFrame:
    """key and f of the phrases that occur ``least`` times."""
    spark = encoded.sparkSession
    bits = 0 if allowed is None else len(allowed) * 8
    shared = spark.sparkContext.broadcast(allowed)
    rate = min(1.0, params.sample / max(1, words))

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column("ids").to_pylist()):
                for high, low in phrase_keys(blob, sizes[-1:], None, 0):
                    draw = np.random.default_rng([len(blob), i]).random(len(high)) < rate
                    yield pa.RecordBatch.from_arrays([_binary(packed(high[draw], low[draw]))], ["key"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words * len(sizes) // params.range_rows))
    drawn = encoded.mapInArrow(sampled, "key binary").toArrow().column("key").to_pylist()  # about ``sample`` keys
    drawn.sort()
    bounds = np.array(sorted({drawn[len(drawn) * k // tasks] for k in range(1, tasks)}) if drawn else [], "S16")

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            high, low, n = run_lengths(np.concatenate([h for h, _ in held] or [np.zeros(0, np.uint64)]), np.concatenate([w for _, w in held] or [np.zeros(0, np.uint64)]))
            held.clear()
            keys = packed(high, low)
            return pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, keys, "right").astype(np.int32)), _binary(keys), pa.array(n)], ["range", "key", "n"])

        size = 0
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                for found in phrase_keys(blob, sizes, shared.value, bits):
                    held.append(found)
                    size += len(found[0])
                if size >= params.block:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    least = params.least

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("key")
            begin = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
            keys = np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + 16 * len(column)].view("S16")
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.add.reduceat(batch.column("n").to_numpy(), first)
            found = keys[first]
            if found[0] == last:
                sums[0] += count
            elif last is not None:
                found, sums = np.concatenate([np.array([last], "S16"), found]), np.concatenate([[count], sums])
            last, count = found[-1], int(sums[-1])
            keep = sums[:-1] >= least
            yield pa.RecordBatch.from_arrays([_binary(found[:-1][keep]), pa.array(sums[:-1][keep].astype(np.int64))], ["key", "f"])
        if last is not None and count >= least:
            yield pa.RecordBatch.from_arrays([_binary(np.array([last], "S16")), pa.array([count], pa.int64())], ["key", "f"])

    dealt = encoded.mapInArrow(combine, "range int, key binary, n long").repartitionById(tasks, F.col("range"))
    return dealt.select("key", "n").sortWithinPartitions("key").mapInArrow(runs, "key binary, f long")


def pair_bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the pairs, built on the executors; its words of 64 bits, bits / 64 rows at most, reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pair = np.array([k[:8] for k in batch.column("key").to_pylist()], "V8").view(">u8").astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits_of(pair, bits)))], ["bit"])

    words = pairs.mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return out.view(np.uint8)


def key_of(*ids: Column) -> Column:
    """Key of 16 bytes of up to four ids."""
    return F.unhex(F.concat(*[F.lpad(F.hex(i), 8, "0") for i in ids], F.lit("00000000" * (WORDS - len(ids)))))


def part_of(key: Column, first: int, size: int) -> Column:
    """Key of ``size`` words of a key, from its ``first`` on (from 0)."""
    return F.concat(F.substring(key, 4 * first + 1, 4 * size), F.lit(bytes(4 * (WORDS - size))))


def length_of(key: Column) -> Column:
    return sum((F.when(F.substring(key, 4 * k + 1, 4) != F.lit(bytes(4)), 1).otherwise(0) for k in range(2, WORDS)), F.lit(2))


def scored(phrases: DataFrame, words: DataFrame, params: PhraseParams) -> DataFrame:
    """key, a, l, r, score of the phrases that no longer one drops. ``phrases``: key, f; ``words``: key, f of single words."""
    sized = phrases.select("key", F.col("f").alias("a"), length_of(F.col("key")).alias("size"))
    cuts = F.array(*[F.when(F.col("size") == m, F.array(*[F.struct(F.lit(k).alias("k"), part_of(F.col("key"), 0, k).alias("left"), part_of(F.col("key"), k, m - k).alias("right")) for k in range(1, m)])) for m in range(2, WORDS + 1)])
    each = sized.select("key", "a", F.explode(F.flatten(F.filter(cuts, lambda c: c.isNotNull()))).alias("c")).select("key", "a", "c.*")
    counts = phrases.select("key", "f").unionAll(words.select("key", "f"))
    each = each.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("cast((cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = each.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.array(*[F.when(F.col("size") == m, F.array(*[part_of(F.col("key"), i, s) for s in range(2, m) for i in range(m - s + 1)])) for m in range(3, WORDS + 1)])
    around = sized.where("size > 2").select(F.explode(F.flatten(F.filter(inner, lambda c: c.isNotNull()))).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, "key", "left").where(f"longer IS NULL OR cast(100 as decimal(3,0)) * cast(longer as decimal(20,0)) < {params.inside_percent} * cast(a as decimal(20,0))")
    return kept.select("key", "a", "cut.l", "cut.r", "cut.score")


def spelled(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds lang and phrase."""
    ids = F.array(*[F.conv(F.hex(F.substring("key", 4 * k + 1, 4)), 16, 10).cast("long") for k in range(WORDS)])
    each = found.select("key", F.posexplode(ids).alias("at", "id")).where("id > 0").join(dictionary.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    texts = each.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    return found.join(texts, "key")


def phrases(documents: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    spark = documents.sparkSession
    with_checkpoints(spark)
    bounded_batches(spark)
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = count_words(texts, params).where((F.col("n") >= params.least) | F.col("word").isNull()).checkpoint()
    totals = counted.where("word IS NULL").select("lang", "n")
    dictionary = with_ids(counted)
    size = dictionary.agg(F.count("*").alias("rows"), F.sum(F.octet_length("word")).alias("bytes"), F.sum("n").alias("words")).first()
    small = size["rows"] <= params.dictionary_rows and (size["bytes"] or 0) <= params.dictionary_bytes
    encoded = (encode_by_broadcast if small else encode_by_join)(texts, dictionary).checkpoint()
    seen = size["words"] or 0
    pairs = count_phrases(encoded, (2,), seen, params).checkpoint()
    bits = 1 << 12
    while bits < min(params.filter_bits, 32 * pairs.count()):
        bits *= 2
    longer = count_phrases(encoded, (3, 4), seen, params, pair_bitmap(pairs, bits)).checkpoint()
    words = dictionary.select(key_of(F.col("id")).alias("key"), F.col("n").alias("f"))
    every = spelled(scored(pairs.unionAll(longer), words, params), dictionary)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # first in each of many shares of a language, so that no task sorts all phrases of one
    share = every.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(64)))
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= params.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= params.top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(params: PhraseParams = PhraseParams()) -> str:
    """The same as DuckDB SQL."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM cut, (SELECT unnest([1, 2, 3, 4]) AS m) s, unnest(range(1, len(w) - m + 2)) AS t(i)),
f AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, m, phrase HAVING count(*) >= {params.least}),
cuts AS (
  SELECT p.lang, p.phrase, p.m, p.a, k, x.a AS l, y.a AS r, (2000000 * p.a::HUGEINT) // (x.a::HUGEINT + y.a::HUGEINT) AS score
  FROM f p, unnest(range(1, p.m)) AS t(k)
  JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:k], ' ')
  JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[k + 1:p.m], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM f, (SELECT unnest([2, 3]) AS s) q, unnest(range(1, m - s + 2)) AS t(i) WHERE m > s GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inner_parts USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer::HUGEINT < {params.inside_percent} * a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {params.top}
"""
