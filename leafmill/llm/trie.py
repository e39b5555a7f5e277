"""Operator 11, conversation prefix trie: every distinct prefix of the rebuilt conversations as a node, with what sharing it saves.

* Turns are encoded by a dictionary: each distinct (role, text) has a number, found by its SHA-256, so that no text is shuffled. A rebuilt
  conversation is a binary string of 16 bytes a turn: the number and the text's bytes.
* Equal conversations become one row with a weight, the least conv_id and the SHA-256 of all their conv_ids, which streams
  through chunks of 4,096 ids. So a conversation that a third of all share is one row from there on.
* A bucket holds the distinct conversations under a node. Buckets beyond a size are partitioned by their next turn (most
  significant digit first), after skipping the turns that all share: the common prefix of the least and the greatest. The sizes allowed grow with the
  table, so that at most some 40,000 large buckets exist at a level; they alone are broadcast.
* Each smaller bucket is finished in one task by multikey quicksort (ternary partitions by the turn at a depth), which emits a node for
  each partition of equal turns. What large buckets' nodes need of the nodes below is summed by bucket, then over their ancestors.

Defined results: turns are ordered by turn, null first, those of one number by the SHA-256 of their role's length, role and text; null role or
text counts as empty; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table gives
an empty result, not a root, as a root has a smallest member. Extra columns play no part. Texts of any length are hashed where they
are read. One task holds the turns of five neighbouring conversations while they are rebuilt, about 150 bytes a turn, and 16 bytes for each turn
of a smaller bucket's conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from leafmill.llm._batches import bounded_batches, with_checkpoints

TURN = 16
NONE = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


@dataclass(frozen=True)
class TrieParams:
    """A bucket of at most ``rows`` conversations and ``size`` bytes is finished by one task; more in a table of over ``buckets`` times as many."""

    rows: int = 2048
    size: int = 4 << 20
    buckets: int = 20_000
    chunk: int = 4096


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and seq: the first turns of the conversation that its group starts with, then its own later ones."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    # written, since numbers may come out otherwise when a lost part is made again
    dictionary = turns.groupBy("digest").agg(F.max("size").alias("size")).withColumn("code", F.monotonically_increasing_id()).checkpoint()
    hexed = F.concat(F.lpad(F.hex("code"), 16, "0"), F.lpad(F.hex("size"), 16, "0"))
    coded = turns.drop("size").join(dictionary, "digest").select("conv_id", F.struct("conv_id", F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "digest", hexed.alias("hex")).alias("t"))
    first = F.col("conv_id") - F.col("conv_id") % 5
    groups = coded.groupBy(first.alias("first")).agg(F.array_sort(F.collect_list("t")).alias("all"))
    each = groups.select("first", "all", F.explode(F.array_distinct(F.transform("all", lambda t: t["conv_id"]))).alias("conv_id"))
    of = lambda c: F.transform(F.filter("all", lambda t: t["conv_id"] == F.col(c)), lambda t: t["hex"])
    held = each.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int").alias("h"), of("first").alias("base"), of("conv_id").alias("own"))
    return held.select("conv_id", F.unhex(F.array_join(F.concat(F.slice("base", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))), "")).alias("seq"))


def distinct_sequences(sequences: DataFrame, chunk: int) -> DataFrame:
    """seq, w (conversations that are this one), first (the least conv_id) and ends (SHA-256 of all of them)."""
    part = F.floor(F.col("conv_id") / chunk)
    pieces = sequences.groupBy("seq", part.alias("chunk")).agg(F.count("*").alias("w"), F.min("conv_id").alias("first"), F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = hasher = None
        w = first = 0
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["seq", "w", "first", "ends"])
            out.clear()
            return got

        for batch in batches:
            for s, n, f, ids in zip(*[batch.column(c).to_pylist() for c in ("seq", "w", "first", "ids")]):
                if hasher is not None and s == seq:
                    hasher.update(b"," + ids.encode())
                    w += n
                    continue
                if hasher is not None:
                    out.append((seq, w, first, hasher.hexdigest()))
                seq, w, first, hasher = s, n, f, hashlib.sha256(ids.encode())
            yield flush()
        if hasher is not None:
            out.append((seq, w, first, hasher.hexdigest()))
            yield flush()

    return pieces.repartition("seq").sortWithinPartitions("seq", "chunk").mapInArrow(run, "seq binary, w long, first long, ends string")


class Bucket:
    """Nodes below a place in the trie, by multikey quicksort. ``rows``: (codes, sizes, w, first, ends), which agree in their first ``depth`` turns."""

    def __init__(self, rows: list[tuple], depth: int, parent: int | None):
        self.parent, self.top = parent, depth
        self.conv, self.depth, self.up, self.n, self.size, self.children, self.ends = [], [], [], [], [], [], []
        whole = self.node(rows, depth, -1)
        self.sort(rows, depth, whole)
        self.leaves = [0] * len(self.conv)
        self.saved = [(n - 1) * size for n, size in zip(self.n, self.size)]
        for i in range(len(self.conv) - 1, -1, -1):  # nodes stand behind their parents
            self.leaves[i] = self.leaves[i] or 1
            if (p := self.up[i]) >= 0:
                self.leaves[p] += self.leaves[i]
                self.saved[p] += self.saved[i]

    def node(self, rows: list[tuple], depth: int, up: int) -> int:
        self.conv.append(min(r[3] for r in rows))
        self.n.append(sum(r[2] for r in rows))
        self.size.append(rows[0][1][depth - 1] if depth else 0)
        self.depth.append(depth)
        self.up.append(up)
        self.children.append(0)
        self.ends.append(NONE)
        if up >= 0:
            self.children[up] += 1
        return len(self.conv) - 1

    def sort(self, rows: list[tuple], depth: int, node: int) -> None:
        """Ternary partitions by the turn after ``depth``; the middle one is a node and goes on a turn deeper."""
        waiting = [(rows, depth, node)]
        while waiting:
            rows, depth, node = waiting.pop()
            longer = [r for r in rows if len(r[0]) > depth]
            if len(longer) < len(rows):
                self.ends[node] = next(r[4] for r in rows if len(r[0]) == depth)
            if not longer:
                continue
            pivot = longer[len(longer) // 2][0][depth]
            less = [r for r in longer if r[0][depth] < pivot]
            more = [r for r in longer if r[0][depth] > pivot]
            same = [r for r in longer if r[0][depth] == pivot] if less or more else longer
            waiting += [(x, depth, node) for x in (less, more) if x]
            waiting.append((same, depth + 1, self.node(same, depth + 1, node)))

    def columns(self) -> list[list]:
        above = [self.parent if p < 0 else self.conv[p] for p in self.up]
        return [self.conv, self.depth, above, self.n, self.children, self.leaves, self.saved, self.ends]


def local_nodes(rows: DataFrame) -> DataFrame:
    """All nodes of the smaller buckets. ``above``: the large bucket that a bucket hangs under, in the rows of its top node only."""
    kind = _parse_datatype_string(NODES + ", above string")

    def finished(group: list[tuple]) -> pa.RecordBatch:
        above, _, depth, parent = group[0][:4]
        decoded = []
        for *_, seq, w, first, ends in group:
            pairs = np.frombuffer(seq, ">u8").reshape(-1, 2)
            decoded.append((pairs[:, 0].tolist(), pairs[:, 1].tolist(), w, first, ends))
        columns = Bucket(decoded, depth, parent).columns()
        columns.append([above] + [None] * (len(columns[0]) - 1))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, to_arrow_schema(kind))], schema=to_arrow_schema(kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("above", "code", "depth", "parent", "seq", "w", "first", "ends")
        each = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in names]))
        for _, group in groupby(each, key=lambda r: r[:2]):
            yield finished(list(group))

    return rows.repartition("above", "code").sortWithinPartitions("above", "code").select("above", "code", "depth", "parent", "seq", "w", "first", "ends").mapInArrow(run, kind)


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns two sequences begin with alike."""

    @F.arrow_udf("int")
    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist()):
            n = min(len(p), len(q))
            unlike = np.frombuffer(p[:n], np.uint8) != np.frombuffer(q[:n], np.uint8)
            out.append((int(unlike.argmax()) if unlike.any() else n) // TURN)
        return pa.array(out, pa.int32())

    return count(a, b)


def trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with_checkpoints(conversations.sparkSession)
    bounded_batches(conversations.sparkSession)
    # above: the large bucket that a row is in; code: its turn after the turns that all of that bucket share
    root = [F.lit("").alias("above"), F.lit(b"").alias("code"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<string>").alias("path")]
    pending = distinct_sequences(rebuilt(conversations), params.chunk).select(*root, "*").checkpoint()
    seen = pending.agg(F.count("*").alias("rows"), F.sum(F.octet_length("seq")).alias("size")).first()
    rows, size = max(params.rows, seen["rows"] // params.buckets), max(params.size, (seen["size"] or 0) // params.buckets)
    small, large, ended = [], [], []
    while True:
        key = ["above", "code"]
        counts = pending.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(F.octet_length("seq")).alias("size"))
        too_large = counts.where((F.col("rows") > rows) | (F.col("size") > size) & (F.col("rows") > 1)).select(*key).checkpoint()
        if too_large.isEmpty():
            small.append(pending)
            break
        heads = pending.join(F.broadcast(too_large), key).groupBy(*key).agg(F.min("seq").alias("least"), F.max("seq").alias("most"), F.min("first").alias("conv_id"), F.sum("w").alias("n"), F.first("depth").alias("start"), F.first("parent").alias("parent"), F.first("path").alias("path"))
        heads = heads.withColumn("shared", shared_turns(F.col("least"), F.col("most")))
        name = F.concat_ws(":", "conv_id", "shared")
        heads = heads.withColumn("bucket", name).withColumn("path", F.concat("path", F.array("bucket"))).checkpoint()
        large.append(heads)
        placed = pending.join(F.broadcast(heads.select(*key, "bucket", "shared", "conv_id", F.col("path").alias("deeper"))), key, "left")
        small.append(placed.where("bucket IS NULL").select(pending.columns))
        inside = placed.where("bucket IS NOT NULL")
        at_end = F.octet_length("seq") == TURN * F.col("shared")
        ended.append(inside.where(at_end).select("bucket", "ends"))
        turn = F.substring("seq", TURN * F.col("shared") + 1, F.lit(TURN))
        pending = inside.where(~at_end).select(F.col("bucket").alias("above"), turn.alias("code"), (F.col("shared") + 1).alias("depth"), F.col("conv_id").alias("parent"), F.col("deeper").alias("path"), "seq", "w", "first", "ends").checkpoint()
    union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
    nodes = local_nodes(union([s.drop("path") for s in small]))
    names = [c.split()[0] for c in NODES.split(", ")]
    if not large:
        return nodes.select(names)
    return nodes.select(names).unionByName(large_nodes(union(large), union(ended), nodes).select(names))


def large_nodes(heads: DataFrame, ended: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of the large buckets: for each the turns from its start to where its conversations part."""
    size = lambda k: F.conv(F.hex(F.substring("least", TURN * (k - 1) + 9, F.lit(8))), 16, 10).cast("long")
    chain = heads.select("bucket", "path", "parent", "conv_id", "n", "shared", "start", F.explode(F.sequence("start", "shared")).alias("depth"), "least")
    chain = chain.withColumn("saving", (F.col("n") - 1) * F.when(F.col("depth") > 0, size(F.col("depth"))).otherwise(F.lit(0)))
    own = chain.groupBy("bucket").agg(F.sum("saving").alias("own"))
    tops = nodes.where("above <> ''").groupBy(F.col("above").alias("bucket")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    each = heads.select("bucket", "path").join(own, "bucket").join(tops, "bucket", "left").select("bucket", "path", "own", zero("tops").alias("tops"), zero("leaves").alias("leaves"), zero("saved").alias("saved"))
    each = each.checkpoint()
    spread = each.select("bucket", F.explode("path").alias("over"), "own", "leaves", "saved")
    itself = F.col("bucket") == F.col("over")
    sums = spread.groupBy(F.col("over").alias("bucket")).agg(F.sum("leaves").alias("leaves"), F.sum(F.col("saved") + F.when(itself, 0).otherwise(F.col("own"))).alias("below"))
    children = each.where(F.size("path") > 1).groupBy(F.get("path", F.size("path") - 2).alias("bucket")).agg(F.count("*").alias("inner"))
    known = sums.join(each.select("bucket", "tops"), "bucket").join(children, "bucket", "left").join(ended, "bucket", "left")
    deeper = Window.partitionBy("bucket").orderBy(F.col("depth").desc())
    full = chain.withColumn("chain", F.sum("saving").over(deeper)).join(known, "bucket")
    last = F.col("depth") == F.col("shared")
    return full.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("tops") + zero("inner")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("chain") + F.col("below")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NONE))).otherwise(F.lit(NONE)).alias("ends_sha256"),
    )


def oracle() -> str:
    """The same as DuckDB SQL, CRC-32 by its bits."""
    return """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY nth) AS t, list(octet_length(encode(text)) ORDER BY nth) AS s FROM turns GROUP BY conv_id),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
           lambda i: list_prepend(ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1:h], []), o.t[h + 1:]) AS t, list_concat(coalesce(b.s[1:h], []), o.s[h + 1:]) AS s
  FROM own o JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
members AS (
  SELECT conv_id, d, md5(array_to_string(t[1:d], ',')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(t[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size, d = len(t) AS last
  FROM rebuilt, unnest(range(0, len(t) + 1)) AS u(d)),
nodes AS (
  SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM members GROUP BY d, key),
children AS (SELECT d - 1 AS d, up AS key, count(*) AS c FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT m.d, m.key, count(*) FILTER (WHERE c.c IS NULL) AS leaves, sum((n.n - 1) * n.size) AS saved
  FROM nodes n LEFT JOIN children c USING (d, key) JOIN members m ON m.conv_id = n.conv_id AND m.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.c, 0) AS n_children, b.leaves AS n_leaves,
       cast(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b USING (d, key) LEFT JOIN children c USING (d, key) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.up
"""
