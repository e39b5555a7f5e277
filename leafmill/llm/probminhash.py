"""Operator 6, near duplicates: ProbMinHash over weighted word shingles, banding, verification, classes.

* Signature: every shingle of weight w (how often it occurs) sends arrivals of a Poisson process of rate w to
  random registers; a register keeps the shingle that arrives first. Two documents agree in a register with
  probability J_P, the probability Jaccard similarity of their weights. A document's process ends as soon as the next
  arrivals come later than everything its registers hold.
* Bands of registers make candidates: each document is paired with the leader of its bucket, the member that sits in the
  largest buckets all told.
* Pairs whose registers put them more than four standard deviations below the threshold are dropped. Of the others the texts
  are fetched and the exact J_P computed; 0.8 or more links them. Linked texts form classes.
* Buckets that still hold several classes are settled exactly: their members' registers are compared in blocks, and pairs of different
  classes that may reach the threshold are verified as well.

Equal texts are one node throughout and cost one signature comparison.

Defined results: null and wordless texts are near-duplicates only of the same bytes (null counts as empty). Texts under five words are
one shingle of all their words. A document without near-duplicates is its own class. Rows that share a doc_id count as one
document. A null doc_id counts as a
negative id made of the text's hash; other ids must be integers or cast to them. Ties go to the least id. An empty
table gives an empty result. Other columns play no part. A very long text is held whole by one task, at about 64 bytes a
byte while it is cut to shingles; blocks of a bucket are bounded in rows and in bytes of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm._batches import map_rows, small_enough, steps, with_checkpoints
from leafmill.llm.components import components
from leafmill.llm.shingles import mix, shingles

_STEP, _TO_UNIT = np.uint64(0x9E3779B97F4A7C15), 2.0**-53


@dataclass(frozen=True)
class NearParams:
    """With 25 bands of 5 registers a pair of similarity 0.8 meets in some bucket with probability 0.99995."""

    bands: int = 25
    rows: int = 5
    threshold: float = 0.8
    #: Members of one bucket that are compared in one block, and bytes of their texts.
    block: int = 1024
    block_bytes: int = 8 << 20
    #: Nodes up to which a list of them is broadcast to pick their rows; beyond, the rows are shuffled.
    broadcast_nodes: int = 1_000_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> int:
        """Equal registers without which a pair is more than four standard deviations below the threshold."""
        m, t = self.registers, self.threshold
        return int(m * (t - 4 * (t * (1 - t) / m) ** 0.5))


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers, each the hash of the shingle that arrived first; 0 for texts without shingles.

    All texts run together, a round for each shingle's next arrival. A shingle drops out when its arrival is later than
    all registers of its text: nothing that it sends later can matter.
    """
    first = np.full(n * m, np.inf)
    who = np.zeros(n * m, np.uint64)
    time = np.zeros(len(value))
    state = value.copy()
    rate = weight.astype(float)
    while len(value):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * _TO_UNIT) / rate
        latest = first.reshape(n, m).max(1)
        on = time < latest[owner]
        owner, value, state, rate, time, draw = owner[on], value[on], state[on], rate[on], time[on], draw[on]
        at = owner * m + (mix(draw ^ _STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = value[won]
    return who.reshape(n, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i] / a[1].sum(), b[1][j] / b[1].sum()
    only_a, only_b = 1 - x.sum(), 1 - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    # for a shared shingle s: the sum over all d of max(x_d / x_s, y_d / y_s); x_d wins where d's ratio is at least s's
    more_x = only_a + np.cumsum(x[::-1])[::-1]
    less_y = only_b + np.concatenate([[0.0], np.cumsum(y)[:-1]])
    return float(min(1.0, (1 / (more_x / x + less_y / y)).sum()))


def _signed(text: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, digest, n_bytes, registers (16 bits of each); registers are null where there is no shingle."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            owner, value, weight = shingles(texts)
            who = signatures(owner, value, weight, len(texts), params.registers)
            some = np.bincount(owner, minlength=len(texts)) > 0
            return {
                "doc_id": part.column("doc_id"),
                "digest": [hashlib.md5(t).digest() for t in texts],
                "n_bytes": [len(t) for t in texts],
                "registers": [r.tobytes() if ok else None for r, ok in zip((who & np.uint64(0xFFFF)).astype("<u2"), some.tolist())],
            }

        return work

    return map_rows(text, "text", "doc_id long, digest binary, n_bytes long, registers binary", make)


def _members(by_text: DataFrame, params: NearParams) -> DataFrame:
    """band, key and node, one row for each band of a text's registers; a key is the hash of the band and its registers."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda b: F.struct(b.cast("byte").alias("band"), F.xxhash64(F.substring("registers", b * 2 * params.rows + 1, F.lit(2 * params.rows)), b).alias("key")))
    return by_text.where("registers IS NOT NULL").select("node", F.inline(bands))


def _plausible(pairs: DataFrame, by_text: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose registers let them reach the threshold within four standard deviations; no text is read."""
    sign = by_text.where("registers IS NOT NULL")
    joined = pairs.join(sign.select(F.col("node").alias("a"), F.col("registers").alias("sign_a")), "a").join(sign.select(F.col("node").alias("b"), F.col("registers").alias("sign_b")), "b")

    def make():
        def work(part: pa.RecordBatch) -> dict:
            one, other = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, params.registers) for c in ("sign_a", "sign_b"))
            keep = pa.array(np.flatnonzero((one == other).sum(1) >= params.least), pa.int64())
            return {c: part.column(c).take(keep) for c in ("a", "b")}

        return work

    return map_rows(joined.select("a", "b", "sign_a", "sign_b"), ("sign_a", "sign_b"), "a long, b long", make)


def _verified(pairs: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold. ``texts``: node, text."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        def work(part: pa.RecordBatch) -> dict:
            texts = part.column("text_a").cast(pa.binary()).to_pylist() + part.column("text_b").cast(pa.binary()).to_pylist()
            index: dict[bytes, int] = {}
            number = [index.setdefault(t or b"", len(index)) for t in texts]
            owner, value, weight = shingles(list(index))
            at = np.searchsorted(owner, np.arange(len(index) + 1))
            bag = [(value[i:j], weight[i:j]) for i, j in zip(at[:-1], at[1:])]
            n = part.num_rows
            keep = [k for k in range(n) if similarity(bag[number[k]], bag[number[n + k]]) >= params.threshold - 1e-9]
            return {c: part.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")}

        return work

    return map_rows(joined.select("a", "b", "text_a", "text_b"), ("text_a", "text_b"), "a long, b long", make)


def _meetings(members: DataFrame, params: NearParams) -> DataFrame:
    """The members of open buckets dealt to groups that are compared: key, with_main, i, j, and the members' own columns.

    ``members``: key, band, node, class, registers, n_bytes. A bucket's largest class is dealt over blocks of at most
    ``block`` members and ``block_bytes`` of text or so, and so are all its other members; a group is one block of the
    others with one of the largest class, or two blocks of the others. Members of one class are never compared, so a
    large class costs no more than its size times the number of blocks of others. No text is dealt.
    """
    sizes = members.groupBy("key", "class").agg(F.count("*").alias("size"), F.sum("n_bytes").alias("bytes"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "class", "bytes")).alias("main"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"))
    blocks = lambda size, held: F.ceil(F.greatest(size / params.block, held / params.block_bytes, F.lit(1))).cast("int")
    main = main.select("key", F.col("main.class").alias("main"), blocks(F.col("main.size"), F.col("main.bytes")).alias("p"), blocks(F.col("size") - F.col("main.size"), F.col("bytes") - F.col("main.bytes")).alias("q"))
    dealt = members.join(main, "key").withColumn("in_main", F.col("class") == F.col("main")).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    to_others = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: F.when(F.col("in_main"), F.struct(F.lit(True).alias("with_main"), k.alias("i"), F.col("own").alias("j"))).otherwise(F.struct(F.lit(False).alias("with_main"), F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"))))
    to_main = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: F.struct(F.lit(True).alias("with_main"), F.col("own").alias("i"), k.alias("j")))
    return dealt.withColumn("at", F.explode(F.when(F.col("in_main"), to_others).otherwise(F.concat(to_others, to_main)))).select("key", "at.*", "band", "own", "node", "class", "registers")


#: What names a group of members that are compared.
GROUP = ("key", "with_main", "i", "j")


class Group:
    """One group: its members' columns, and which of them may be alike by their registers."""

    def __init__(self, table: pa.Table, params: NearParams):
        self.own, self.node, self.kind = (table.column(c).to_numpy() for c in ("own", "node", "class"))
        self.sign = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(len(self.node), params.registers)
        self.band, self.params = table.column("band")[0].as_py(), params
        self.apart = not table.column("with_main")[0].as_py() and table.column("i")[0].as_py() != table.column("j")[0].as_py()
        self.later = np.arange(len(self.node))

    def partners(self, k: int, now: np.ndarray) -> np.ndarray:
        """The members after k of another class than k's in ``now`` that may reach the threshold, unless an earlier bucket has both."""
        near = (now != now[k]) & (self.later > k)
        if self.apart:
            near &= self.own != self.own[k]
        at = np.flatnonzero(near)
        same = self.sign[at] == self.sign[k]
        good = same.sum(1) >= self.params.least
        at, same = at[good], same[good]
        if self.band and len(at):
            at = at[~same[:, : self.band * self.params.rows].reshape(len(at), self.band, self.params.rows).all(2).any(1)]
        return at


def _across(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], params: NearParams) -> DataFrame:
    """Links between texts of different classes in one bucket, by exact verification; enough of them to join what belongs together.

    First the groups of ``_meetings`` are screened by registers alone; only members with a partner that may be alike go
    on. Their texts (``texts_of``: node, text of some nodes) are fetched and the pairs verified. A pair is looked at in
    the first bucket that it shares. A group emits a spanning forest of its links, fewer rows than it has members,
    however many pairs are alike.
    """
    meets = _meetings(members, params)
    kind = meets.schema

    def screened(table: pa.Table) -> pa.Table:
        group = Group(table, params)
        on = np.zeros(len(group.node), bool)
        for k in range(len(group.node)):
            at = group.partners(k, group.kind)
            on[at] = True
            on[k] |= len(at) > 0
        return table.filter(pa.array(on))

    def links(table: pa.Table) -> pa.Table:
        group = Group(table, params)
        root = {k: k for k in group.kind.tolist()}

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        bags, out = Bags(table.column("text")), []
        now = group.kind.copy()  # the class each member belongs to by now
        for k in range(len(group.node)):
            at = group.partners(k, now)
            joined = False
            for j in bags.alike(k, at, params.threshold) if len(at) else ():
                a, b = top(group.kind[k]), top(group.kind[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((max(group.node[k], group.node[j]), min(group.node[k], group.node[j])))
                    joined = True
            if joined:
                now = np.array([top(x) for x in group.kind.tolist()])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    held = meets.groupBy(*GROUP).applyInArrow(screened, kind).checkpoint()
    return held.join(texts_of(held.select("node").distinct()), "node").groupBy(*GROUP).applyInArrow(links, "a long, b long").distinct()


class Bags:
    """The weighted shingles of some texts, and one text's similarity to many at once."""

    def __init__(self, texts: pa.ChunkedArray):
        """Texts are cut to shingles a few megabytes at a time, so the working memory is that of one step and 20 bytes a shingle."""
        found = [(k, v, w) for part in steps(pa.table({"text": texts}).to_batches(), "text") for k, v, w in [self.cut(part)]]
        self.n = np.concatenate([k for k, _, _ in found])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.value, self.weight = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        _, self.index = np.unique(self.value, return_inverse=True)
        self.index = self.index.astype(np.int32)
        value = self.value
        self.flat = np.array([self.weight[a:b].max(initial=1) == 1 for a, b in zip(self.at[:-1], self.at[1:])])
        self.mark = np.zeros(len(value) + 1, bool)

    @staticmethod
    def cut(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
        owner, value, weight = shingles(texts)
        return np.bincount(owner, minlength=len(texts)), value, weight.astype(np.int32)

    def bag(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.value[self.at[k] : self.at[k + 1]], self.weight[self.at[k] : self.at[k + 1]]

    def alike(self, k: int, others: np.ndarray, threshold: float) -> list[int]:
        """Those of ``others`` whose similarity to k reaches the threshold.

        Where no shingle repeats, it is the Jaccard similarity and follows from the number of shared shingles. Else that
        number bounds what pairs can reach: no similarity exceeds the weight of the shared shingles on either side.
        """
        own = self.index[self.at[k] : self.at[k + 1]]
        self.mark[own] = True
        out = []
        for j in others.tolist():
            shared = int(self.mark[self.index[self.at[j] : self.at[j + 1]]].sum())
            if self.flat[k] and self.flat[j]:
                good = shared >= (threshold - 1e-9) * (len(own) + self.n[j] - shared)
            else:
                good = shared > 0 and similarity(self.bag(k), self.bag(j)) >= threshold - 1e-9
            if good:
                out.append(j)
        self.mark[own] = False
        return out


def stand_in(digest: Column) -> Column:
    """The id of a document without one: its text's hash with the sign bit set."""
    return F.xxhash64(digest).bitwiseOR(F.lit(-(1 << 63)))


def key_of(documents: DataFrame) -> Column:
    return F.coalesce(documents["doc_id"].cast("long"), stand_in(F.unhex(F.md5(F.coalesce(documents["text"], F.lit(""))))))


def near_classes(documents: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """doc_id, class_id, n_copies (rows of the same text), n_links (links of the text to other texts that
    the search for classes verified; pairs inside a class already found are not all tried), kept.

    One row for each row of ``documents``; class_id is the least doc_id of the class; kept marks that document.
    """
    return _classes(documents, params).drop("digest")


def _classes(documents: DataFrame, params: NearParams) -> DataFrame:
    with_checkpoints(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    node = F.coalesce(F.min("doc_id"), stand_in(F.col("digest"))).alias("node")
    by_text = _signed(source, params).groupBy("digest").agg(node, F.count("*").alias("n_copies"), F.first("n_bytes").alias("n_bytes"), F.first("registers").alias("registers")).checkpoint()
    member = _members(by_text, params)
    sizes = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = _with_leaders(member.join(sizes, "key").checkpoint()).checkpoint()

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node, text (one) of the wanted nodes; materialised, so that a hot node's joins can be split."""
        picked = _picked(source.select(key_of(source).alias("node"), "text"), wanted.checkpoint(), "left_semi", params)
        return picked.groupBy("node").agg(F.min("text").alias("text")).checkpoint()

    first = shared.where("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()
    first = _plausible(first, by_text, params).distinct().checkpoint()
    texts = texts_of(first.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = _verified(first, texts, params).distinct().checkpoint()
    labels = components(links)

    classed = shared.join(labels.withColumnRenamed("class", "label"), "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("class"))
    open_keys = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    rest = classed.join(open_keys, "key", "left_semi")
    extra = _across(rest.join(by_text.where("registers IS NOT NULL").select("node", "registers", "n_bytes"), "node").checkpoint(), texts_of, params).checkpoint()
    if not extra.isEmpty():
        links = links.unionAll(extra)
        labels = components(links)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    facts = by_text.select("digest", "node", "n_copies").join(labels, "node", "left").join(ends, "node", "left")
    facts = facts.select("digest", F.coalesce("class", "node").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = source.select("doc_id", digest_of(source).alias("digest"))
    return rows.join(facts, "digest").select("doc_id", "class_id", "n_copies", "n_links", (F.coalesce("doc_id", stand_in(F.col("digest"))) == F.col("class_id")).alias("kept"), "digest")


def digest_of(documents: DataFrame) -> Column:
    return F.unhex(F.md5(F.coalesce(documents["text"], F.lit(""))))


def _picked(rows: DataFrame, nodes: DataFrame, how: str, params: NearParams) -> DataFrame:
    """Join texts with a table of nodes that is broadcast only after its rows were counted; a larger one costs a shuffle of the texts."""
    return rows.join(F.broadcast(nodes) if small_enough(nodes, params.broadcast_nodes) else nodes, nodes.columns, how)


def _with_leaders(shared: DataFrame) -> DataFrame:
    """key, band, node and the bucket's leader. ``shared``: key, band, node, size.

    The leader is the member that sits in the largest buckets all told: in a group of copies made from one text that is
    the text itself or what is next to it, to which most members are alike.
    """
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    scored = shared.select("key", "node").join(weight, "node")
    leaders = scored.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("rank"))).alias("l")).select("key", (-F.col("l.rank")).alias("leader"))
    return shared.drop("size").join(leaders, "key")


def keep_one(documents: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """The rows of ``documents`` that stay: of each class the document of the least id, once."""
    node, digest = "__near_node", "__near_digest"
    keyed = documents.withColumns({node: key_of(documents), digest: digest_of(documents)})
    classes = _classes(documents, params).select(F.coalesce("doc_id", stand_in(F.col("digest"))).alias(node), F.col("digest").alias(digest), "kept").checkpoint()
    left = _picked(keyed, classes.where("NOT kept").select(node, digest).distinct().checkpoint(), "left_anti", params)
    repeated = classes.where("kept").groupBy(node).count().where("count > 1").select(node).checkpoint()
    first = Window.partitionBy(node).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    again = _picked(left, repeated, "left_semi", params).withColumn("__near_n", F.row_number().over(first)).where("__near_n = 1")
    return _picked(left, repeated, "left_anti", params).select(documents.columns).unionByName(again.select(documents.columns))
