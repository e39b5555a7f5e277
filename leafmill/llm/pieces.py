"""Operator 5, SentencePiece encoding and decoding: exact N-best segmentation over the piece lattice.

The score of a segmentation is the sum of its pieces' scores in the model. Forward Viterbi scores of the
lattice serve as exact heuristics for a backward A* search, which therefore yields segmentations best first.

No piece of the vocabulary holds a blank after another character, nor a character that has no piece of its own such as a
line end. So a text's lattice is a chain of independent lattices ("units": blanks and the word after them), and the
text's N best are the N best combinations of the units' bests. Only the N - 1 units with the smallest gap between their best and
second best can differ from their best there; A* runs for these alone. The gap comes from forward and backward
Viterbi scores: the second best is the best path through a piece that the best path lacks. A vocabulary with
pieces across blanks makes the whole text one unit, which changes speed and nothing else.

A character without a piece costs 10 more than the least piece score and is written as byte pieces (or as
the unknown piece where the model has no byte pieces), as the library does. Among equal
scores the longer last piece wins; the result is the same on every run. A unit of any length is held at under 80 bytes a character:
scores and best nodes by place, and as many hypotheses as segmentations are wanted.

Defined results: a null text counts as empty and has no pieces; repeated rows get the same result; an empty table gives
an empty result. ``round_trip`` tells whether decoding gives the text back; it is false for texts that hold
the model's own blank mark U+2581 (which decodes to a blank) or characters the model cannot write. Other columns play no part.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import insort
from functools import cache
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm._batches import map_rows

#: Units that a worker remembers in each of two generations, about 25 MB each, beside those of one step; fewer of many characters.
REMEMBERED = 80_000
#: Searched units that a worker remembers.
SEARCHED = 12_500
#: Units up to this length go through numpy together, as many as keep its arrays at so many cells; longer ones one at a time.
TOGETHER_CHARS, TOGETHER_CELLS = 48, 150_000
#: Odd multiplier of the rolling hash by which numpy finds pieces.
MULTIPLIER = 0x9E3779B97F4A7C15


INFINITE = float("inf")


class Best(NamedTuple):
    """Ids as int32 bytes, score, and how far the second best falls behind (infinitely where there is none)."""

    ids: bytes
    score: float
    gap: float


class PieceModel:
    """Pieces, ids and scores of a SentencePiece model file, and the lattice searches over them."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda x: int(x) if float(x).is_integer() else float(x)  # noqa: E731  integers add up exactly
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = []
        self.surface: list[bytes] = []
        self.unknown = library.unk_id()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes.append(i)
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.surface.append(" ⁇ ".encode() if library.is_unknown(i) else b"")
            else:
                self.pieces[piece.replace("▁", " ")] = i, whole(library.get_score(i))
                self.surface.append(piece.replace("▁", " ").encode())
        self.longest = max(map(len, self.pieces), default=1)
        self.reach: dict[str, int] = {}  # of each character the longest piece that starts with it
        for p in self.pieces:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0) - 10
        apart = not any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces)
        self.units = re.compile(r" *[^ \n]+|\n| +" if apart else r"(?s).+").findall
        self._index()
        self.young: dict[str, tuple] = {}  # fields as of ``Best``
        self.young_chars = 0
        self.old: dict[str, tuple] = {}
        self.searched: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _index(self) -> None:
        """The pieces by rolling hash, sorted, for ``best_many``; ``slots`` tells where each value of the leading bits begins."""
        keyed = sorted((self._hash(p), i, s) for p, (i, s) in self.pieces.items())
        self.hashes = np.array([k for k, _, _ in keyed] + [0xFFFFFFFFFFFFFFFF], np.uint64)
        if len(np.unique(self.hashes)) <= len(keyed):
            raise ValueError("two pieces share a hash")
        self.hash_ids = np.array([i for _, i, _ in keyed] + [-1], np.int32)
        self.hash_scores = np.array([s for _, _, s in keyed] + [-np.inf], float)
        bits = len(keyed).bit_length() + 3
        self.slot_shift = np.uint64(64 - bits)
        slot = (self.hashes[:-1] >> self.slot_shift).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange(1 << bits)).astype(np.int32)
        self.crowd = int(np.bincount(slot, minlength=1).max())

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * MULTIPLIER + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 29)) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF

    def prepared(self, text: str) -> str:
        return " " + text.replace("▁", " ") if text else ""

    def forward(self, unit: str) -> tuple[array, array, array]:
        """Forward Viterbi scores, and the best node's start and id, by end. Id -1: a character without a piece."""
        n, get, reach, unknown = len(unit), self.pieces.get, self.reach.get, self.unknown_score
        score, start, ids = row("d", 0.0, n), row("i", -1, n), row("i", 0, n)
        for s in range(n):
            here = score[s]
            for e in range(s + 1, min(n, s + reach(unit[s], 1)) + 1):
                if found := get(unit[s:e]):
                    i, gain = found
                elif e == s + 1:
                    i, gain = -1, unknown
                else:
                    continue
                if start[e] < 0 or here + gain > score[e]:
                    score[e], start[e], ids[e] = here + gain, s, i
        return score, start, ids

    def written(self, unit: str, starts: array, ids: array) -> bytes:
        """Ids of nodes, last node first, as int32 bytes in order; a character without a piece becomes byte pieces."""
        if -1 in ids:
            fill = lambda c: [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if len(self.bytes) == 256 else [self.unknown]
            return array("i", [x for s, i in zip(reversed(starts), reversed(ids)) for x in ([i] if i >= 0 else fill(unit[s]))]).tobytes()
        return ids[::-1].tobytes()

    def path(self, unit: str, start: array, ids: array, turns: list[tuple[int, int, int]]) -> bytes:
        """The segmentation that follows the best nodes back from the end but for its ``turns`` (end, start, id)."""
        at, starts, out = len(unit), array("i"), array("i")
        for e, s, i in [*turns, (0, 0, 0)]:
            while at > e:
                starts.append(start[at])
                out.append(ids[at])
                at = start[at]
            if e:
                starts.append(s)
                out.append(i)
                at = s
        return self.written(unit, starts, out)

    def best(self, unit: str) -> Best:
        """The best segmentation, and how far the second best falls behind."""
        score, start, ids = self.forward(unit)
        n, get, reach = len(unit), self.pieces.get, self.reach.get
        on, at = row("i", 0, n), n  # where the best path's node from here ends
        while at:
            on[start[at]], at = at, start[at]
        behind, through = row("d", 0.0, n), -INFINITE
        for s in range(n - 1, -1, -1):
            most, here, path = -INFINITE, score[s], on[s]
            for e in range(s + 1, min(n, s + reach(unit[s], 1)) + 1):
                if found := get(unit[s:e]):
                    rest = found[1] + behind[e]
                elif e == s + 1:
                    rest = self.unknown_score + behind[e]
                else:
                    continue
                if rest > most:
                    most = rest
                if e != path and here + rest > through:
                    through = here + rest
            behind[s] = most
        return Best(self.path(unit, start, ids, []), score[n], score[n] - through)

    def search(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """Up to ``n`` segmentations as (score, ids), best first: A* from the end, guided by forward Viterbi scores.

        The heuristic is exact: a hypothesis promises the score of its best completion, and no two share a segmentation. So only
        as many hypotheses are kept as segmentations are wanted, and the one that is taken is completed at once by the
        best nodes, each other node that ends on this way being a hypothesis of its own. Of equal promise the first found goes first.
        """
        score, start, ids = self.forward(unit)
        get, reach = self.pieces.get, self.longest
        kept = [(-score[-1], 0, len(unit), 0.0, None)]
        out, order = [], 0
        while kept and len(out) < n:
            promise, _, at, done, turns = kept.pop(0)
            back, t = [], turns
            while t:
                back.append(t[0])
                t = t[1]
            out.append((-promise, self.path(unit, start, ids, back[::-1])))
            room = n - len(out)
            del kept[room:]
            while at and room:
                gain = 0.0
                for s in range(at - 1, max(0, at - reach) - 1, -1):
                    if found := get(unit[s:at]):
                        i, g = found
                    elif s == at - 1:
                        i, g = -1, self.unknown_score
                    else:
                        continue
                    if s == start[at]:
                        gain = g
                        continue
                    mark = -(done + g + score[s])
                    if len(kept) < room or mark < kept[-1][0]:
                        order += 1
                        insort(kept, (mark, order, s, done + g, ((at, s, i), turns)), key=itemgetter(0, 1))
                        del kept[room:]
                done, at = done + gain, start[at]
        return out

    def best_many(self, units: list[str]) -> list[Best]:
        """``best`` of many units."""
        return list(map(Best._make, self._bests(units)))

    def _bests(self, units: list[str]) -> list[tuple]:
        """``best_many`` as plain tuples, which the garbage collector leaves alone; units of one length are searched together by numpy."""
        out: list[tuple | None] = [None] * len(units)
        for n, places in groupby(sorted(range(len(units)), key=list(map(len, units)).__getitem__), lambda k: len(units[k])):
            together = max(16, TOGETHER_CELLS // (n * (n + 1)))
            while some := list(islice(places, together)):
                found = self._best_of_length(n, [units[k] for k in some]) if n <= TOGETHER_CHARS and len(some) > 3 else [None] * len(some)
                for k, b in zip(some, found):
                    out[k] = b or tuple(self.best(units[k]))
        return out

    def _best_of_length(self, n: int, units: list[str]) -> list[tuple | None]:
        """None for a unit with a character that has no piece.

        Nodes lie by length, the longest first, and by end: ``score[longest - length, end]``.
        """
        m, longest = len(units), min(n, self.longest)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        score = np.full((longest, n + 1, m), -np.inf)
        place = np.empty((longest, n + 1, m), np.int32)
        h = np.zeros((n, m), np.uint64)
        for length in range(1, longest + 1):
            h = h[: n - length + 1] * np.uint64(MULTIPLIER) + points[length - 1 :]
            at, hit = self._find((h ^ (h >> np.uint64(29))) * np.uint64(MULTIPLIER))
            place[longest - length, length:] = at
            np.copyto(score[longest - length, length:], self.hash_scores[at], where=hit)
        whole = np.isfinite(score[longest - 1, 1:]).all(0)
        forward, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        forward[0] = 0
        for e in range(1, n + 1):
            first = max(0, e - longest)
            totals = forward[first:e] + score[longest - e + first :, e]
            back[e] = first + totals.argmax(0)
            forward[e] = totals.max(0)
        behind = np.full((n + 1, m), -np.inf)
        behind[n] = 0
        for s in range(n - 1, -1, -1):
            ends = np.arange(s + 1, min(n, s + longest) + 1)
            behind[s] = (behind[ends] + score[longest - (ends - s), ends]).max(0)
        behind[:, ~whole] = -np.inf
        path, length, rows, at = np.full((m, n), -1, "<i4"), np.zeros(m, np.int64), np.arange(m), np.full(m, n)
        for step in range(1, n + 1):
            s = back[at, rows]
            node = longest - (at - s), at, rows
            path[rows, n - step] = self.hash_ids[place[node]]
            score[node] = -np.inf
            length[rows] = step
            rows, at = rows[s > 0], s[s > 0]
            if not len(rows):
                break
        through = np.full(m, -np.inf)
        for k in range(1, longest + 1):
            np.maximum(through, (forward[: n - k + 1] + score[longest - k, k:] + behind[k:]).max(0), out=through)
        gap = np.where(whole, forward[n], 0) - through
        raw, size = path.tobytes(), 4 * n
        ids = [raw[stop - 4 * k : stop] for stop, k in zip(range(size, size * m + 1, size), length.tolist())]
        out: list[tuple | None] = list(zip(ids, forward[n].tolist(), gap.tolist()))
        for k in np.flatnonzero(~whole).tolist():
            out[k] = None
        return out

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``hashes`` each key would stand, and whether it does."""
        at = self.slots[keys >> self.slot_shift]
        for _ in range(self.crowd - 1):
            at += self.hashes[at] < keys
        return at, self.hashes[at] == keys

    def remember(self, lists: list[list[str]]) -> None:
        """Make the bests of all these units known."""
        if len(self.young) >= REMEMBERED or self.young_chars >= REMEMBERED * TOGETHER_CHARS:
            self.old, self.young, self.young_chars = self.young, {}, 0
        new = set().union(*lists) - self.young.keys()
        again = new & self.old.keys()
        todo = list(new - again)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        self.young.update(zip(todo, self._bests(todo)))
        self.young_chars += sum(map(len, new))

    def ways(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        if (found := self.searched.get((unit, n))) is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            found = self.search(unit, n)
            if len(unit) <= TOGETHER_CHARS:
                self.searched[unit, n] = found
        return found

    def encode(self, text: str, n: int) -> tuple[bytes, list[tuple[float, int, list[tuple[int, int, list[int]]]]]]:
        """Ids of the best segmentation, and the ``n`` best as (score, pieces, changes against the best).

        A change is (first piece, pieces replaced, ids instead), in order of place.
        """
        return self.encode_units(self.units(self.prepared(text)), n)

    def encode_units(self, units: list[str], n: int, known: bool = False) -> tuple[bytes, list]:
        if not units:
            return b"", []
        if not known:
            self.remember([units])
        every, scores, gaps = zip(*map(self.young.__getitem__, units))
        ids = b"".join(every)
        total = sum(scores)
        close = [x for x in heapq.nsmallest(n - 1, zip(gaps, range(len(units)))) if x[0] < INFINITE]
        sums: list[tuple[float, tuple]] = [(0, ())]
        for _, k in close:
            ways = [(scores[k], every[k])] + [w for w in self.ways(units[k], n) if w[1] != every[k]][: n - 1]
            sums = sorted(((lost + scores[k] - score, chosen + (((k, w),) if j else ())) for lost, chosen in sums for j, (score, w) in enumerate(ways)), key=lambda x: x[0])[:n]
        starts, done, length = {}, 0, 0
        for k in sorted({k for _, chosen in sums for k, _ in chosen}):
            length += sum(map(len, every[done:k]))
            starts[k], done = length // 4, k
        out = []
        for lost, chosen in sums:
            changes = [difference(starts[k], every[k], w) if len(units[k]) > TOGETHER_CHARS else (starts[k], len(every[k]) // 4, array("i", w).tolist()) for k, w in sorted(chosen)]
            out.append((float(total - lost), len(ids) // 4 + sum(len(w) - old for _, old, w in changes), changes))
        return ids, out

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, without the blank that encoding put before the text."""
        out = b"".join([self.surface[i] for i in ids])
        return out[1:] if out[:1] == b" " else out


def row(kind: str, value: float, n: int) -> list | array:
    """n + 1 numbers: a list, which is faster, for a short unit, an array, which is smaller, for a long one."""
    return [value] * (n + 1) if n <= TOGETHER_CHARS else array(kind, [value]) * (n + 1)


def difference(first: int, old: bytes, new: bytes) -> tuple[int, int, list[int]]:
    """(first piece, pieces replaced, ids instead) without what the two unit's segmentations share at their ends."""
    a, b = np.frombuffer(old, "<i4"), np.frombuffer(new, "<i4")

    def shared(x: np.ndarray, y: np.ndarray) -> int:
        n = min(len(x), len(y))
        unlike = x[:n] != y[:n]
        return int(unlike.argmax()) if unlike.any() else n

    head = shared(a, b)
    tail = shared(a[head:][::-1], b[head:][::-1])
    return first + head, len(a) - head - tail, b[head : len(b) - tail].tolist()


@cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(documents: DataFrame, path: str, n_best: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_pieces, score, ids, nbest and round_trip for each row; one pass, no shuffle.

    ``nbest`` lists the best segmentations, the best first, each by its changes against ``ids``.
    """

    def make():
        model = load(path)

        def work(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            units = [model.units(model.prepared(t)) for t in texts]
            model.remember(units)
            got = [model.encode_units(u, n_best, True) for u in units]
            flat = np.frombuffer(b"".join([g[0] for g in got]), "<i4")
            ends = np.concatenate([[0], np.cumsum([len(g[0]) // 4 for g in got])]).astype(np.int32)
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            return {
                "doc_id": part.column("doc_id"),
                "n_bytes": [len(r) for r in raw],
                "n_pieces": np.diff(ends),
                "score": [g[1][0][0] if g[1] else 0.0 for g in got],
                "ids": pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())),
                "nbest": [g[1] for g in got],
                "round_trip": [model.decode(flat[a:b].tolist()) == r for a, b, r in zip(ends[:-1], ends[1:], raw)],
            }

        return work

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_rows(
        documents.select("doc_id", "text"),
        "text",
        f"doc_id {kind}, n_bytes long, n_pieces int, score double, ids array<int>, nbest array<struct<score: double, n_pieces: int, changes: array<struct<first: int, replaced: int, ids: array<int>>>>>, round_trip boolean",
        make,
    )


def decode_pieces(pieces: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of ``ids``; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""

    def make():
        model = load(path)

        def work(part: pa.RecordBatch) -> dict:
            return {"doc_id": part.column("doc_id"), "text": [None if x is None else model.decode(x).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]}

        return work

    from pyspark.sql import functions as F

    slim = pieces.select("doc_id", "ids", F.lit("").alias("size"))
    return map_rows(slim, "size", f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, text string", make)
