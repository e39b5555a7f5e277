"""Operator 9, token counts: exact counts by a tokenizer library, huge texts by overlap resynchronisation.

A text up to ``chunk`` units (UTF-8 bytes for a .model, code points for a .json) is encoded whole. A longer one is covered by windows of ``chunk``
units that overlap; each is encoded once, with offsets. Two neighbours are spliced at a boundary inside their overlap
that both encodings have and that is proven stable: what stands left of it cannot change the tokens right of it, nor the
other way round. Between the first and the last such boundary of an overlap both encodings must agree.

* SentencePiece BPE: no piece of the vocabulary holds a blank after another character, so no merge crosses a place
  where a blank follows another character. Such a place is a token boundary in any text around it. Offsets follow from the pieces' lengths,
  whose sum must be the window's. A model whose normaliser changes texts, or without byte pieces, is not proven: its texts are encoded whole.
* Byte-level BPE (.json): words are cut off from left to right without looking back, so once two encodings both start a
  word at a place, they agree from there on. The left window's last word can still depend on what follows, so the place
  must lie before its last token.

If an overlap holds no such boundary, or the encodings disagree, the overlap is doubled; once it would reach back to the
last splice, the left window is doubled instead, at last to the whole rest of the text.

Defined results: a null text counts as empty and has 0 tokens; special strings inside texts are handled as the
library's default; repeated rows and null ids get the same count each; an empty table gives an empty result; other
columns play no part. A text is held whole by one task; what the windows need besides is bounded unless the text lacks
stable boundaries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm._batches import map_rows


@dataclass(frozen=True)
class TokenParams:
    chunk: int = 4_000
    overlap: int = 256
    limit: int = 4096


class SentencePieceCounter:
    """Counts and offsets of a SentencePiece BPE model; texts are UTF-8 bytes."""

    #: What a normaliser may change: runs of blanks, blanks at the ends, compatibility forms, case, composition.
    PROBE = "  A  b\u00a0\ufb01\u2460\uff21e\u0301\u00e9\u3000\tx\n y  "

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in ids]
        self.length = np.array([1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in zip(ids, pieces)])
        plain = sentencepiece.SentencePieceNormalizer(model_file=path).normalize(self.PROBE) in ("▁" + self.PROBE.replace(" ", "▁"), " " + self.PROBE)
        self.provable = plain and sum(map(self.model.is_byte, ids)) == 256 and not any("▁" in p.lstrip("▁") for p in pieces)

    def units(self, text: str) -> bytes:
        """The model's own blank mark stands for a blank."""
        return text.replace("▁", " ").encode()

    def count(self, data: bytes) -> int:
        return len(self.model.encode(data.decode(), num_threads=1))

    def aligned(self, data: bytes, place: int) -> int:
        """The start of the character at a place."""
        while 0 < place < len(data) and data[place] & 0xC0 == 0x80:
            place -= 1
        return place

    def starts(self, data: bytes, begin: int, end: int) -> np.ndarray | None:
        """Where each token of a window starts; None if the pieces' lengths don't add up to it. The library's own blank
        stands for the window's first one."""
        part = data[begin + (begin > 0 and data[begin] == 32) : end]
        ends = np.cumsum(self.length[self.model.encode(part.decode(), num_threads=1)])
        if not len(ends) or ends[-1] != len(part) + 1:
            return None
        return np.concatenate([[begin], ends[:-1] + end - len(part) - 1])

    def stable(self, data: bytes, places: np.ndarray, last: int) -> np.ndarray:
        around = np.frombuffer(data, np.uint8)
        return places[(around[places] == 32) & (around[places - 1] != 32)]


class WordBpeCounter:
    """Counts and offsets of a byte-level BPE in a tokenizers .json file; texts are code points."""

    provable = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def units(self, text: str) -> str:
        return text

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)

    def aligned(self, text: str, place: int) -> int:
        return place

    def starts(self, text: str, begin: int, end: int) -> np.ndarray | None:
        """A blank that the library leaves out of a token's span belongs to that token."""
        found, before = [], 0
        for a, b in self.model.encode(text[begin:end], add_special_tokens=False).offsets:
            found.append(begin + min(a, before if before < a else a))
            before = max(before, b)
        return np.array(found, np.int64) if found else None

    def stable(self, text: str, places: np.ndarray, last: int) -> np.ndarray:
        """Blanks between letters, where a word surely starts, with another token after it and no special string near."""
        sure = lambda p: p < min(last, len(text) - 1) and text[p] == " " and text[p - 1].isalpha() and text[p + 1].isalpha() and "<|" not in text[max(0, p - 40) : p + 40]
        return np.array([p for p in places.tolist() if sure(p)], np.int64)


def load(path: str) -> SentencePieceCounter | WordBpeCounter:
    return WordBpeCounter(path) if path.endswith(".json") else SentencePieceCounter(path)


def splice(data, counter, left: np.ndarray, right: np.ndarray, begin: int, end: int) -> int | None:
    """The last stable boundary of two windows that overlap in [begin, end); None if there is none or they disagree."""
    both = np.intersect1d(left[(left > begin) & (left < end)], right)
    sure = counter.stable(data, both, int(left[-1]))
    if not len(sure):
        return None
    one, other = (x[(x >= sure[0]) & (x <= sure[-1])] for x in (left, right))
    return int(sure[-1]) if np.array_equal(one, other) else None


def count_spliced(text: str, counter, params: TokenParams) -> int:
    """The token count of a text, by windows that are spliced at stable boundaries."""
    data = counter.units(text)
    n, cut, total = len(data), 0, 0  # ``total`` tokens left of ``cut``
    begin, end = 0, counter.aligned(data, min(n, params.chunk))
    if end == n or not counter.provable:
        return counter.count(data)
    left, overlap = counter.starts(data, begin, end), params.overlap
    while left is not None and end < n:
        start = counter.aligned(data, end - overlap)
        if start <= max(cut, begin):  # no room for more overlap: the left window grows
            end, overlap = counter.aligned(data, min(n, 2 * end - begin)), params.overlap
            left = counter.starts(data, begin, end)
            continue
        stop = counter.aligned(data, min(n, max(start + params.chunk, end + params.overlap)))
        right = counter.starts(data, start, stop)
        if right is None:
            break
        if (at := splice(data, counter, left, right, max(cut, start), end)) is None:
            overlap *= 2
            continue
        total, cut = total + int(((left >= cut) & (left < at)).sum()), at
        left, begin, end, overlap = right, start, stop, params.overlap
    return counter.count(data) if left is None or end < n else total + int((left >= cut).sum())


def count_tokens(documents: DataFrame, path: str, params: TokenParams = TokenParams(), make_counter: Callable = load) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``documents``; one pass, no shuffle."""

    def make():
        counter = make_counter(path)

        def work(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = [count_spliced(t, counter, params) for t in texts]
            return {"doc_id": part.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > params.limit for n in counts]}

        return work

    return map_rows(documents.select("doc_id", "text"), "text", f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", make)
