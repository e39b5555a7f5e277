"""Operator 3, media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

``decode`` reads PBM, PGM, PPM (P1 to P6, 8 and 16 bit) and PAM, and uncompressed BMP of 1, 4, 8, 24 and 32 bit, and of 16 and 32 bit with masks. ``area_resize``
averages over exact (fractional) areas with one integral image, built in strips. ``difference_hash`` compares neighbours of the
9 x 8 reduction. ``tiles`` cuts an image to NPY files of bounded size.

Defined results: null bytes give null columns from ``decode_media``; bytes that are no known image, are cut short or
claim more than ``MAX_PIXELS`` samples give an ``error`` text and null features, never a failed job; repeated rows get the same
results; an empty table gives an empty result. Extra input columns are kept by ``decode_media`` unless they bear the name
of an output, which then replaces them. ``text_media`` takes a null text as empty, keeps null ids and holds one text about eight times
over (stored form, decoded image, tiles and payload), whatever its length.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm._batches import map_rows

#: Samples of one image beyond which it is refused; a header may claim any size.
MAX_PIXELS = 1 << 28


class MediaError(ValueError):
    """Bytes that are no image of a known kind."""


_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def _fields(data: bytes, start: int, n: int) -> tuple[list[int], int]:
    """``n`` unsigned header fields, and where the last one ends; comments may stand between them."""
    out = []
    for _ in range(n):
        m = _FIELD.match(data, start)
        if not m or not m[1].isdigit() or len(m[1]) > 10:
            raise MediaError("bad Netpbm header")
        out.append(int(m[1]))
        start = m.end()
    return out, start


def _samples(data: bytes, start: int, shape: tuple[int, ...], top: int, most: int) -> np.ndarray:
    kind, n = (np.dtype(">u2") if top > 255 else np.dtype("u1")), int(np.prod(shape, dtype=object))
    if n > most:
        raise MediaError("image too large")
    if len(data) - start < n * kind.itemsize:
        raise MediaError("image data cut short")
    return np.frombuffer(data, kind, n, start).reshape(shape)


def _netpbm(data: bytes, most: int) -> np.ndarray:
    kind = data[1] - 48
    if kind == 7:
        end = data.find(b"ENDHDR\n")
        head = dict(x.split(None, 1) for x in data[3:end].decode("ascii", "replace").splitlines() if len(x.split(None, 1)) == 2 and x[0] != "#") if end > 0 else {}
        try:
            w, h, d, top = (int(head[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        except (KeyError, ValueError) as e:
            raise MediaError("bad PAM header") from e
        if min(w, h, d) < 1 or not 0 < top < 65536:
            raise MediaError("bad PAM header")
        image = _samples(data, end + 7, (h, w, d), top, most)
        return image[:, :, 0] if d == 1 else image
    values, at = _fields(data, 2, 2 if kind in (1, 4) else 3)
    w, h = values[:2]
    top = 1 if kind in (1, 4) else values[2]
    if min(w, h) < 1 or not 0 < top < 65536:
        raise MediaError("bad Netpbm header")
    if w * h > most:
        raise MediaError("image too large")
    deep = 3 if kind in (3, 6) else 1
    shape = (h, w, 3) if deep == 3 else (h, w)
    if kind == 4:
        rows = _samples(data, at + 1, (h, (w + 7) // 8), 255, most)
        return 1 - np.unpackbits(rows, axis=1)[:, :w]
    if kind in (5, 6):
        return _samples(data, at + 1, shape, top, most)
    body = re.sub(rb"#[^\n\r]*", b" ", data[at:])
    parts = [bytes([c]) for c in body if c in b"01"] if kind == 1 else body.split()
    if len(parts) < w * h * deep:
        raise MediaError("image data cut short")
    try:
        plain = np.array([int(x) for x in parts[: w * h * deep]], np.uint16 if top > 255 else np.uint8).reshape(shape)
    except (ValueError, OverflowError) as e:
        raise MediaError("bad Netpbm sample") from e
    return 1 - plain if kind == 1 else plain


def _masked(data: bytes, raw: np.ndarray, head: int, bits: int) -> np.ndarray:
    """Red, green and blue of a BMP with bit masks, which stand after the 40 bytes of the plain header; each is scaled to 0 to 255."""
    if len(data) < 66:
        raise MediaError("image data cut short")
    pixels = np.ascontiguousarray(raw[:, : raw.shape[1] // (bits // 8) * (bits // 8)]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
    w = struct.unpack_from("<i", data, 18)[0]
    out = np.empty((len(raw), w, 3), np.uint8)
    for k, mask in enumerate(struct.unpack_from("<III", data, 54)):
        low = (mask & -mask).bit_length() - 1
        top = mask >> low if mask else 0
        if not mask or top & (top + 1) or mask >> bits:
            raise MediaError("bad BMP masks")
        out[:, :, k] = (((pixels[:, :w] & mask) >> low) * 255 + top // 2) // top
    return out


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("image data cut short")
    offset, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if head < 40 or packed not in (0, 3) or bits not in ((16, 32) if packed else (1, 4, 8, 24, 32)) or w < 1 or h == 0:
        raise MediaError("unsupported BMP")
    if not (66 if packed else 14 + head) <= offset <= len(data):
        raise MediaError("bad BMP header")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if w * rows > MAX_PIXELS:
        raise MediaError("image too large")
    if len(data) - offset < stride * rows:
        raise MediaError("image data cut short")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if h > 0:
        raw = raw[::-1]
    if packed == 3:
        return _masked(data, raw, head, bits)
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    index = np.unpackbits(raw, axis=1)[:, :w] if bits == 1 else np.stack([raw >> 4, raw & 15], 2).reshape(rows, -1)[:, :w] if bits == 4 else raw[:, :w]
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, min(colours * 4, max(0, offset - 14 - head)) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    if not len(palette) or index.max() >= len(palette):
        raise MediaError("bad BMP palette")
    return palette[index]


def decode(data: bytes, most: int | None = None) -> np.ndarray:
    """Height x width, or height x width x channels, of a Netpbm or BMP file; a Netpbm of up to ``most`` samples, else ``MAX_PIXELS``."""
    if len(data) >= 3 and data[:1] == b"P" and 49 <= data[1] <= 55 and data[2:3].isspace():
        return _netpbm(data, MAX_PIXELS if most is None else most)
    if data[:2] == b"BM":
        return _bmp(data)
    raise MediaError("neither Netpbm nor BMP")


def encode_pgm(samples: bytes, width: int) -> bytes:
    """8-bit PGM of ``width`` columns; the samples fill whole rows."""
    if not samples or len(samples) % width:
        raise MediaError("samples don't fill whole rows")
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma of a colour image; one channel stays as it is."""
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[:, :, 0]
    r, g, b = (image[:, :, i].astype(np.int64) for i in range(3))
    return (299 * r + 587 * g + 114 * b) // 1000


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 1 << 18) -> np.ndarray:
    """Mean over each target cell's exact area, from an integral image whose edges are interpolated.

    Rows are integrated along x in strips of about ``strip`` samples, and only the columns at cell edges are kept and
    integrated along y, so that the integral takes 8 * (width + 1) bytes a row whatever the image's width.
    """
    h, w = image.shape

    def edges(n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(cells + 1) * n / cells
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, low + 1, at - low

    y0, y1, fy = edges(h, height)
    x0, x1, fx = edges(w, width)
    total = np.zeros((h + 1, width + 1))
    some = max(1, strip // w)
    for y in range(0, h, some):
        row = np.zeros((len(image[y : y + some]), w + 1), np.int64)
        np.cumsum(image[y : y + some], axis=1, dtype=np.int64, out=row[:, 1:])
        total[y + 1 : y + 1 + some] = row[:, x0] * (1 - fx) + row[:, x1] * fx
    np.cumsum(total, axis=0, out=total)
    corner = total[y0] * (1 - fy)[:, None] + total[y1] * fy[:, None]
    return np.diff(np.diff(corner, axis=0), axis=1) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each cell of the 8 x 9 reduction is darker than its right neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(np.round(small[:, 1:], 6) > np.round(small[:, :-1], 6)).tobytes().hex()


def tiles(image: np.ndarray, size: int = 256) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of each tile of at most ``size`` x ``size`` samples."""
    for y in range(0, image.shape[0], size):
        for x in range(0, image.shape[1], size):
            out = io.BytesIO()
            np.save(out, np.ascontiguousarray(image[y : y + size, x : x + size]), allow_pickle=False)
            yield y // size, x // size, out.getvalue()


def from_tiles(parts: Iterator[tuple[int, int, bytes]]) -> np.ndarray:
    """The image that was cut to tiles."""
    rows: dict[int, list[np.ndarray]] = {}
    for y, _, npy in parts:
        rows.setdefault(y, []).append(np.load(io.BytesIO(npy), allow_pickle=False))
    return np.concatenate([r[0] if len(r) == 1 else np.concatenate(r, axis=1) for r in rows.values()])


def text_row(data: bytes, unit: int) -> tuple:
    """The features of one text: its PGM is decoded whatever its length, cut to NPY tiles and put together from them."""
    stored = encode_pgm(data + bytes(-len(data) % unit or (0 if data else unit)), unit)
    image = from_tiles(tiles(decode(stored, len(stored))))
    payload = image.tobytes()
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{image.shape[1]}x{image.shape[0]}:{difference_hash(image)}"


def decode_media(media: DataFrame, column: str = "content", tile: int | None = None) -> DataFrame:
    """Adds width, height, channels, dhash and error; with ``tile``, one row for each tile (tile_row, tile_column, npy) instead."""
    one = "width int, height int, channels int, dhash string, error string"
    many = "array<struct<tile_row:int, tile_column:int, npy:binary>>"

    def row(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, []
        try:
            image = decode(data)
        except MediaError as e:
            return None, None, None, None, str(e), []
        return image.shape[1], image.shape[0], 1 if image.ndim == 2 else image.shape[2], difference_hash(image), None, list(tiles(image, tile)) if tile else []

    names = ["width", "height", "channels", "dhash", "error"] + ["tiles"] * bool(tile)
    kind = one + (f", tiles {many}" if tile else "")
    kept = [c for c in media.columns if c not in (*names, "tile_row", "tile_column", "npy")]
    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in kept) + ", " + kind

    def make():
        def work(part: pa.RecordBatch) -> dict:
            got = [row(x) for x in part.column(column).to_pylist()]
            return {c: part.column(c) for c in kept} | {n: [g[i] for g in got] for i, n in enumerate(names)}

        return work

    out = map_rows(media, column, schema, make)
    return out.select("*", F.inline_outer("tiles")).drop("tiles") if tile else out


def text_media(documents: DataFrame, unit: int = 64) -> DataFrame:
    """Each text's UTF-8 bytes, padded by zeros to whole rows, stored as a PGM image and read back through NPY tiles."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in part.column("text").cast(pa.binary()).to_pylist():
                for k, v in zip(out, text_row(data or b"", unit)):
                    out[k].append(v)
            return {"doc_id": part.column("doc_id")} | out

        return work

    return map_rows(documents.select("doc_id", "text"), "text", f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", make)
