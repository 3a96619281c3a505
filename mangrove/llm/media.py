"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``decode_gif`` reads any GIF87a/89a: global and local palettes, interlaced images, transparent indices, disposal
methods 0 to 3, deferred clear codes.  ``encode_gif`` stores samples as full frames of a grey palette, so the
samples come back from the composed pictures.  Payloads are cut into frames of FRAME_WIDTH * FRAME_ROWS
samples; the last frame is lower.

Code widths follow from a code's place after the last clear code, so both directions pack and unpack bits by
array; only the string table runs code by code.

Cases: null or empty text gives one padded block of 576 bytes; equal texts give equal media; damaged media
raise ValueError; an empty table gives an empty result; extra columns are ignored.  One document at a time is
held in memory besides its batch.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

BLOCK, PAD = 576, 255
FRAME_WIDTH, FRAME_ROWS, DELAY_CS = 576, 64, 10
BINS = 16
_CODES = 4096


def _widths(min_size: int) -> np.ndarray:
    """Width of each code by its place after a clear code."""
    first = (1 << min_size) + 2  # the first free table entry
    entry = first + np.arange(_CODES) - 1  # the last entry the decoder has made when it reads this code
    return np.minimum(12, np.maximum(min_size + 1, np.floor(np.log2(np.maximum(entry, 1))).astype(np.int64) + 1))


_WIDTHS = {n: _widths(n) for n in range(2, 9)}
#: Which of twelve bits a code of each width uses.
_LANES = np.arange(12) < np.arange(13)[:, None]


def _segment_widths(n: int, min_size: int) -> np.ndarray:
    w = _WIDTHS[min_size]
    return w[:n] if n <= len(w) else np.concatenate([w, np.full(n - len(w), 12)])


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """GIF code stream of ``data``; the table is cleared when full."""
    clear = 1 << min_size
    first, codes, lengths = clear + 2, [], []
    if data:
        table: dict[int, int] = {}
        get, add, free, at = table.get, codes.append, first, 0
        w = data[0]
        for c in data[1:]:
            k = w << 8 | c
            x = get(k)
            if x is not None:
                w = x
                continue
            add(w)
            if free < _CODES:
                table[k] = free
                free += 1
            else:
                add(clear)
                table.clear()
                free = first
                lengths.append(len(codes) - at)
                at = len(codes)
            w = c
        add(w)
    else:
        at = 0
    codes.append(clear + 1)
    lengths.append(len(codes) - at)
    values = np.array([clear, *codes], dtype=np.int64)
    widths = np.concatenate([[min_size + 1], *(_segment_widths(n, min_size) for n in lengths)])
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, count=12, bitorder="little")
    return np.packbits(bits[_LANES[widths]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_size: int) -> bytes:
    """Samples of a GIF code stream."""
    clear = 1 << min_size
    padded = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, total, ahead = 0, 8 * len(stream), _CODES
    table, prev, place = base[:], b"", 0
    while True:
        widths = _segment_widths(place + ahead, min_size)[place:]
        starts = at + np.concatenate([[0], np.cumsum(widths)[:-1]])
        starts = starts[starts + widths <= total]
        if not len(starts):
            raise ValueError("code stream ends without an end code")
        byte = starts >> 3
        raw = padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16
        widths = widths[: len(starts)]
        codes = raw >> (starts & 7) & ((1 << widths) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        todo = codes[:n].tolist()
        if todo and not prev:  # the first code after a clear code makes no entry
            if todo[0] >= clear:
                raise ValueError("code before its entry")
            prev = base[todo[0]]
            out.append(prev)
            del todo[0]
        size, add, enter = len(table), out.append, table.append
        for c in todo:
            if c < size:
                e = table[c]
            elif c == size:
                e = prev + prev[:1]
            else:
                raise ValueError("code before its entry")
            add(e)
            if size < _CODES:
                enter(prev + e[:1])
                size += 1
            prev = e
        if n == len(codes):  # a full table without a clear code: go on where this stopped
            at, place = int(starts[-1] + widths[-1]), place + n
            continue
        if codes[n] == clear + 1:
            return b"".join(out)
        at, table, prev, place = int(starts[n] + widths[n]), base[:], b"", 0


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(samples: bytes, width: int = FRAME_WIDTH, rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of grey frames that holds ``samples`` (a positive multiple of ``width``)."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill rows")
    u16 = lambda v: v.to_bytes(2, "little")
    height = min(rows, len(samples) // width)
    parts = [b"GIF89a", u16(width), u16(height), b"\xf7\x00\x00", _GREY]
    for at in range(0, len(samples), width * rows):
        frame = samples[at : at + width * rows]
        parts += [b"\x21\xf9\x04\x04", u16(delay_cs), b"\0\0"]  # disposal 1: leave in place
        parts += [b"\x2c\0\0\0\0", u16(width), u16(len(frame) // width), b"\0\x08", _blocks(lzw_encode(frame))]
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """One shown picture: what the canvas holds (RGBA in four bytes a pixel) and where the frame drew.  The canvas
    is drawn over when the next frame is taken."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int

    @property
    def rgba(self) -> np.ndarray:
        return self.canvas.view(np.uint8).reshape(*self.canvas.shape, 4)

    @property
    def region(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, bins: int = BINS) -> np.ndarray:
        """Counts of red, green and blue values of visible pixels in ``bins`` equal ranges: shape (3, bins)."""
        seen = self.rgba[self.rgba[..., 3] > 0]
        return np.stack([np.bincount(seen[:, k].astype(np.int64) * bins >> 8, minlength=bins) for k in range(3)])


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 2 << (packed & 7)
    if at + 3 * n > len(data):
        raise ValueError("palette cut short")
    colours = np.zeros((256, 4), dtype=np.uint8)
    colours[:n, :3] = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    colours[:, 3] = 255
    return colours.view("<u4").ravel(), at + 3 * n


def decode_gif(data: bytes):
    """Yields the shown frames of a GIF in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    u16 = lambda i: int.from_bytes(data[i : i + 2], "little")
    width, height, packed, at = u16(6), u16(8), data[10], 13
    shared = None
    if packed & 0x80:
        shared, at = _palette(data, at, packed)
    canvas = np.zeros((height, width), dtype="<u4")
    delay, disposal, transparent = 0, 0, -1

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else -1
            at = after
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, w, h, packed = u16(at + 1), u16(at + 3), u16(at + 5), u16(at + 7), data[at + 9]
        at += 10
        colours = shared
        if packed & 0x80:
            colours, at = _palette(data, at, packed)
        if colours is None:
            raise ValueError("no palette")
        stream, after = blocks(at + 1)
        indices = np.frombuffer(lzw_decode(stream, data[at]), dtype=np.uint8)
        at = after
        if len(indices) < w * h:
            raise ValueError("too few samples")
        indices = indices[: w * h].reshape(h, w)
        if packed & 0x40:  # four passes of rows
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = np.empty_like(indices)
            rows[order] = indices
            indices = rows
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[top : top + h, left : left + w]
        inside = indices[: spot.shape[0], : spot.shape[1]]
        if transparent >= 0:
            drawn = inside != transparent
            spot[drawn] = colours[inside[drawn]]
        else:
            spot[...] = colours[inside]
        yield Frame(canvas, left, top, w, h, delay, disposal)
        if disposal == 2:
            spot[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its UTF-8 filled up with PAD to a positive multiple of BLOCK)."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes([PAD]) * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def read_samples(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """(samples, summed red histogram of the drawn regions, frames) from a GIF of grey frames."""
    parts, histogram, frames = [], np.zeros(BINS, dtype=np.int64), 0
    for frame in decode_gif(media):
        red = frame.region.astype(np.uint8)  # the lowest byte
        parts.append(red.tobytes())
        histogram += np.bincount(red.ravel() >> 4, minlength=BINS)
        frames += 1
    return b"".join(parts), histogram, frames


@tidy
def _store(batches):
    for batch in batches:
        texts = batch.column(1)
        for at in range(0, batch.num_rows, 256):
            ids = batch.column(0).slice(at, 256)
            stored = [payload_of(t.as_py()) for t in texts.slice(at, 256)]
            media = pa.array([encode_gif(p) for _, p in stored], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for n, _ in stored], pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text as a GIF."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


@tidy
def _frames(batches):
    names = ["doc_id", "frame_no", "start_cs", "delay_cs", "width", "height", "pixels", "histogram_red", "histogram_green", "histogram_blue"]
    for batch in batches:
        for doc, media in zip(batch.column("doc_id"), batch.column("media")):
            rows, start = [], 0
            for k, f in enumerate(decode_gif(media.as_py())):
                rows.append([doc.as_py(), k, start, f.delay_cs, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), *f.histogram().tolist()])
                start += f.delay_cs
            if rows:
                ints, lists = pa.int64(), pa.list_(pa.int64())
                types = [ints] * 6 + [pa.binary()] + [lists] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def read_frames(media: DataFrame) -> DataFrame:
    """Timed frames of (doc_id, media): number, start and delay in hundredths of a second, RGBA pixels of the
    composed canvas, colour histograms."""
    schema = "doc_id long, frame_no long, start_cs long, delay_cs long, width long, height long, pixels binary, histogram_red array<long>, histogram_green array<long>, histogram_blue array<long>"
    return media.select("doc_id", "media").mapInArrow(_frames, schema)


@tidy
def _digest(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]
    for batch in batches:
        rows = []
        for doc, n, media in zip(*batch.columns):
            data = media.as_py()
            samples, histogram, frames = read_samples(data)
            share = ",".join(f"{x / len(samples):.6f}" for x in histogram.tolist())
            rows.append((doc.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), share, frames))
        if rows:
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def op9_query(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long"
    return store(docs).mapInArrow(_digest, schema)
