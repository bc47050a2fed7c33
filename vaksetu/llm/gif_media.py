"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

Texts are stored as grey-scale animations (palette entry i is the grey i, so a sample is a byte): 64 samples to a row, at most
``ROWS`` rows to a frame. The reader handles any GIF: local palettes, interlacing, all disposal methods, transparent
entries, clear codes anywhere and streams that go on after the code table is full.

Both directions work on one row at a time inside Arrow batches; memory is bounded by the largest single value.
Null text counts as empty (one row of zeros). Null media, or bytes that are no whole GIF, give no frames; reading them back gives null payload
columns. Repeated rows give repeated results; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, sliced

WIDTH = 64
ROWS = 1024
#: Hundredths of a second that a stored frame is shown.
DELAY = 4

_LITERALS = [bytes([i]) for i in range(256)]


# ------------------------------------------------------------------ LZW
def _widths(n: int, least: int) -> np.ndarray:
    """Bits of the 1st to nth code after a clear code, for a minimum code size."""
    out = np.full(n, 12, np.int64)
    for size in range(11, least, -1):
        out[: max(0, (1 << size) - (1 << least) - 1)] = size
    return out


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """Variable-width LZW as GIF has it: a clear code first and whenever the table is full, an end code last."""
    clear, codes, starts = 1 << least, [], [0]
    put, rest = codes.append, iter(data)
    put(clear)
    prefix = next(rest, None)
    while prefix is not None:
        table: dict[int, int] = {}
        get, new, full = table.get, clear + 2, False
        for b in rest:
            code = get(key := prefix << 8 | b)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = b
            if new == 4096:  # what is left starts anew
                full = True
                break
            table[key] = new
            new += 1
        if not full:
            put(prefix)
            break
        starts.append(len(codes))
        put(clear)
    put(clear + 1)
    width = np.empty(len(codes), np.int64)
    for a, z in zip(starts, [*starts[1:], len(codes)], strict=True):
        width[a + 1 : z] = _widths(z - a - 1, least)
    width[0] = least + 1
    for a in starts[1:]:  # a clear code has the width that was due
        width[a] = 12
    return _pack(np.array(codes, np.int64), width)


def _pack(codes: np.ndarray, width: np.ndarray) -> bytes:
    off = np.cumsum(width) - width
    size = int(off[-1] + width[-1] + 7) // 8
    shifted, byte = codes << (off & 7), off >> 3
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount(byte + k, (shifted >> (8 * k)) & 255, minlength=size + 3)[: size + 3]
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, least: int) -> bytes:
    """Whole code stream to samples; raises ValueError at a code that cannot occur."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.zeros(len(data) + 4, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    words = raw[:-3].astype(np.int64) | raw[1:-2].astype(np.int64) << 8 | raw[2:-1].astype(np.int64) << 16
    bits, at, out = 8 * len(data), 0, []
    base = [*_LITERALS[:clear], b"", b""]
    step = 4096
    while True:
        width = _widths(step, least)
        off = at + np.cumsum(width) - width
        fits = int(np.searchsorted(off + width, bits, "right"))
        codes = (words[off[:fits] >> 3] >> (off[:fits] & 7)) & ((1 << width[:fits]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and fits == step:
            step *= 2  # a full table may be used on
            continue
        run = codes[: stop[0]].tolist() if len(stop) else codes.tolist()
        if run:
            table = base[:]
            add, put = table.append, out.append
            if run[0] >= clear:
                raise ValueError("code before its definition")
            last = table[run[0]]
            put(last)
            for code in run[1 : 4096 - clear - 1]:
                try:
                    now = table[code]
                except IndexError:
                    if code != len(table):
                        raise ValueError("code before its definition") from None
                    now = last + last[:1]
                add(last + now[:1])
                put(now)
                last = now
            for code in run[4096 - clear - 1 :]:
                put(table[code])
        if not len(stop) or codes[stop[0]] == end:
            return b"".join(out)
        at = int(off[stop[0]] + width[stop[0]])
        step = 4096


# ------------------------------------------------------------------ files
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as an animation of grey frames."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    indices: bytes
    canvas: np.ndarray  # height x width x RGBA of the whole screen as shown


def _interlaced(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF as they are shown, one after the other; raises ValueError if the bytes are no whole GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
        at += size
    canvas = np.zeros((h, w, 4), np.uint8)
    disposal, delay, clear_index = 0, 0, None

    def sub(at: int) -> tuple[bytes, int]:
        parts = []
        while True:
            n = data[at]
            if not n:
                return b"".join(parts), at + 1
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1

    try:
        while True:
            kind = data[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at + 1]
                body, at = sub(at + 2)
                if label == 0xF9:
                    packed, cs, index = struct.unpack("<BHB", body[:4])
                    disposal, delay, clear_index = packed >> 2 & 7, cs * 10, index if packed & 1 else None
                continue
            if kind != 0x2C:
                raise ValueError("unknown block")
            left, top, fw, fh, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                size = 3 << ((packed & 7) + 1)
                palette = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3)
                at += size
            least = data[at]
            stream, at = sub(at + 1)
            samples = lzw_decode(stream, least)
            if len(samples) < fw * fh or palette is None:
                raise ValueError("frame is cut short")
            pixels = np.frombuffer(samples, np.uint8)[: fw * fh].reshape(fh, fw)
            if packed & 0x40:
                whole = np.empty_like(pixels)
                whole[_interlaced(fh)] = pixels
                pixels = whole
            before = canvas.copy() if disposal == 3 else None
            region = canvas[top : top + fh, left : left + fw]
            seen = pixels[: region.shape[0], : region.shape[1]]
            shown = np.ones(seen.shape, bool) if clear_index is None else seen != clear_index
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[:, 3] = palette, 255
            region[shown] = full[seen[shown]]
            yield Frame(delay, left, top, fw, fh, disposal, pixels.tobytes(), canvas.copy())
            if disposal == 2:
                region[:] = 0
            elif disposal == 3:
                canvas = before
            disposal, delay, clear_index = 0, 0, None
    except (IndexError, struct.error):
        raise ValueError("file is cut short") from None


def histogram(rgba: np.ndarray, bins: int = 8) -> list[list[int]]:
    """Counts of red, green and blue in ``bins`` equal ranges over the opaque pixels."""
    solid = rgba[rgba[..., 3] > 0]
    return [np.bincount(solid[:, c] * bins // 256 if bins == 256 else solid[:, c] // (256 // bins), minlength=bins).tolist() for c in range(3)]


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


# ------------------------------------------------------------------ columns
def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            raws = [x.as_buffer().to_pybytes() if x.as_buffer() else b"" for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([encode_gif(pad(r)) for r in raws], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """(doc_id, frame, start_ms, delay_ms, left, top, width, height, disposal, rgba, red, green, blue) for each frame of column ``media``."""
    names = ["doc_id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "rgba", "red", "green", "blue"]
    schema = pa.schema([(n, pa.int64() if n == "doc_id" else pa.binary() if n == "rgba" else pa.list_(pa.int32()) if n in ("red", "green", "blue") else pa.int32()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, start = [], 0
                try:
                    for i, f in enumerate(decode_gif(value.as_py() or b"")):
                        rows.append([key, i, start, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.canvas.tobytes(), *histogram(f.canvas)])
                        start += f.delay_ms
                except ValueError:
                    continue
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, frame int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, rgba binary, red array<int>, green array<int>, blue array<int>")


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, media, n_frames, shown_ms, grey): payloads as the composed frames show them, with an 8-bin histogram of all frames."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("n_frames", pa.int32()), ("shown_ms", pa.int64()), ("grey", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            rows = []
            for value in batch.column(2):
                parts, ms, grey = [], 0, np.zeros(8, np.int64)
                try:
                    for f in decode_gif(value.as_py() or b""):
                        seen = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0]
                        parts.append(seen.tobytes())
                        grey += np.bincount((seen >> 5).ravel(), minlength=8)
                        ms += f.delay_ms
                    rows.append((b"".join(parts), len(parts), ms, grey.tolist()))
                except ValueError:
                    rows.append((None, None, None, None))
            payload, n, ms, grey = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(payload, pa.binary()), batch.column(2), pa.array(n, pa.int32()), pa.array(ms, pa.int64()), pa.array(grey, schema.field("grey").type)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload binary, media binary, n_frames int, shown_ms long, grey array<long>")


def digests(payload: bytes, media: bytes) -> tuple[str, int, str]:
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(media).hexdigest()
