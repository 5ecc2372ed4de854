"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized, tiled and hashed.

Decoders: PBM, PGM and PPM, plain and raw, 8 bits a sample, and uncompressed 8- or 24-bit BMP. ``area_resize`` averages
over the exact source area of each target pixel by differences of an integral image. A tile is written in NPY format,
and its difference hash compares neighbouring pixels.

Defined results: null or undecodable media (unknown formats, broken headers, sides that aren't positive, missing samples,
samples or colours out of range) give nulls and the reason in ``error``; null texts are empty, and an empty payload is padded to
one row; texts of any length are stored whole; an empty table gives an empty result; repeated rows are worked out each; other
columns are ignored, whatever their names. One image is decoded in memory.
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

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_ppm(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _sides(width: int, height: int, held: int, needed: int) -> None:
    if width < 1 or height < 1:
        raise ValueError("sides must be positive")
    if needed > held:
        raise ValueError("too few samples")


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("broken header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = (*fields, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    n = w * h * channels
    if kind == b"P4":
        stride = (w + 7) // 8
        _sides(w, h, len(data) - at - 1, stride * h)
        x = 1 - np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, -1), axis=1)[:, :w]
    elif kind in (b"P5", b"P6"):
        _sides(w, h, len(data) - at - 1, n)
        x = np.frombuffer(data, np.uint8, n, at + 1)
    else:
        _sides(w, h, len(data) - at, n)
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = list(b"".join(body.split())[:n]) if kind == b"P1" else body.split()[:n]
        x = np.array([v - ord("0") for v in found] if kind == b"P1" else [int(v) for v in found], np.int64)
        _sides(w, h, x.size, n)
    if x.min() < 0 or x.max() > top:
        raise ValueError("sample out of range")
    x = 1 - x if kind == b"P1" else x
    x = x if top == 255 else np.round(x.astype(float) * 255 / top)
    return x.astype(np.uint8).reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) of uint8."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or bits not in (8, 24):
        raise ValueError("only plain 8- and 24-bit BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    _sides(w, abs(h), len(data) - start, stride * abs(h))
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    palette = data[14 + head : start]
    colours = np.frombuffer(palette, np.uint8, len(palette) // 4 * 4).reshape(-1, 4)[:, 2::-1]
    if rows[:, :w].max() >= len(colours):
        raise ValueError("colour out of range")
    return colours[rows[:, :w]]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    return pixels[:, :, 0] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.114


def area_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of ``x`` over the source area of each target pixel; edges inside a pixel count by their share."""
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    total[1:, 1:] = x.cumsum(0).cumsum(1)

    def between(t: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        low = np.minimum(cuts.astype(np.int64), t.shape[0] - 2)
        return t[low] + (t[low + 1] - t[low]) * (cuts - low)[:, None]

    rows, cols = np.linspace(0, x.shape[0], height + 1), np.linspace(0, x.shape[1], width + 1)
    at = between(between(total, rows).T, cols).T
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums / (np.diff(rows)[:, None] * np.diff(cols)[None, :])


def npy_tile(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(x), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """16 hex digits from an 8 x 9 tile: a bit is 1 where the right neighbour is brighter."""
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def tiles(media: DataFrame, height: int = 8, width: int = 9, media_col: str = "media") -> DataFrame:
    """(doc_id, width, height, tile, dhash, error): a narrow map; ``tile`` holds NPY bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [tile_of(x.as_py(), height, width) for x in b.column("media")]
            w, h, t, d, e = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.binary()), pa.array(d, pa.string()), pa.array(e, pa.string())], names=["doc_id", "width", "height", "tile", "dhash", "error"])

    return media.select(F.col("doc_id").cast("long"), F.col(media_col).alias("media")).mapInArrow(run, "doc_id long, width int, height int, tile binary, dhash string, error string")


def tile_of(data: bytes | None, height: int, width: int) -> tuple:
    if data is None:
        return None, None, None, None, "null"
    try:
        pixels = decode(data)
        tile = npy_tile(area_resize(grey(pixels), height, width))
    except (ValueError, struct.error, OverflowError, MemoryError) as e:
        return None, None, None, None, str(e) or type(e).__name__
    return pixels.shape[1], pixels.shape[0], tile, difference_hash(np.load(io.BytesIO(tile))), None


def text_payload(text: str | None, unit: int = 192) -> tuple[bytes, int]:
    """UTF-8 bytes padded by spaces to a positive multiple of ``unit``, and their number before padding."""
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(1, -(-len(raw) // unit)) * unit - len(raw)), len(raw)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts as 64 pixels wide PPM images, read back: sizes, digests, and the feature of the stored image.

    ``feature``: difference hash and CRC-32 of the NPY tile. Returns doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            rows = []
            for x in b.column("text"):
                payload, n = text_payload(x.as_py())
                stored = encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, 64, 3))
                pixels = decode(stored)
                back = pixels.tobytes()
                tile = npy_tile(area_resize(grey(pixels), 8, 9))
                feature = f"{difference_hash(np.load(io.BytesIO(tile)))}:{zlib.crc32(tile):08x}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
