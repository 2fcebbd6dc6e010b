"""Media columns: Netpbm and BMP images decoded to arrays, area-resized by integral images, written
as NPY tiles with difference hashes.

Each row is handled alone. Undecodable bytes give null results; null texts count as empty, so
they become one row of 64 zero samples. Equal bytes give equal results.
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

from factloom.llm.common import set_aside, small_batches, texts, with_fields

WIDTH = 64
TILE = 32
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary PGM of 8-bit samples."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed BMP: 24 bits for (h, w, 3) RGB, else 8 bits with a grey palette."""
    h, w = samples.shape[:2]
    rgb = samples.ndim == 3
    row = (w * (3 if rgb else 1) + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * (3 if rgb else 1)] = (samples[::-1, :, ::-1] if rgb else samples[::-1]).reshape(h, -1)
    palette = b"" if rgb else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).__and__(np.array([255, 255, 255, 0], np.uint8)).tobytes()
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if rgb else 8, 0, body.size, 2835, 2835, 0 if rgb else 256, 0)
    return head + info + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray | None:
    """(h, w) or (h, w, 3) samples, 8 or 16 bits; None for what is no such image or is cut short."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(data)
        return _bmp(data) if data[:2] == b"BM" else None
    except (ValueError, IndexError, struct.error, TypeError):
        return None


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        head.append(int(m[1]))
        at = m.end()
    w, h, top = *head[:2], head[2] if len(head) > 2 else 1
    if not (w > 0 and h > 0 and 0 < top < 65536):
        raise ValueError("size")
    bands = 3 if kind in (3, 6) else 1
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", data[at:]), np.uint8)[: w * h] - 48
    elif kind < 4:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * bands], np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * bands, at + 1)
    if flat.size != w * h * bands or flat.size and int(flat.max()) > top:
        raise ValueError("samples")
    out = flat.astype(np.uint8 if top < 256 else np.uint16).reshape((h, w, 3) if bands == 3 else (h, w))
    return (1 - out) * np.uint8(255) if kind in (1, 4) else out


def _bmp(data: bytes) -> np.ndarray:
    at = struct.unpack_from("<I", data, 10)[0]
    size, w, h, planes, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or planes != 1 or packed or bits not in (8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("kind")
    row = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits != 8:
        return np.ascontiguousarray(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 256
    colors = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    grey = (colors == colors[:, :1]).all()
    return np.ascontiguousarray(colors[:, 0][rows] if grey else colors[rows])


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, h: int, w: int, rows_at_once: int = 1 << 15) -> np.ndarray:
    """Means over the h x w equal areas of a (H, W) image, as floats. Sums over areas come from the
    integral image, read between samples by bilinear weights, of which only the rows at the
    areas' edges are kept; the image is summed some rows at a time."""
    full_h, full_w = image.shape
    edge_y, edge_x = np.arange(h + 1) * full_h / h, np.arange(w + 1) * full_w / w
    y0, x0 = np.minimum(edge_y.astype(int), full_h), np.minimum(edge_x.astype(int), full_w)
    y1, x1 = np.minimum(y0 + 1, full_h), np.minimum(x0 + 1, full_w)
    need = np.unique(np.concatenate([y0, y1]))
    kept = np.zeros((len(need), full_w + 1))
    total = np.zeros(full_w)
    for at in range(0, full_h, rows_at_once):
        part = np.cumsum(image[at : at + rows_at_once], axis=0, dtype=np.float64) + total
        inside = (need > at) & (need <= at + len(part))
        kept[inside, 1:] = np.cumsum(part[need[inside] - at - 1], axis=1)
        total = part[-1]
    fy, fx = (edge_y - y0)[:, None], edge_x - x0
    rows = kept[np.searchsorted(need, y0)] * (1 - fy) + kept[np.searchsorted(need, y1)] * fy
    at_edges = rows[:, x0] * (1 - fx) + rows[:, x1] * fx
    return np.diff(np.diff(at_edges, axis=0), axis=1) / (full_h / h * full_w / w)


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 9 areas is darker than the one to its right."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def media_features(df: DataFrame, media: str, tile: int = TILE) -> DataFrame:
    """df with _height, _width, _tile (NPY bytes of a tile x tile grey image of bytes) and _dhash,
    null where the media can't be decoded."""
    small_batches(df.sparkSession, 256)
    df, give_back = set_aside(df, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(media).to_pylist():
                image = decode(data) if data else None
                if image is None:
                    out.append((None,) * 4)
                    continue
                g = grey(image if image.dtype == np.uint8 else image / 257)
                out.append((*g.shape, npy(np.rint(area_resize(g, tile, tile)).astype(np.uint8)), difference_hash(g)))
            h, w, t, d = zip(*out, strict=True) if out else ((),) * 4
            new = [pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(t, pa.binary()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "_height", "_width", "_tile", "_dhash"])

    schema = with_fields(df, "_height int, _width int, _tile binary, _dhash string")
    return give_back(df.mapInArrow(run, schema), ("_height", "_width", "_tile", "_dhash"))


def text_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _n_bytes and _media: a PGM of the text's UTF-8 bytes in rows of WIDTH samples,
    zeros appended to whole rows, one at least. The text column goes."""
    small_batches(docs.sparkSession, 256)
    docs, give_back = set_aside(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = texts(b, text)
            media = [encode_pgm(np.frombuffer(x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)), np.uint8).reshape(-1, WIDTH)) for x in body]
            keep = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in keep), pa.array(map(len, body), pa.int64()), pa.array(media, pa.binary())], names=[*(n for n, _ in keep), "_n_bytes", "_media"])

    schema = with_fields(docs, "_n_bytes long, _media binary", (text,))
    return give_back(docs.mapInArrow(run, schema), ("_n_bytes", "_media"), (text,))


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of what is read back from each document's stored form."""
    made = media_features(text_media(docs.select("doc_id", "text")), "_media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("_media").to_pylist():
                back = decode(data).tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest()))
            size, sha, crc, stored, stored_sha = zip(*rows, strict=True) if rows else ((),) * 5
            tile = [hashlib.sha256(t).hexdigest() for t in b.column("_tile").to_pylist()]
            cols = {"doc_id": b.column("doc_id"), "n_bytes": b.column("_n_bytes"), "payload_bytes": pa.array(size, pa.int64()), "payload_sha256": pa.array(sha, pa.string()), "tail_crc32": pa.array(crc, pa.int64()), "media_bytes": pa.array(stored, pa.int64()), "media_sha256": pa.array(stored_sha, pa.string()), "feature": b.column("_dhash"), "tile_sha256": pa.array(tile, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")
