"""Media columns: Netpbm and BMP images as numpy arrays, NPY tiles and hashes."""

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

from kvlake.llm.storage import Scratch, prepare_workers

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


class MediaError(ValueError):
    """Bytes that are no image of a supported kind, or are cut off."""


def _header(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` numbers of a Netpbm header, past comments; where they end."""
    found = []
    for _ in range(count):
        m = _TOKEN.match(data, at)
        if not m:
            raise MediaError("the Netpbm header is cut off")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, (rows, columns) or (rows, columns, 3).

    Bits become 0 (black) and 255 (white); other samples stay as they are.
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not a Netpbm image")
    bitmap, planes = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    (width, height, *most), at = _header(data, 2, 2 if bitmap else 3)
    top = most[0] if most else 1
    if not 0 < top < 65536 or not width or not height:
        raise MediaError("a Netpbm size or maximum is out of range")
    count, body = width * height * planes, data[at + 1 :]
    if kind == b"P4":
        row = (width + 7) // 8
        if len(body) < row * height:
            raise MediaError("the image is cut off")
        bits = np.unpackbits(np.frombuffer(body, np.uint8, row * height).reshape(height, row), axis=1)[:, :width]
        return (1 - bits) * np.uint8(255)
    if kind in (b"P5", b"P6"):
        sample = np.dtype(np.uint8 if top < 256 else ">u2")
        if len(body) < count * sample.itemsize:
            raise MediaError("the image is cut off")
        flat = np.frombuffer(body, sample, count).astype(sample.newbyteorder("="))
    else:
        body = re.sub(rb"#[^\n]*", b"", body)
        text = [c for c in body if c in b"01"] if bitmap else body.split()
        if len(text) < count:
            raise MediaError("the image is cut off")
        flat = np.array([int(chr(x)) for x in text[:count]] if bitmap else [int(x) for x in text[:count]]).astype(np.uint8 if top < 256 else np.uint16)
        flat = (1 - flat) * np.uint8(255) if bitmap else flat
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits as (rows, columns, 3) RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not a BMP image")
    start, head, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or height == 0:
        raise MediaError("a BMP of an unsupported kind")
    rows, row = abs(height), (width * depth // 8 + 3) // 4 * 4
    if len(data) < start + row * rows:
        raise MediaError("the image is cut off")
    grid = np.frombuffer(data, np.uint8, row * rows, start).reshape(rows, row)
    grid = grid[::-1] if height > 0 else grid
    if depth == 8:
        colours = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        return colours[grid[:, :width]][:, :, 2::-1]
    step = depth // 8
    return grid[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """An 8-bit grey image as binary PGM (P5)."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + np.ascontiguousarray(samples, np.uint8).tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of RGB samples; a grey image stays as it is."""
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def integral(image: np.ndarray) -> np.ndarray:
    """Sums over all samples above and left of each corner; the only copy that is made."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    inside = total[1:, 1:]
    np.cumsum(image, axis=0, dtype=np.float64, out=inside)
    np.cumsum(inside, axis=1, out=inside)
    return total


def area_resize(image: np.ndarray, height: int, width: int, total: np.ndarray | None = None) -> np.ndarray:
    """Mean over the exact area of each target cell, from an integral image.

    The integral is linear between whole rows and columns, so cells that cut
    through samples weigh them by the share they cover.
    """
    total = integral(image) if total is None else total

    def at(table: np.ndarray, points: np.ndarray) -> np.ndarray:
        low = np.minimum(points.astype(int), len(table) - 2)
        part = (points - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    edges = at(total, np.linspace(0, image.shape[0], height + 1))
    edges = at(edges.T, np.linspace(0, image.shape[1], width + 1)).T
    cells = np.diff(np.diff(edges, axis=0), axis=1)
    return cells * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray, total: np.ndarray | None = None) -> str:
    """64 bits: whether each of 8 x 9 cells is darker than the next in its row."""
    small = np.round(area_resize(grey(image), 8, 9, total), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32, total: np.ndarray | None = None) -> bytes:
    """The image resized to ``side`` x ``side`` grey bytes, in NPY format."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(grey(image), side, side, total)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def read_tile(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


#: Payloads are padded to whole blocks of 24 x 24 samples.
BLOCK, WIDTH = 576, 24


def text_image(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the padded bytes as a PGM of 24 columns."""
    raw = (text or "").encode("utf-8")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    samples = np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)
    return len(raw), encode_pgm(samples)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media column ``(id, n_bytes, media)``; a null text is stored as the empty one."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_image(x.as_py()) for x in batch.column(1)]
            columns = [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(store, f"id {source.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def media_features(media: DataFrame, tile: int = 32) -> DataFrame:
    """Decode ``(id, n_bytes, media)`` and add what its samples and bytes give.

    ``tile`` is an NPY file of the resized image, ``feature`` its 64-bit
    difference hash as 16 hex digits.  A null media value, or one that cannot be
    decoded, raises ``MediaError``.  Repeated rows each get features, ids may be
    null, other columns are ignored, and an empty table gives an empty result.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(2):
                data = stored.as_py() or b""
                image = decode(data)
                payload, total = image.tobytes(), integral(grey(image))
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                     hashlib.sha256(data).hexdigest(), difference_hash(image, total), npy_tile(image, tile, total))
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    kind = media.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary"
    return media.select("id", "n_bytes", "media").mapInArrow(read, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as an image, read the stored bytes, store features and tiles, and return these.

    One row per input row; null and empty texts are one block of padding; equal
    texts have equal values.  Ids may be null or repeat, other columns are
    ignored, and an empty table gives an empty result.
    """
    prepare_workers(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "media")
    stored = scratch.table(store_texts(docs, id_col, text_col), "media", compression="zstd")
    tiled = scratch.table(media_features(stored), "tiles", compression="zstd")
    scratch.remove("media")
    return tiled.withColumnRenamed("id", id_col)


def tile_means(tiles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, tile_mean)``: the mean sample of each stored NPY tile, read by numpy."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [float(read_tile(x.as_py()).mean()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], [id_col, "tile_mean"])

    kind = tiles.schema[id_col].dataType.simpleString()
    return tiles.select(id_col, "tile").mapInArrow(mean, f"`{id_col}` {kind}, tile_mean double")
