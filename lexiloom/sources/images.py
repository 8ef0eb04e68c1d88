"""Images as pixels: a PNG reader and writer over binary columns, and a grid of regions.

PNG of 8 bits a sample, not interlaced, in grey, RGB, palette or with alpha (which is left out), with any row
filter.  Other formats and damaged files give an error beside the image, never end the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("jpg", "png", "tif", "tiff", "webp", "bmp", "gif")
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of each colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image at most: what a declared size may make a task allocate.
MOST_PIXELS = 1 << 27
#: Bytes of texts, files or pixels that are worked on at a time, or one row if that has more: what bounds a task's memory.
PIECE = 1 << 22


def image_format(path: Column) -> Column:
    """Lower-case format by extension, jpeg as jpg; null for what is no image."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    ext = F.when(ext == "jpeg", "jpg").otherwise(ext)
    return F.when(ext.isin(*FORMATS), ext)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc_ = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc_), a, np.where(pb <= pc_, b, c))


def write_png(pixels: np.ndarray, filters: tuple[int, ...] | None = None) -> bytes:
    """An RGB array (h, w, 3) as PNG; rows take the filters in turn, or of none, left and up that of least sum."""
    h, w, _ = pixels.shape
    raw = pixels.reshape(h, w * 3).astype(np.int16)
    left = np.pad(raw, ((0, 0), (3, 0)))[:, :-3]
    up = np.pad(raw, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(left, ((1, 0), (0, 0)))[:-1]
    guesses = [lambda: raw * 0, lambda: left, lambda: up, lambda: (left + up) // 2, lambda: _paeth(left, up, corner)]
    if filters:
        kind = np.array([filters[i % len(filters)] for i in range(h)], dtype=np.uint8)
        tried = {k: ((raw - guesses[k]()) & 255).astype(np.uint8) for k in set(filters)}
    else:
        tried = {k: ((raw - guesses[k]()) & 255).astype(np.uint8) for k in (0, 1, 2)}
        kind = np.stack([np.abs(t.view(np.int8).astype(np.int16)).sum(axis=1) for t in tried.values()]).argmin(axis=0).astype(np.uint8)
    rows = np.empty((h, w * 3 + 1), dtype=np.uint8)
    rows[:, 0] = kind
    for k, t in tried.items():
        rows[kind == k, 1:] = t[kind == k]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Samples of filtered rows, of which the first byte names the filter."""
    h, width = rows.shape[0], rows.shape[1] - 1
    out = np.zeros((h + 1, width), dtype=np.uint8)  # a row of zeros stands above the first
    for y, row in enumerate(rows, 1):
        kind, x = row[0], row[1:]
        if kind == 0:
            out[y] = x
        elif kind == 1:
            out[y] = np.cumsum(x.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = x + out[y - 1]
        elif kind in (3, 4):
            above, got = out[y - 1].tolist(), [0] * (width + bpp)
            for i, v in enumerate(x.tolist()):
                a, b = got[i], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = above[i - bpp] if i >= bpp else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got[i + bpp] = (v + guess) & 255
            out[y] = got[bpp:]
        else:
            raise ValueError(f"row filter {kind}")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """The pixels (h, w, 3) of a PNG file; ValueError for what is not supported or damaged."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, idat, palette, head = len(SIGNATURE), [], None, None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(name + body) != int.from_bytes(data[at + 8 + n : at + 12 + n]):
            raise ValueError(f"damaged chunk {name!r}")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            idat.append(body)
        elif name == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6] or not 0 < head[0] * head[1] <= MOST_PIXELS:
        raise ValueError("unsupported PNG header")
    w, h, kind = head[0], head[1], head[3]
    bpp = SAMPLES[kind]
    unpacked = zlib.decompressobj().decompress(b"".join(idat), h * (w * bpp + 1))
    if len(unpacked) != h * (w * bpp + 1):
        raise ValueError("too few pixels")
    samples = _unfiltered(np.frombuffer(unpacked, np.uint8).reshape(h, -1), bpp).reshape(h, w, bpp)
    if kind == 3:
        if palette is None or samples.max() >= len(palette):
            raise ValueError("palette too small")
        return palette[samples[..., 0]]
    return np.repeat(samples[..., :1], 3, axis=2) if kind in (0, 4) else np.ascontiguousarray(samples[..., :3])


def pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of up to ``PIECE`` bytes of the column at a place; larger rows are slices of their own."""
    for batch in batches:
        ends, a = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)), 0
        while a < len(ends):
            done = ends[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
            yield batch.slice(a, z - a)
            a = z


def decode_images(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(image_id, width, height, rgb, error) for every row; what cannot be read has an error and no pixels."""
    kind = files.schema[id_col].dataType.simpleString()
    return files.select(F.col(id_col).alias("image_id"), F.col(content_col).alias("raw_")).mapInArrow(_decoded, DECODED.format(kind))


DECODED = "image_id {}, width int, height int, rgb binary, error string"
REGIONS = "image_id {}, region bigint, x double, y double, r int, g int, b int"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, file) to ``DECODED``."""
    for batch in pieces(batches, 1):
        rows: list[tuple] = []
        for x in batch.column(1):
            try:
                pixels = read_png(x.as_py() or b"")
                rows.append((pixels.shape[1], pixels.shape[0], pixels.tobytes(), None))
            except (ValueError, zlib.error) as e:
                rows.append((None, None, None, str(e)))
        w, h, rgb, error = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(rgb, pa.binary()), pa.array(error, pa.string())], names=["image_id", "width", "height", "rgb", "error"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder and those below it; see ``decode_images``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decode_images(files.where(image_format(F.col("path")).isNotNull()))


def grid_regions(pixels: np.ndarray, grid: int) -> list[tuple[int, float, float, int, int, int]]:
    """(region, x, y, r, g, b) of a grid's cells, row by row: centre and mean colour, rounded down; cells without pixels are left out."""
    h, w, _ = pixels.shape
    edges = [[int(i * n / grid) for i in range(grid + 1)] for n in (h, w)]
    out = []
    for i in range(grid * grid):
        (y0, y1), (x0, x1) = edges[0][i // grid : i // grid + 2], edges[1][i % grid : i % grid + 2]
        if y1 > y0 and x1 > x0:
            colour = pixels[y0:y1, x0:x1].reshape(-1, 3).sum(axis=0, dtype=np.int64) // ((y1 - y0) * (x1 - x0))
            out.append((i, round((x0 + x1) / 2 / w, 3), round((y0 + y1) / 2 / h, 3), *colour.tolist()))
    return out


def extract_regions(images: DataFrame, grid: int = 3) -> DataFrame:
    """(image_id, region, x, y, r, g, b): each image's cells in a grid; images without pixels have none."""
    kind = images.schema["image_id"].dataType.simpleString()
    return images.select("image_id", "width", "height", "rgb").mapInArrow(_regions(grid), REGIONS.format(kind))


def _regions(grid: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``DECODED`` to ``REGIONS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            rows, own = [], []
            for i, (w, h, x) in enumerate(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("rgb"), strict=True)):
                if w:
                    found = grid_regions(np.frombuffer(x.as_py(), np.uint8).reshape(h, w, 3), grid)
                    rows += found
                    own += [i] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["image_id", "region", "x", "y", "r", "g", "b"])

    return run


def text_images(docs: DataFrame, width: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, png): each text's UTF-8 bytes as the samples of an image, zeros up to a multiple of three rows; a null text is empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("x_")).mapInArrow(_written(width), f"id_ {kind}, png binary")
    return out.withColumnRenamed("id_", id_col)


def _written(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) to (id, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            files = []
            for x in batch.column(1).cast(pa.large_binary()):
                raw = x.as_py() or b""
                raw += bytes(-len(raw) % (9 * width) if raw else 9 * width)
                files.append(write_png(np.frombuffer(raw, np.uint8).reshape(-1, width, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["id_", "png"])

    return run


def text_pixels(docs: DataFrame, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = DECODED, width: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The images of ``text_images`` read back as ``decode_images`` does, and what ``then`` makes of them (``schema``, with {} for the kind of id).

    One task does all of it a piece at a time, so that neither files nor pixels of a whole batch are held or sent between workers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _decoded(_written(width)(batches))
        return then(found) if then else found

    return docs.select(F.col(id_col).alias("image_id"), F.col(text_col).alias("x_")).mapInArrow(run, schema.format(kind))


def text_regions(docs: DataFrame, grid: int = 3) -> DataFrame:
    """``extract_regions`` of each text's image."""
    return text_pixels(docs, _regions(grid), REGIONS)
