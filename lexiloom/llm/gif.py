"""GIF media columns: LZW, palettes, disposal, transparency, timed frames.

The decoder reads any GIF87a/89a stream of up to PIXELS screen pixels.  Code extraction is vectorised, as code
widths depend only on the number of codes since the last clear code.  Strings
are resolved without a string table: what an LZW code stands for is a copy of
earlier output (the previous code's text and the byte after it), so each output
byte points to an earlier one and pointer doubling leads all of them to literals
in a logarithmic number of gathers.

Frames are composed on the logical screen by their disposal and transparency
rules, one screen for all of them; each stored frame has its delay, place, palette indices and a histogram
over 64 colours (four levels a channel) of the composed screen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, slices, texts_of

UNIT = 576
WIDTH, ROWS = 96, 96
MAX_CODES = 4096
#: Most pixels of a screen or frame; a file that claims more is not decoded, as a few bytes can claim 16 GiB.
PIXELS = 1 << 27
#: Codes of a full table that are decoded at a time.
FULL_CODES = 1 << 14


def code_widths(count: int, size: int) -> np.ndarray:
    """Bits of the first ``count`` codes after a clear code, for a minimum code size."""
    free = (1 << size) + 2 + np.maximum(np.arange(count) - 1, 0)
    bits = np.full(count, size + 1, dtype=np.int64)
    for b in range(size + 1, 12):
        bits[free >= 1 << b] = b + 1
    return bits


@lru_cache(maxsize=8)
def positions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes after a clear code that fill the table, and of the next."""
    bits = code_widths(MAX_CODES - (1 << size) - 1, size)
    return bits, np.cumsum(bits) - bits


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """LZW code stream of palette indices below ``1 << size``."""
    clear = 1 << size
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free, prefix = clear + 2, -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if free < MAX_CODES:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, free = [], clear + 2
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    runs.append(codes)
    values = np.array([clear, *(c for run in runs for c in run)], dtype=np.int64)
    widths = np.concatenate([[size + 1], *(code_widths(len(run), size) for run in runs)])
    ends = np.cumsum(widths)
    at = ends - widths
    shifted, byte = values << (at & 7), at >> 3
    total = int(ends[-1] + 7) >> 3
    out = sum(np.bincount(byte + k, (shifted >> 8 * k) & 255, minlength=total + 2) for k in range(3))
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int, expected: int) -> np.ndarray:
    """Palette indices of an LZW code stream; ``expected`` of them at most."""
    clear, out, have, bit = 1 << size, [], 0, 0
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    first = positions(size)
    full = np.full(FULL_CODES, 12), 12 * np.arange(FULL_CODES)
    total = 8 * len(stream)
    held = None  # once the table is full: its text, where each code's begins, and their lengths
    while have < expected:
        bits, starts = first if held is None else full
        n = int(np.searchsorted(starts + bits, total - bit, side="right"))
        if not n:
            break
        at = bit + starts[:n]
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << bits[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else n
        if held is None:
            part, begin, lengths = first_strings(codes[:stop], clear)
            if stop == n == len(bits):  # all codes are defined; no clear code need follow
                held = part, begin, lengths
        else:
            part = full_table_strings(codes[:stop], clear, *held)
        out.append(part)
        have += len(part)
        if stop < n:
            if codes[stop] == clear + 1:
                break
            bit, held = int(at[stop] + bits[stop]), None
        elif n < len(bits):
            break
        else:
            bit = int(at[-1] + bits[n - 1])
    return np.concatenate(out)[:expected] if out else np.zeros(0, np.uint8)


def full_table_strings(codes: np.ndarray, clear: int, text: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Output of codes of a full table: copies of the text that filled it."""
    literal = codes < clear
    of = np.where(literal, 0, codes - clear - 2)
    sizes = np.where(literal, 1, lengths[of] + 1)
    ends = np.cumsum(sizes)
    source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[of] - (ends - sizes), sizes)
    out = text[np.where(np.repeat(literal, sizes), 0, source)]
    out[(ends - sizes)[literal]] = codes[literal]
    return out


def lzw_strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """Output of the codes from a clear code to the next or a full table."""
    return first_strings(codes, clear)[0]


def first_strings(codes: np.ndarray, clear: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output of those codes, and each code's begin and length."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.arange(n)
    literal = codes < clear
    parent = np.where(literal, own, codes - clear - 2)  # the code whose text, and one byte more, is copied
    if (~literal & (parent >= np.maximum(own, 1))).any() or (parent[~literal] < 0).any():
        raise ValueError("LZW code that no earlier code defines")
    lengths, up = (~literal).astype(np.int64), parent
    while True:  # pointer doubling: the depth of each code below its literal
        above = lengths[up]
        if not above.any():
            break
        lengths = lengths + above
        up = up[up]
    lengths += 1
    ends = np.cumsum(lengths)
    begin = ends - lengths
    of = np.repeat(own, lengths)
    place = np.arange(int(ends[-1]))
    source = np.where(literal[of], place, begin[parent[of]] + place - begin[of])
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return codes[of[source]].astype(np.uint8), begin, lengths


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


@lru_cache(maxsize=1)
def palette() -> bytes:
    """256 distinct colours: three bits of red and green, two of blue."""
    return bytes(x for i in range(256) for x in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


def interlaced_rows(height: int) -> list[int]:
    return [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]


def write_gif(width: int, height: int, frames: list[dict], colours: bytes | None = None) -> bytes:
    """A GIF89a file.

    Each frame is a dict of ``pixels`` (bytes of palette indices), ``width`` and,
    optionally, ``left``, ``top``, ``delay`` (1/100 s), ``disposal``,
    ``transparent`` (index), ``palette`` (its own) and ``interlaced``.
    """
    colours = palette() if colours is None else colours
    bits = max(1, (len(colours) // 3 - 1).bit_length())
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | (bits - 1), 0, 0), colours.ljust(3 << bits, b"\0")]
    if len(frames) > 1:
        parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for f in frames:
        clear = f.get("transparent")
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", 1) << 2 | (clear is not None), f.get("delay", 0), clear or 0, 0))
        own, pixels, w = f.get("palette"), f["pixels"], f["width"]
        h = len(pixels) // w
        flags, depth = 0, bits
        if own is not None:
            depth = max(1, (len(own) // 3 - 1).bit_length())
            flags = 0x80 | (depth - 1)
        if f.get("interlaced"):
            flags |= 0x40
            pixels = b"".join(pixels[r * w : r * w + w] for r in interlaced_rows(h))
        parts.append(struct.pack("<BHHHHB", 0x2C, f.get("left", 0), f.get("top", 0), w, h, flags))
        if own is not None:
            parts.append(own.ljust(3 << depth, b"\0"))
        size = max(2, depth)
        parts += [bytes([size]), blocks(lzw_encode(pixels, size))]
    parts.append(b"\x3b")
    return b"".join(parts)


def read_gif(data: bytes, screens: bool = False) -> dict:
    """Screen size and frames of a GIF file.

    Frames have ``left, top, width, height, delay, disposal, transparent, pixels``
    (palette indices, rows in order), ``histogram`` of the composed screen and, if
    asked, ``screen``, a copy of it (RGBA).
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        found = []
        while data[at]:
            found.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(found), at + 1

    if width * height > PIXELS:
        raise ValueError("GIF screen with too many pixels")
    screen = np.zeros((height, width, 4), np.uint8)
    frames, control = [], (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, clear if packed & 1 else None)
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown GIF block {data[at]}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colours = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if w * h > PIXELS:
            raise ValueError("GIF frame with too many pixels")
        size = data[at]
        stream, at = sub_blocks(at + 1)
        pixels = lzw_decode(stream, size, w * h)
        if len(pixels) < w * h:
            raise ValueError("GIF frame with too few pixels")
        pixels = pixels.reshape(h, w)
        if flags & 0x40:
            rows = np.empty_like(pixels)
            rows[interlaced_rows(h)] = pixels
            pixels = rows
        disposal, delay, clear = control
        before = screen.copy() if disposal == 3 else None
        box = screen[top : top + h, left : left + w]
        shown = pixels[: box.shape[0], : box.shape[1]]
        table = np.full((256, 4), 255, np.uint8)
        if colours is not None:
            table[: len(colours), :3] = colours
        drawn = table[shown]
        if clear is None:
            box[...] = drawn
        else:
            mask = shown != clear
            box[mask] = drawn[mask]
        frames.append({"left": left, "top": top, "width": w, "height": h, "delay": delay, "disposal": disposal, "transparent": clear, "pixels": pixels.tobytes(), "histogram": colour_histogram(screen)} | ({"screen": screen.copy()} if screens else {}))
        if disposal == 2:
            box[...] = 0
        elif disposal == 3:
            screen = before
        control = (0, 0, None)
    return {"width": width, "height": height, "frames": frames}


def colour_histogram(screen: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by four levels of red, green and blue: 64 bins."""
    level = screen >> 6
    code = (level[..., 0] << 4 | level[..., 1] << 2 | level[..., 2]).ravel()
    return np.bincount(code[screen[..., 3].ravel() > 0], minlength=64)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and bytes padded with 255 to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded bytes as the samples of a GIF's frames."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in slices([len(t) for t in texts]):
                sizes, media = [], []
                for text in texts[a:b]:
                    n, payload = payload_of(text)
                    cut = [payload[i : i + WIDTH * ROWS] for i in range(0, len(payload), WIDTH * ROWS)]
                    sizes.append(n)
                    media.append(write_gif(WIDTH, min(ROWS, len(cut[0]) // WIDTH), [{"pixels": p, "width": WIDTH, "delay": 10} for p in cut]))
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[a:b], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_batches(df, [id_col, text_col], run, schema)


FRAME = "struct<at_ms:bigint,delay_ms:bigint,left:int,top:int,width:int,height:int,disposal:int,transparent:int,pixels:binary,histogram:array<bigint>>"


def frame_rows(gif: dict) -> list[dict]:
    """Stored frames: start time, place, indices and the screen's colour histogram."""
    rows, now = [], 0
    for f in gif["frames"]:
        rows.append({"at_ms": now, "delay_ms": 10 * f["delay"], **{k: f[k] for k in ("left", "top", "width", "height", "disposal", "transparent", "pixels")}, "histogram": f["histogram"].tolist()})
        now += 10 * f["delay"]
    return rows


def decode_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, width, height, frames) of a column of GIF files; null or damaged files give null frames.

    Rows are independent: repeated rows repeat, an empty table stays empty, and of other
    columns none is read.
    """
    kind = pa.list_(pa.struct([("at_ms", pa.int64()), ("delay_ms", pa.int64()), *((c, pa.int32()) for c in ("left", "top", "width", "height", "disposal", "transparent")), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(media_col)
            for a, b in slices([len(x.as_buffer()) if x.is_valid else 0 for x in media], 1 << 20):
                out = []
                for x in media[a:b].to_pylist():
                    try:
                        gif = read_gif(x)
                        out.append((gif["width"], gif["height"], frame_rows(gif)))
                    except (TypeError, ValueError, IndexError, struct.error):
                        out.append((None, None, None))
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[a:b], pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], kind)], names=[id_col, "width", "height", "frames"])

    return map_batches(df, [id_col, media_col], run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, width int, height int, frames array<{FRAME}>")


def digest_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of stored media rows (id, n_bytes, media), from their decoded frames.

    Fused with the decoder so that frames need not travel back: the payload is the
    frames' indices in turn, the feature the colour histogram summed over frames.  Null
    media give nulls; media that ``store_texts`` did not write and that are damaged fail.
    """
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("media"):
                media = x.as_py()
                if media is None:
                    rows.append((None,) * 7)
                    continue
                frames = frame_rows(read_gif(media))
                payload = b"".join(f["pixels"] for f in frames)
                histogram = np.sum([f["histogram"] for f in frames], axis=0)
                top = np.argsort(-histogram, kind="stable")[:8]
                feature = f"{len(frames)}:" + ",".join(f"{k}={histogram[k]}" for k in top if histogram[k])
                rows.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-32:]), len(media), sha256(media).hexdigest(), feature, len(frames)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df, [id_col, "n_bytes", "media"], run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint")
