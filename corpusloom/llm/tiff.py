"""TIFF as a lossless carrier: a writer, and a reader that walks image directories, decodes strips and tiles and undoes predictors.

The reader takes both byte orders, chained directories, 8-bit samples (chunky, 1 to 4 of them), strips and tiles, compressions none, LZW,
deflate (both codes) and PackBits, and the horizontal predictor; it gives a row for each page. Anything else raises ValueError.

Defined cases: null or empty text is a payload of 64 zero bytes; an empty table gives no rows; equal payloads give equal files;
repeated rows give repeated results; a null doc_id stays null; very long texts become many pages; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text, slices_of, text_slices

# Fixed values of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
TYPES = {1: "B", 3: "H", 4: "I"}


def packbits(data: bytes) -> bytes:
    """Runs of three and more as (257 - n, byte), the rest as literal blocks of at most 128."""
    out, literal, i = bytearray(), 0, 0
    values = np.frombuffer(data, np.uint8)
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(data)] if data else []
    for s, e in zip(edges, edges[1:], strict=False):
        if e - s < 3:
            continue
        for a in range(literal, s, 128):
            b = min(s, a + 128)
            out.append(b - a - 1)
            out += data[a:b]
        i = s
        while e - i >= 2:
            n = min(128, e - i)
            out += bytes((257 - n, data[s]))
            i += n
        literal = i
    for a in range(literal, len(data), 128):
        b = min(len(data), a + 128)
        out.append(b - a - 1)
        out += data[a:b]
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early, 256 clears and 257 ends."""
    table: dict[bytes, int] = {}
    bits = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    width, prefix = 9, b""
    put(256, width)
    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(code_of(prefix), width)
        table[longer] = 258 + len(table)
        if 258 + len(table) == 4095:
            put(256, width)
            table.clear()
            width = 9
        elif 258 + len(table) >= 1 << width and width < 12:  # the reader is one entry behind
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(code_of(prefix), width)
        if 258 + len(table) >= (1 << width) - 1 and width < 12:  # the reader catches up
            width += 1
    put(257, width)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, table, prev = bytearray(), [], b""
    width = 9
    held = bits = at = 0
    while len(out) < size:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, prev, width = [], b"", 9
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif prev and code - 258 == len(table):
            entry = prev + prev[:1]
        else:
            raise ValueError("LZW code beyond its table")
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        if 258 + len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out[:size])


def compress(data: bytes, how: int) -> bytes:
    return {NONE: lambda: data, LZW: lambda: lzw(data), DEFLATE: lambda: zlib.compress(data, 6), OLD_DEFLATE: lambda: zlib.compress(data, 6), PACKBITS: lambda: packbits(data)}[how]()


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how not in NAMES:
        raise ValueError(f"compression {how}")
    out = {NONE: lambda: data[:size], LZW: lambda: unlzw(data, size), DEFLATE: lambda: zlib.decompress(data), OLD_DEFLATE: lambda: zlib.decompress(data), PACKBITS: lambda: unpackbits(data, size)}[how]()
    if len(out) < size:
        raise ValueError(f"{len(out)} bytes where {size} belong")
    return out[:size]


def write(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 1, strip_rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of pages of 8-bit samples (rows, columns[, samples]); tile: height and width, multiples of 16, or strips otherwise."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = page.shape
        if tile:
            th, tw = tile
            padded = np.pad(page, ((0, -height % th), (0, -width % tw), (0, 0)))
            blocks = [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((b.shape[0], 1, samples), np.uint8)).astype(np.uint8)
            data = compress(b.tobytes(), how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, counts)]
        fields = []
        for tag, kind, values in sorted(entries):
            data = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(data) > 4:
                out += bytes(len(out) & 1)
                fields.append((tag, kind, len(values), struct.pack(f"{order}I", len(out))))
                out += data
            else:
                fields.append((tag, kind, len(values), data.ljust(4, b"\0")))
        out += bytes(len(out) & 1)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + b"".join(struct.pack(f"{order}HHI", *f[:3]) + f[3] for f in fields)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The tags of each page, by following the chain of directories once round at most."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(f"{order}H", data, at)[0]
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, p := at + 2 + 12 * i)
                if kind not in TYPES:
                    continue
                size = count * struct.calcsize(TYPES[kind])
                where = p + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, p + 8)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where))
            following = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise ValueError("a directory beyond the end of the file") from e
        yield order, tags
        at = following


def read(data: bytes) -> list[dict]:
    """A dict for each page: width, height, samples, compression, predictor, blocks, tiled and its pixels."""
    pages = []
    for _, tags in directories(data):
        try:
            width, height = tags[WIDTH][0], tags[HEIGHT][0]
            samples, how, predictor = tags.get(SAMPLES, [1])[0], tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
            if any(b != 8 for b in tags.get(BITS, [1])) or predictor not in (1, 2):
                raise ValueError("only 8-bit samples without or with horizontal predictor")
            tiled = TILE_OFFSETS in tags
            bh, bw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, [height])[0], height), width)
            offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        except KeyError as e:
            raise ValueError(f"no tag {e}") from e
        page = np.zeros((height, width, samples), np.uint8)
        places = [(y, x) for y in range(0, height, bh) for x in range(0, width, bw)]
        for (y, x), offset, count in zip(places, offsets, counts, strict=True):
            rows = bh if tiled else min(bh, height - y)
            block = np.frombuffer(decompress(data[offset : offset + count], how, rows * bw * samples), np.uint8).reshape(rows, bw, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + bw] = block[: height - y, : width - x]
        pages.append({"width": width, "height": height, "samples": samples, "compression": NAMES[how], "predictor": predictor, "blocks": len(offsets), "tiled": tiled, "pixels": page})
    return pages


ROW_BYTES, PAGE_ROWS = 64, 1024
#: How payloads are stored, in turn by their checksum, so that payloads of every length go through every codec and layout. LZW, whose
#: coder is a loop over bytes, has one turn of eight.
LAYOUTS = [
    {"how": LZW, "predictor": 2, "strip_rows": 128},
    {"how": PACKBITS, "strip_rows": 512},
    {"how": DEFLATE, "predictor": 2, "tile": (64, 64)},
    {"how": DEFLATE, "strip_rows": 512, "order": ">"},
    {"how": PACKBITS, "tile": (32, 32), "order": ">"},
    {"how": OLD_DEFLATE, "predictor": 2, "strip_rows": 100},
    {"how": DEFLATE, "tile": (256, 64)},
    {"how": NONE, "strip_rows": 256},
]


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as pages of 64 columns."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    pages = [pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)]
    return write(pages, **LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)])


PAGE_SCHEMA = "doc_id long, page int, width int, height int, samples int, compression string, predictor int, blocks int, tiled boolean, pixels binary"


def pages(files: DataFrame) -> DataFrame:
    """Files (doc_id, media binary) to a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 1)):
            for key, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [{"doc_id": key, "page": i, **p, "pixels": p["pixels"].tobytes()} for i, p in enumerate(read(media) if media is not None else [])]
                yield pa.RecordBatch.from_pylist(rows, schema=_PAGES)

    return files.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, PAGE_SCHEMA)


_PAGES = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("blocks", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary())])
STORE_SCHEMA = "doc_id long, n_bytes long, media binary"
_STORE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def stored(docs: DataFrame) -> DataFrame:
    """Texts to files: doc_id, the text's bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches):
            raw = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array([store(r + bytes(-len(r) % ROW_BYTES or (not r) * ROW_BYTES)) for r in raw], pa.binary())], schema=_STORE)

    return id_and_text(docs).mapInArrow(run, STORE_SCHEMA)


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def features(files: DataFrame) -> DataFrame:
    """What stored() gives, read back: digests of payload and file, and a summary of the pages and their samples."""

    def row(key: int, n: int, media: bytes) -> tuple:
        found = read(media)
        payload = b"".join(p["pixels"].tobytes() for p in found)
        values = np.frombuffer(payload, np.uint8)
        first = found[0]
        summary = f"pages={len(found)};blocks={sum(p['blocks'] for p in found)};codec={first['compression']};predictor={first['predictor']};tiled={int(first['tiled'])};sum={int(values.sum(dtype=np.int64))};max={int(values.max())}"
        return key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), summary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices_of(batch, 2)):
            rows = [row(*x) for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FEATURES, strict=True)], schema=_FEATURES)

    return files.mapInArrow(run, FEATURE_SCHEMA)
