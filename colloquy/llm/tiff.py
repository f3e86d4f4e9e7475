"""TIFF as a media column: write payloads as images, walk directories, one row per page.

The reader follows the chain of image directories in either byte order, takes strips or
tiles, undoes PackBits, LZW or deflate, then the horizontal predictor, and puts the samples
together (8 or 16 bits, chunky or planar). The writer stores 8-bit samples.
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
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pick

# Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

PAGE_WIDTH = 64
#: Rows of one page that the query's writer makes; a longer payload takes more pages.
PAGE_ROWS = 4096


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes and more become (1 - length, byte); other bytes go as they are."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    edge = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1], True])
    begin, length = edge[:-1], np.diff(edge)
    long = length >= 3
    out, literal = bytearray(), 0
    for at, n in zip(begin[long].tolist(), length[long].tolist()):
        _literals(out, data, literal, at)
        while n:
            k = min(n, 128)
            out += bytes(((257 - k) & 0xFF, data[at])) if k > 1 else bytes((0, data[at]))
            n -= k
            at += k
        literal = at
    _literals(out, data, literal, len(data))
    return bytes(out)


def _literals(out: bytearray, data: bytes, at: int, end: int) -> None:
    for k in range(at, end, 128):
        part = data[k : min(k + 128, end)]
        out.append(len(part) - 1)
        out += part


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends."""
    bits, width_bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, width_bits
        bits, width_bits = (bits << width) | code, width_bits + width
        while width_bits >= 8:
            width_bits -= 8
            out.append(bits >> width_bits)
            bits &= (1 << width_bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    put(256, 9)
    width, free, seen = 9, 258, b""
    for i in range(len(data)):
        longer = seen + data[i : i + 1]
        if longer in table:
            seen = longer
            continue
        put(table[seen], width)
        table[longer] = free
        free += 1
        if free == 4094:
            put(256, width)
            table = {bytes((i,)): i for i in range(256)}
            width, free = 9, 258
        elif free + 1 > (1 << width):
            width += 1
        seen = data[i : i + 1]
    if seen:
        put(table[seen], width)
        free += 1
        if free + 1 > (1 << width) and width < 12:
            width += 1
    put(257, width)
    if width_bits:
        out.append((bits << (8 - width_bits)) & 0xFF)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, made = list(base), [], 0
    bits = width_bits = at = 0
    width, last = 9, b""
    while made < size:
        while width_bits < width:
            if at >= len(data):
                return b"".join(out)[:size]
            bits, width_bits, at = (bits << 8) | data[at], width_bits + 8, at + 1
        width_bits -= width
        code = bits >> width_bits
        bits &= (1 << width_bits) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("a code of the LZW data is out of range")
        out.append(now)
        made += len(now)
        if last:
            table.append(last + now[:1])
            if len(table) + 1 >= (1 << width) and width < 12:
                width += 1
        last = now
    return b"".join(out)[:size]


def compress(data: bytes, how: int) -> bytes:
    return {NONE: lambda d: d, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}[how](data)


def expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)[:size]
    if how == PACKBITS:
        return unpack_bits(data, size)
    raise ValueError(f"compression {how} isn't known")


def write_tiff(pages: list[np.ndarray], how: int = DEFLATE, predictor: bool = False, tile: int = 0, rows: int = 256, order: str = "<") -> bytes:
    """A file of one directory for each page (height x width, 8-bit grey), in strips of `rows` or square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        parts = []
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, len(padded), tile) for x in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[y : y + rows] for y in range(0, height, rows)]
        for block in blocks:
            if predictor:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            parts.append(compress(np.ascontiguousarray(block).tobytes(), how))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) & 1)
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [how]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [2 if predictor else 1])]
        if tile:
            tags += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, [len(p) for p in parts])]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, [len(p) for p in parts])]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict, int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = SIZES.get(kind, 1) * n
        place = at + 2 + 12 * i + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind] * n, data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def iter_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Tags and samples (height x width x samples) of each page, in the order of the directories."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("this isn't a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:  # a loop in the chain ends it
        seen.add(at)
        tags, at = _directory(data, order, at)
        yield tags, _samples(data, order, tags)


def _samples(data: bytes, order: str, tags: dict) -> np.ndarray:
    width, height, n = tags[WIDTH][0], tags[LENGTH][0], tags.get(SAMPLES, [1])[0]
    bits, how, predictor = tags.get(BITS, [1])[0], tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
    if bits not in (8, 16) or predictor not in (1, 2):
        raise ValueError("only samples of 8 or 16 bits, plain or with the horizontal predictor, are read")
    kind, planes = np.dtype(np.uint8 if bits == 8 else order + "u2"), tags.get(PLANAR, [1])[0] == 2
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(height, tags.get(ROWS_PER_STRIP, [height])[0]))
    offsets, counts = tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]
    across, down, deep = -(-width // bw), -(-height // bh), 1 if planes else n
    out = np.zeros((height, width, n), kind.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        plane, place = divmod(k, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = expand(data[offset : offset + count], how, rows * bw * deep * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(rows, bw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: height - y, : width - x]
        if planes:
            out[y : y + bh, x : x + bw, plane] = part[:, :, 0]
        else:
            out[y : y + bh, x : x + bw] = part
    return out


def payload_of(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def store(payload: bytes) -> bytes:
    """The payload as a file; a digest picks among the forms, so equal payloads give equal files."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    pages = [grid[y : y + PAGE_ROWS] for y in range(0, len(grid), PAGE_ROWS)]
    form = zlib.crc32(payload) & 7
    if form == 0:
        return write_tiff(pages, LZW, rows=64)
    if form == 1:
        return write_tiff(pages, PACKBITS, tile=32, order=">")
    if form < 5:
        return write_tiff(pages, DEFLATE, tile=64)
    return write_tiff(pages, DEFLATE, predictor=form == 5, rows=512, order=">")


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the column media: each text, padded, as a TIFF file. A null text counts as empty."""
    rows = pick(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(x.as_py() or "").encode() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([store(payload_of(x)) for x in raw], pa.binary())], schema=schema)

    return rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, n_bytes long, media binary")


def read_pages(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per page: id, page (from 0), width, height, samples, bits, compression, pixels; a null file has no page."""
    rows = media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    kind = rows.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), *((k, pa.int32()) for k in ("page", "width", "height", "samples", "bits", "compression")), ("pixels", pa.binary())])

    def scan(batches):
        for batch in batches:
            for key, data in zip(batch.column("id"), batch.column("media")):
                for k, (tags, grid) in enumerate(iter_pages(data.as_py()) if data.is_valid else ()):
                    row = [key.as_py(), k, grid.shape[1], grid.shape[0], grid.shape[2], 8 * grid.itemsize, tags.get(COMPRESSION, [NONE])[0], grid.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    return rows.mapInArrow(scan, f"id {kind.simpleString()}, page int, width int, height int, samples int, bits int, compression int, pixels binary")


def feature_of(grids: list[np.ndarray]) -> str:
    """Pages, size, mean and deviation (thousandths, whole numbers), and an 8 x 8 average hash of the first page."""
    n = sum(g.size for g in grids)
    total = sum(int(g.sum(dtype=np.int64)) for g in grids)
    square = sum(int((g.astype(np.int64) ** 2).sum()) for g in grids)
    first = grids[0][:, :, 0].astype(np.int64)
    rows, columns = (np.arange(8) * s // 8 for s in first.shape)
    cells = np.add.reduceat(np.add.reduceat(first, np.unique(rows), axis=0), np.unique(columns), axis=1)
    bits = "".join("1" if v * cells.size > cells.sum() else "0" for v in cells.ravel().tolist())
    return f"pages={len(grids)};height={sum(len(g) for g in grids)};mean={1000 * total // n};variance={(square * n - total * total) // (n * n)};hash={int(bits, 2):016x}"


def media_digests(media: DataFrame) -> DataFrame:
    """Read each file of write_media back through its pages: lengths, digests and the feature."""
    kind = media.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())])

    def scan(batches):
        for batch in batches:
            out = []
            for key, n, data in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media")):
                data, sha, size, tail, grids = data.as_py(), hashlib.sha256(), 0, b"", []
                for _, grid in iter_pages(data):
                    raw = grid.tobytes()
                    sha.update(raw)
                    size, tail = size + len(raw), raw[-64:]
                    grids.append(grid)
                out.append((key.as_py(), n.as_py(), size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature_of(grids), len(grids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return media.mapInArrow(scan, f"doc_id {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
