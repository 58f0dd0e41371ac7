"""TIFF media columns (operator 2).

``read_pages`` walks the chain of image directories of each file, decodes
PackBits, LZW or deflate strips and tiles, undoes the horizontal predictor and
emits one row for each page. ``write_gray`` makes such files from 8-bit samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WHOLE = (1, 3, 4)  # unsigned kinds, the only ones that a tag read here may have
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


class Malformed(ValueError):
    """A file that the reader can't decode."""


def unpack_bits(data: bytes, most: int = 1 << 62) -> bytes:
    out, i, size = [], 0, 0
    while i < len(data) and size < most:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i, size = i + 2 + n, size + n + 1
        elif n > 128:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i, size = i + 2, size + 257 - n
        else:
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 1 < n and data[i + 1] == data[i]):
            i += 1
        out += bytes((i - start - 1,)) + data[start:i]
    return bytes(out)


def _code_width(size: int) -> int:
    """Bits of a code when the reader's table has ``size`` entries: widths change one entry early."""
    return 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, held, bits, before = [], 0, 0, b""
    at, width, size = 0, 9, 0
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            held = held << 8 | data[at]
            at, bits = at + 1, bits + 8
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257 or size >= most:
            return b"".join(out)
        if code == 256:
            del table[258:]
            before, width = b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise Malformed("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if before and len(table) < 4097:
            table.append(before + entry[:1])
        before, width = entry, _code_width(len(table))


def lzw_encode(data: bytes) -> bytes:
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    out, held, bits = bytearray(), 0, 0
    size = 258

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], _code_width(size - 1))
        table[longer] = size
        size += 1
        if size == 4094:
            put(256, 12)
            table = {bytes((j,)): j for j in range(256)}
            size = 258
        word = data[i : i + 1]
    if word:
        put(table[word], _code_width(size - 1))
        size += 1
    put(257, _code_width(size - 1))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int = 0) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: By compression: data and the number of bytes after which the rest doesn't matter.
DECODERS: dict[int, Callable[[bytes, int], bytes]] = {
    NONE: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits,
}
ENCODERS: dict[int, Callable[[bytes], bytes]] = {
    NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits,
}


#: Samples that a byte of a strip can stand for at most: an image that claims more isn't there.
EXPAND = {NONE: 1, PACKBITS: 64, DEFLATE: 1040, OLD_DEFLATE: 1040, LZW: 4096}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


class Reader:
    """One file; classic TIFF in either byte order."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise Malformed("no byte order mark")
        self.order = "<" if data[:2] == b"II" else ">"
        if self._get("H", 2)[0] != 42:
            raise Malformed("not a classic TIFF")

    def _get(self, kinds: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + kinds, self.data, at)
        except struct.error as e:
            raise Malformed(str(e)) from e

    def directories(self) -> Iterator[dict[int, tuple]]:
        (at,) = self._get("I", 4)
        seen = set()
        while at:
            if at in seen:
                raise Malformed("directories form a loop")
            seen.add(at)
            (count,) = self._get("H", at)
            tags = {}
            for i in range(count):
                tag, kind, n = self._get("HHI", at + 2 + 12 * i)
                place = at + 10 + 12 * i
                if SIZES.get(kind, 1) * n > 4:
                    (place,) = self._get("I", place)
                if kind in WHOLE and n:
                    tags[tag] = self._get(f"{n}{TYPES[kind]}", place)
            yield tags
            (at,) = self._get("I", at + 2 + 12 * count)

    def pages(self) -> Iterator[Page]:
        for number, tags in enumerate(self.directories()):
            yield self._page(number, tags)

    def _page(self, number: int, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        width, height = one(WIDTH), one(HEIGHT)
        if not width or not height:
            raise Malformed("no width or height")
        samples, bits = one(SAMPLES, 1), one(BITS, 1)
        compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if bits not in (8, 16) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
            raise Malformed("only chunky samples of 8 or 16 bits are read")
        if compression not in DECODERS:
            raise Malformed(f"compression {compression}")
        depth = bits // 8
        kind = np.dtype(f"{self.order}u{depth}")
        if TILE_OFFSETS in tags:
            across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
            offsets, counts = tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())
        else:
            across, down = width, min(one(ROWS_PER_STRIP, height), height) or 1
            offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
        if not across or not down or not samples:
            raise Malformed("a strip or tile without size")
        columns = -(-width // across)
        if not len(offsets) == len(counts) == columns * -(-height // down):
            raise Malformed("strips or tiles are missing")
        if any(o + c > len(self.data) for o, c in zip(offsets, counts, strict=True)):
            raise Malformed("a strip or tile is cut off")
        if width * height * samples * depth > EXPAND[compression] * (sum(counts) + 64):
            raise Malformed("more pixels than the file can hold")
        out = np.zeros((height, width, samples), kind)
        for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
            y, x = i // columns * down, i % columns * across
            rows = min(down, height - y) if TILE_OFFSETS not in tags else down
            need = rows * across * samples * depth
            if need > EXPAND[compression] * (count + 64):
                raise Malformed("more pixels than a strip or tile can hold")
            raw = DECODERS[compression](self.data[offset : offset + count], need)
            if len(raw) < need:
                raise Malformed("a strip or tile is too short")
            part = np.frombuffer(raw, kind, rows * across * samples).reshape(rows, across, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
            h, w = min(rows, height - y), min(across, width - x)
            out[y : y + h, x : x + w] = part[:h, :w]
        return Page(number, width, height, samples, bits, compression, predictor, out.tobytes())


def write_gray(
    images: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 1024, tile: int | None = None
) -> bytes:
    """A little-endian file with one 8-bit gray page for each (height, width) array."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        height, width = image.shape
        if tile:
            boxes = [(y, x, tile, tile) for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            boxes = [(y, 0, min(strip_rows, height - y), width) for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for y, x, h, w in boxes:
            part = np.zeros((h, w), np.uint8)
            inside = image[y : y + h, x : x + w]
            part[: inside.shape[0], : inside.shape[1]] = inside
            if predictor == 2:
                part[:, 1:] = np.diff(part.view(np.uint8), axis=1)
            packed = ENCODERS[compression](part.tobytes())
            offsets.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = [
            (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            tags += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, counts)]
        else:
            tags += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, counts)]
        fields = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack("<I", place)
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + b"\0" * (-len(data) % unit or (0 if data else unit))


#: How texts are stored, by their checksum: compression, predictor, tile size.
LAYOUTS = (
    (DEFLATE, 2, None), (LZW, 1, None), (DEFLATE, 1, 64), (PACKBITS, 1, None), (DEFLATE, 2, 32), (NONE, 2, None), (DEFLATE, 1, None), (DEFLATE, 2, 16),
)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as the samples of a one-page TIFF.

    A text's checksum picks one of ``LAYOUTS``, so equal texts give equal files.
    Null texts are empty; an empty text is one row of zero samples. Rows that
    repeat are stored each; further columns are ignored; an empty table gives an
    empty one.
    """

    def stored(text: bytes) -> bytes:
        compression, predictor, tile = LAYOUTS[zlib.crc32(text) % len(LAYOUTS)]
        image = np.frombuffer(payload(text, width), np.uint8).reshape(-1, width)
        return write_gray([image], compression=compression, predictor=predictor, tile=tile)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import utf8

        for batch in batches:
            for piece in slices(batch):
                texts = utf8(piece.column("text"))
                files = [stored(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())],
                    ["id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def features(pixels: bytes) -> str:
    """Mean, deviation and eight-bin histogram of the samples."""
    x = np.frombuffer(pixels, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{x.mean():.4f};{x.std():.4f};" + ",".join(map(str, bins.tolist()))


PAGE = (
    "page int, width long, height long, samples int, bits int, compression int, predictor int, "
    "pixels binary, feature string, error string"
)


def read_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """The input's other columns and one row for each page of each file.

    A file that can't be decoded, a null and an empty one give one row with a
    null page and the reason in ``error``; pages before the fault are kept.
    Input columns with the names of page columns are replaced.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(PAGE)
    kept = [f for f in files.schema.fields if f.name not in new.names and f.name != media_col]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *new.fields])

    def pages(data: bytes | None) -> Iterator[tuple]:
        try:
            for p in Reader(data or b"").pages():
                plain = p.pixels if p.bits == 8 else b""
                yield (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, features(plain or p.pixels), None)
        except (Malformed, zlib.error, KeyError, ValueError) as e:
            yield (*[None] * 9, f"{type(e).__name__}: {e}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(new)
        for batch in batches:
            for piece in slices(batch, column=media_col):
                rows, values = [], []
                for i, data in enumerate(piece.column(media_col).to_pylist()):
                    for page in pages(data):
                        rows.append(i)
                        values.append(page)
                left = pa.table(piece).select(names).take(pa.array(rows, pa.int64())) if names else None
                cols = [pa.array(list(c), arrow.field(j).type) for j, c in enumerate(zip(*values, strict=True))] or [pa.array([], f.type) for f in arrow]
                out = pa.table([*(left.columns if left else []), *cols], names=[*names, *arrow.names])
                yield from out.combine_chunks().to_batches()

    return files.select(*names, media_col).mapInArrow(run, schema)
