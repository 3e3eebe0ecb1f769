"""Layouts of raster files told from their headers, and the decoding of single strips and tiles.

TIFF and BigTIFF, in strips or tiles, bands side by side or one after another, plain or packed (PackBits, Deflate, LZW), with or
without horizontal differences; PNG without interlacing. Everything reads through `read(offset, size)`, so a header costs
a few kilobytes of a file of any size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

Read = Callable[[int, int], bytes]

KINDS = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}  # fixed values: TIFF field types
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317  # fixed values: TIFF tags
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE = 322, 323, 324, 325, 339, 33550, 33922  # fixed values: TIFF tags
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773  # fixed values: TIFF packings
PNG, PNG_BANDS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # fixed values: a PNG file's first bytes; bands by colour type
MOST_TAGS, MOST_VALUES = 4096, 1 << 24
BAD = (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, OSError, OverflowError)


@dataclass(frozen=True)
class Segment:
    """A strip or tile: its corner, its rows and columns as packed and within the picture, its bands from the first."""

    y: int
    x: int
    rows: int
    columns: int
    seen_rows: int
    seen_columns: int
    band: int
    bands: int
    offset: int
    size: int


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    bands: int
    kind: str
    order: str
    place: tuple
    packing: int
    differences: bool
    segments: tuple[Segment, ...]


def tags_of(read: Read) -> tuple[str, dict[int, tuple]]:
    """The byte order and the tags of a TIFF file's first picture."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    (magic,) = struct.unpack_from(order + "H", head, 2)
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
    counting, each, inline = (8, 20, 8) if big else (2, 12, 4)
    (n,) = struct.unpack(order + ("Q" if big else "H"), read(at, counting))
    if n > MOST_TAGS:
        raise ValueError("too many tags")
    entries, found = read(at + counting, n * each), {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", entries, i * each)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), entries, i * each + 4)
        if kind in KINDS:
            size = struct.calcsize(KINDS[kind]) * count
            if count > MOST_VALUES:
                raise ValueError("too many values in a tag")
            value = entries[i * each + each - inline :][:inline]
            if size > inline:
                value = read(struct.unpack(order + ("Q" if big else "I"), value)[0], size)
            found[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", value)
    return order, found


def place_of(tags: dict[int, tuple], width: int, height: int) -> tuple:
    """(min_lon, min_lat, max_lon, max_lat) from tie point and pixel scale, or nulls where they are absent or off the globe."""
    tie, scale = tags.get(TIE, ()), tags.get(SCALE, ())
    if len(tie) < 6 or len(scale) < 2 or not (-180 <= tie[3] <= 180 and -90 <= tie[4] - height * scale[1] <= 90):
        return (None,) * 4
    return tie[3], tie[4] - height * scale[1], tie[3] + width * scale[0], tie[4]


def tiff_layout(read: Read, length: int) -> Layout:
    order, tags = tags_of(read)
    (width,), (height,) = tags[WIDTH], tags[HEIGHT]
    bands, bits, form = tags.get(BANDS, (1,))[0], set(tags.get(BITS, (1,))), tags.get(FORMAT, (1,))[0]
    kind = {(8, 1): "uint8", (16, 1): "uint16", (32, 1): "uint32", (8, 2): "int8", (16, 2): "int16", (32, 2): "int32", (32, 3): "float32", (64, 3): "float64"}.get((min(bits), form))
    packing, predictor, planar = (tags.get(t, (1,))[0] for t in (COMPRESSION, PREDICTOR, PLANAR))
    if kind is None or len(bits) > 1 or min(width, height, bands) < 1:
        raise ValueError("without pixels, or of another kind of number")
    if packing not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or planar not in (1, 2) or predictor not in (1, 2) or predictor == 2 and kind.startswith("float"):
        raise ValueError("packed in another way")
    tiled = TILES in tags
    rows, columns = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(STRIP_ROWS, (height,))[0], height), width)
    offsets, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    down, across, planes = -(-height // rows), -(-width // columns), bands if planar == 2 else 1
    if not len(offsets) == len(sizes) == down * across * planes:
        raise ValueError("strips don't cover the picture")
    if any(o + s > length for o, s in zip(offsets, sizes, strict=True)):
        raise ValueError("cut short")
    segments = []
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(i, down * across)
        y, x = k // across * rows, k % across * columns
        seen = min(rows, height - y)
        segments.append(Segment(y, x, rows if tiled else seen, columns, seen, min(columns, width - x), plane, bands // planes, offset, size))
    return Layout(width, height, bands, kind, order, place_of(tags, width, height), packing, predictor == 2, tuple(segments))


def png_chunks(read: Read, length: int) -> Iterator[tuple[bytes, int, int]]:
    at = 8
    while at + 8 <= length:
        size, name = struct.unpack(">I4s", read(at, 8))
        yield name, at + 8, size
        at += size + 12


def png_layout(read: Read, length: int) -> Layout:
    """One segment: a PNG's rows can only be unpacked one after another."""
    width, height, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", read(16, 13))
    if laced or bits not in (8, 16) or colour not in PNG_BANDS:
        raise ValueError("interlaced, or of less than eight bits")
    parts = [(at, size) for name, at, size in png_chunks(read, length) if name == b"IDAT"]
    if not parts or min(width, height) < 1 or any(a + s > length for a, s in parts):
        raise ValueError("cut short")
    whole = Segment(0, 0, height, width, height, width, 0, PNG_BANDS[colour], parts[0][0], sum(s for _, s in parts))
    return Layout(width, height, PNG_BANDS[colour], "uint8" if bits == 8 else "uint16", ">", (None,) * 4, 0, False, (whole,))


def layout_of(read: Read, length: int) -> Layout:
    """Raises one of BAD with a reason where a file can't be read."""
    return png_layout(read, length) if read(0, 8) == PNG else tiff_layout(read, length)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; 256 starts anew, 257 ends."""
    out, table = bytearray(), []
    held = bits = at = 0
    width, last = 9, b""
    while len(out) < size:
        while bits < width:
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("a code before its word")
        out += word
        if last:
            table.append(last + word[:1])
        width = min(12, (len(table) + 1).bit_length()) if len(table) + 1 >= 512 else 9
        last = word
    return bytes(out)


def segment_pixels(layout: Layout, s: Segment, read: Read) -> np.ndarray:
    """The segment's part of the picture: rows x columns x its bands."""
    kind = np.dtype(layout.kind)
    data, size = read(s.offset, s.size), s.rows * s.columns * s.bands * kind.itemsize
    if layout.packing in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompressobj().decompress(data, size)
    elif layout.packing == PACKBITS:
        data = unpackbits(data, size)
    elif layout.packing == LZW:
        data = unlzw(data, size)
    pixels = np.frombuffer(data[:size], kind.newbyteorder(layout.order)).reshape(s.rows, s.columns, s.bands).astype(kind)
    if layout.differences:
        pixels = np.cumsum(pixels, axis=1, dtype=kind)
    return pixels[: s.seen_rows, : s.seen_columns]


def png_rows(layout: Layout, read: Read, length: int, batch: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x columns x bands) in batches; two rows and one batch are held at a time."""
    kind = np.dtype(layout.kind)
    step = layout.bands * kind.itemsize
    line = layout.width * step
    before, buffer, rows, y = np.zeros(line, np.uint8), bytearray(), [], 0
    unpack = zlib.decompressobj()

    def told() -> np.ndarray:
        return np.stack(rows).reshape(-1).view(kind.newbyteorder(">")).reshape(len(rows), layout.width, layout.bands).astype(kind)

    for name, at, size in png_chunks(read, length):
        for start in range(at, at + size, 1 << 20) if name == b"IDAT" else ():
            buffer += unpack.decompress(read(start, min(1 << 20, at + size - start)))
            while len(buffer) > line and y + len(rows) < layout.height:
                before = unfiltered(buffer[0], np.frombuffer(bytes(buffer[1 : line + 1]), np.uint8), before, step)
                del buffer[: line + 1]
                rows.append(before)
                if len(rows) == batch:
                    yield y, told()
                    y, rows = y + len(rows), []
    if rows:
        yield y, told()
        y += len(rows)
    if y < layout.height:
        raise ValueError("cut short")


def unfiltered(how: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG row without its filter: none, left, above, mean of both, or the nearest of left, above and the corner."""
    if how == 0:
        return row
    if how == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if how == 2:
        return row + above
    if how > 4:
        raise ValueError("another filter")
    out, up, given = bytearray(len(row)), above.tolist(), row.tolist()
    for i, value in enumerate(given):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if how == 3:
            guess = (left + up[i]) >> 1
        else:
            guess = min((abs(up[i] - corner), 0, left), (abs(left - corner), 1, up[i]), (abs(left + up[i] - 2 * corner), 2, corner))[2]
        out[i] = (value + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)
