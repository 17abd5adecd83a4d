"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the chain of image directories of a classic TIFF of either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, chunky or planar, undoes the horizontal
predictor, trims the padding of edge tiles and puts the samples of each page together. Sizes are held
against the file before anything is allocated, and whatever is wrong with a file becomes a
:class:`TiffError`. The writer makes files with the same options.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_rows

# Fixed values of the TIFF 6.0 specification: tags, field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
SHORT, LONG = 3, 4
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

BLOCK = 64
PAGE_BYTES = 1 << 20
# The most that one page may take when decoded, and the most that each compression can grow.
MOST_BYTES = 1 << 30
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1100, OLD_DEFLATE: 1100}


class TiffError(ValueError):
    """The bytes are not a TIFF that this reader understands."""


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, all between them as literals."""
    x = np.frombuffer(data, dtype=np.uint8)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(x)])
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    long = sizes > 2
    for start, size in zip(starts[long].tolist(), sizes[long].tolist(), strict=True):
        literal(start)
        at = start + size
        while size > 1:
            run = min(size, 128)
            out += bytes((257 - run, data[start]))
            size -= run
        at -= size  # a byte left over from runs of 128 goes with the next literal
    literal(len(x))
    return bytes(out)


def packbits_decode(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes from the most significant bit, widened one code early, as TIFF asks."""
    codes, widths = [CLEAR], [9]
    width, size, table = 9, 258, {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = table.get(key)
        if longer is not None:
            prefix = longer
            continue
        codes.append(prefix)
        widths.append(width)
        table[key] = size
        size += 1
        if size > 4093:
            codes.append(CLEAR)
            widths.append(width)
            width, size, table = 9, 258, {}
        elif size + 1 > 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        if size + 2 > 1 << width and width < 12:
            width += 1
    codes.append(END)
    widths.append(width)
    code, wide = np.array(codes, dtype=np.uint16), np.array(widths)
    bits = (code[:, None] >> np.arange(11, -1, -1, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) >= 12 - wide[:, None]].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, most: int) -> bytes:
    out = bytearray()
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, bits, used = list(singles), 9, 0, 0
    last = b""
    for byte in data:
        bits = (bits << 8) | byte
        used += 8
        if used < width:
            continue
        used -= width
        code = bits >> used
        bits &= (1 << used) - 1
        if code == END or len(out) >= most:
            break
        if code == CLEAR:
            table, width, last = list(singles), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _encode(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return data


def _decode(data: bytes, compression: int, most: int) -> bytes:
    """The decoded bytes, no more than a run or code beyond ``most`` of them."""
    if compression == NONE:
        return data
    if compression == LZW:
        return lzw_decode(data, most)
    if compression == PACKBITS:
        return packbits_decode(data, most)
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


@dataclass
class Page:
    """One image directory: ``pixels`` has shape (height, width, samples)."""

    number: int
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows_per_strip: int = 64, planar: bool = False) -> bytes:
    """A little-endian TIFF of 8-bit pages of shape (height, width) or (height, width, samples).

    ``tile`` is (width, height), multiples of 16; without it the pages are cut into strips. ``planar``
    stores each sample of a page in blocks of its own.
    """
    return write_pages([(p, {"compression": compression, "predictor": predictor, "tile": tile, "rows_per_strip": rows_per_strip, "planar": planar}) for p in pages])


def write_pages(pages: list[tuple[np.ndarray, dict]]) -> bytes:
    """As :func:`write_tiff`, with options for each page; what a page leaves out is the default there."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for pixels, options in pages:
        compression, predictor, tile, rows_per_strip, planar = (options.get(k, d) for k, d in (("compression", DEFLATE), ("predictor", 1), ("tile", None), ("rows_per_strip", 64), ("planar", False)))
        pixels = np.atleast_3d(pixels).astype(np.uint8, copy=False)
        height, width, samples = pixels.shape
        blocks = []
        for plane in np.split(pixels, samples, axis=2) if planar else [pixels]:
            if tile:
                tw, th = tile
                padded = np.pad(plane, ((0, -height % th), (0, -width % tw), (0, 0)))
                blocks += [padded[y : y + th, x : x + tw] for y in range(0, height, th) for x in range(0, width, tw)]
            else:
                blocks += [plane[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
            data = _encode(np.ascontiguousarray(block).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        photometric = 2 if samples == 3 else 1
        fields = {WIDTH: (LONG, [width]), HEIGHT: (LONG, [height]), BITS: (SHORT, [8] * samples), COMPRESSION: (SHORT, [compression]), PHOTOMETRIC: (SHORT, [photometric]), SAMPLES: (SHORT, [samples]), PLANAR: (SHORT, [2 if planar else 1]), PREDICTOR: (SHORT, [predictor])}
        if tile:
            fields |= {TILE_WIDTH: (LONG, [tile[0]]), TILE_HEIGHT: (LONG, [tile[1]]), TILE_OFFSETS: (LONG, offsets), TILE_COUNTS: (LONG, counts)}
        else:
            fields |= {STRIP_OFFSETS: (LONG, offsets), ROWS_PER_STRIP: (LONG, [rows_per_strip]), STRIP_COUNTS: (LONG, counts)}
        entries = bytearray()
        for tag, (kind, values) in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}{'H' if kind == SHORT else 'I'}", *values)
            if len(packed) > 4:
                place = struct.pack("<I", len(out))
                out += packed + b"\0" * (len(packed) & 1)
            else:
                place = packed.ljust(4, b"\0")
            entries += struct.pack("<HHI", tag, kind, len(values)) + place
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(f"{order}H", data, at)
    tags = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        place = at + 2 + 12 * i + 8
        size = FIELD_BYTES.get(kind, 0) * n
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if kind in (1, SHORT, LONG):
            tags[tag] = struct.unpack_from(f"{order}{n}{ {1: 'B', SHORT: 'H', LONG: 'I'}[kind] }", data, place)
    (after,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count)
    return tags, after


def read_tiff(data: bytes, most: int = MOST_BYTES) -> Iterator[Page]:
    """The pages of a TIFF, in the order of its directories; :class:`TiffError` if it is broken or a
    page would take more than ``most`` bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("image directories form a loop")
        seen.add(at)
        if 18 * len(seen) > len(data):  # a directory takes that many bytes at least
            raise TiffError("image directories overlap")
        try:
            tags, after = _directory(data, at, order)
            page = _page(data, tags, order, len(seen) - 1, most)
        except TiffError:
            raise
        except (struct.error, LookupError, ValueError, ArithmeticError, MemoryError) as e:
            raise TiffError(f"broken image directory: {e!r}") from None
        yield page
        at = after


def _page(data: bytes, tags: dict[int, tuple], order: str, number: int, most: int) -> Page:
    def one(tag: int, default: int | None = None) -> int:
        values = tags.get(tag, () if default is None else (default,))
        if not values:
            raise TiffError(f"tag {tag} has no value")
        return values[0]

    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16, 32) or predictor not in (1, 2) or compression not in GROWTH or planar not in (1, 2) or len(set(tags.get(BITS, ()))) > 1:
        raise TiffError(f"{tags.get(BITS, bits)} bits, compression {compression}, predictor {predictor}, layout {planar}: not supported")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if not (width and height and samples and bw and bh):
        raise TiffError("a page without extent")
    across, planes, deep = -(-width // bw), samples if planar == 2 else 1, 1 if planar == 2 else samples
    in_plane = across * -(-height // bh)
    if len(offsets) != len(counts) or len(offsets) != in_plane * planes:
        raise TiffError(f"{len(offsets)} blocks where {in_plane * planes} belong")
    if any(place + size > len(data) for place, size in zip(offsets, counts, strict=True)):
        raise TiffError("a block beyond the end of the file")
    size = width * height * samples * kind.itemsize
    block_size = bw * bh * deep * kind.itemsize
    if size > most or block_size > most or size > sum(counts) * GROWTH[compression] or block_size > 1 + max(counts) * GROWTH[compression]:
        raise TiffError(f"a page of {size} bytes in blocks of {block_size} is more than the file can hold or {most}")
    pixels = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for i, (place, length) in enumerate(zip(offsets, counts, strict=True)):
        plane, within = divmod(i, in_plane)
        y, x = within // across * bh, within % across * bw
        rows = bh if tiled else min(bh, height - y)
        raw = _decode(data[place : place + length], compression, rows * bw * deep * kind.itemsize)
        block = np.frombuffer(raw, dtype=kind, count=rows * bw * deep).reshape(rows, bw, deep).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        to = slice(plane, plane + 1) if planar == 2 else slice(None)
        pixels[y : y + rows, x : x + bw, to] = block[: height - y, : width - x]
    return Page(number, width, height, bits, samples, compression, predictor, tiled, pixels)


def pages(df: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per page of each TIFF: (id, page, width, height, bits, samples, compression, tiled,
    mean, pixels, error). Null media give no row; broken media give a last row with ``error`` set."""
    names = ["id", "page", "width", "height", "bits", "samples", "compression", "tiled", "mean", "pixels", "error"]

    def rows(key, data):
        done = 0
        try:
            for p in read_tiff(data):
                done += 1
                yield key, p.number, p.width, p.height, p.bits, p.samples, p.compression, p.tiled, float(p.pixels.mean()) if p.pixels.size else 0.0, p.pixels.tobytes(), None
        except TiffError as e:
            yield key, done, None, None, None, None, None, None, None, None, str(e)

    def run(batches):
        for b in batches:
            found = [r for key, data in zip(b["id"], b["media"], strict=True) for r in rows(key, bytes(data))]
            yield pd.DataFrame(found, columns=names, dtype=object)

    # a broken file's row has no numbers, which pandas would turn into floats: object columns keep them
    schema = "page int, width int, height int, bits int, samples int, compression int, tiled boolean, mean double, pixels binary, error string"
    return map_rows(df.where(F.col(media_column).isNotNull()), id_column, {"media": F.col(media_column)}, run, schema, rows=100)


#: How a page may be stored: every codec, strips and tiles, with and without predictor.
FORMS = (
    {"compression": LZW, "predictor": 2},
    {"compression": PACKBITS, "tile": (32, 16)},
    {"compression": DEFLATE, "predictor": 2, "rows_per_strip": 256},
    {"compression": LZW, "tile": (64, 64)},
    {"compression": PACKBITS},
    {"compression": DEFLATE, "tile": (16, 128), "predictor": 2},
)


def store_payload(payload: bytes) -> bytes:
    """``payload``, a multiple of 64 bytes, as the samples of 64-wide TIFF pages of 1 MB at most. The
    checksums of a page choose its form, so every codec carries pages of every size."""
    parts = [payload[i : i + PAGE_BYTES] for i in range(0, len(payload), PAGE_BYTES)]
    return write_pages([(np.frombuffer(p, dtype=np.uint8).reshape(-1, BLOCK), FORMS[zlib.crc32(p) % len(FORMS)]) for p in parts])


def features(data: bytes) -> tuple[bytes, str]:
    """(the payload in a stored file, a text of page count, height, mean and byte histogram)."""
    parts, height = [], 0
    for p in read_tiff(data):
        parts.append(p.pixels.tobytes())
        height += p.height
    payload = b"".join(parts)
    histogram = np.bincount(np.frombuffer(payload, dtype=np.uint8) >> 5, minlength=8)
    mean = int(np.frombuffer(payload, dtype=np.uint8).sum(dtype=np.int64)) * 1000 // len(payload)
    return payload, f"pages={len(parts)};height={height};mean_milli={mean};hist={'/'.join(map(str, histogram.tolist()))}"


def store_documents(df: DataFrame) -> DataFrame:
    """Each text as UTF-8 padded with zero bytes to a positive multiple of 64, stored as TIFF, read
    back and described. Null texts are empty; null ids and repeated rows stay as they are."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def row(key, text):
        raw = (text or "").encode("utf-8")
        media = store_payload(raw + b"\0" * (-len(raw) % BLOCK or BLOCK * (not raw)))
        payload, feature = features(media)
        return key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for b in batches:
            yield pd.DataFrame([row(k, t) for k, t in zip(b["id"], b["text"], strict=True)], columns=names)

    out = map_rows(df, "doc_id", {"text": F.col("text")}, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows=500)
    return out.withColumnRenamed("id", "doc_id")
