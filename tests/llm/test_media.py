import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import media


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600))
def test_codecs_round_trip(data):
    assert media.packbits_decode(media.packbits_encode(data), len(data)) == data
    assert media.lzw_decode(media.lzw_encode(data), len(data)) == data
    runs = b"".join(bytes((b,)) * (b + 1) for b in data[:50])
    assert media.packbits_decode(media.packbits_encode(runs), len(runs)) == runs


@pytest.mark.parametrize("alphabet", [1, 2, 5, 256])
def test_lzw_widens_and_clears(alphabet):
    data = np.random.default_rng(alphabet).integers(0, alphabet, 60_000).astype(np.uint8).tobytes()
    assert media.lzw_decode(media.lzw_encode(data), len(data)) == data


def test_packbits_of_the_specification():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert media.packbits_decode(packed, 100) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.PACKBITS, media.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 16)])
@pytest.mark.parametrize("planar", [False, True])
def test_files_round_trip(compression, predictor, tile, planar):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, s).astype(np.uint8) for s in ((5, 7), (33, 50), (20, 20, 3), (1, 1))]
    found = list(media.read_tiff(media.write_tiff(images, compression, predictor, tile, rows_per_strip=8, planar=planar)))
    assert [p.number for p in found] == [0, 1, 2, 3]
    for image, page in zip(images, found, strict=True):
        assert (page.pixels == np.atleast_3d(image)).all() and page.tiled == bool(tile)


def test_big_endian_16_bit_file():
    pixels = np.arange(6, dtype=">u2").reshape(2, 3)
    tags = [(256, 4, 3), (257, 4, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 2), (279, 4, 12)]
    body = pixels.tobytes()
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">I", v) if k == 4 else struct.pack(">HH", v, 0)) for t, k, v in tags)
    data = b"MM" + struct.pack(">HI", 42, 8 + len(body)) + body + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0"
    (page,) = media.read_tiff(data)
    assert page.bits == 16 and (page.pixels[:, :, 0] == pixels).all()


def test_broken_files(spark):
    good = media.write_tiff([np.zeros((4, 4), np.uint8)] * 2)
    rows = [(1, good), (2, b"no tiff"), (3, good[:40]), (4, None), (None, good), (6, good[:-40])]
    out = media.pages(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()
    assert [r.page for r in out if r.id == 1] == [0, 1] and [r.page for r in out if r.id is None] == [0, 1]
    assert all(any(r.error for r in out if r.id == k) for k in (2, 3, 6)) and not [r for r in out if r.id == 4]


def directory(**tags):
    """A file of one directory with the given tags (number, field type, values) and eight bytes of samples."""
    entries = b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in tags.values())
    return b"II*\0" + struct.pack("<I", 16) + b"\0" * 8 + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def long(v):
    return struct.pack("<I", v)


PLAIN = {"w": (256, 4, 1, long(4)), "h": (257, 4, 1, long(2)), "b": (258, 3, 1, long(8)), "c": (259, 3, 1, long(1)), "o": (273, 4, 1, long(8)), "n": (279, 4, 1, long(8))}
BROKEN = [
    {"w": (256, 4, 1, long(0))}, {"h": (257, 4, 1, long(0))}, {"w": (256, 4, 0, long(4))}, {"b": (258, 3, 0, long(8))}, {"w": (256, 4, 1, long(2**32 - 1)), "h": (257, 4, 1, long(2**32 - 1))},
    {"w": (256, 4, 2**32 - 1, long(4))}, {"b": (258, 3, 1, long(7))}, {"c": (259, 3, 1, long(77))}, {"c": (259, 3, 1, long(8))}, {"c": (259, 3, 1, long(5))}, {"o": (273, 4, 1, long(2**31))},
    {"n": (279, 4, 1, long(2**31))}, {"n": (279, 4, 1, long(3))}, {"o": (273, 4, 0, long(8))}, {"r": (278, 4, 1, long(0))}, {"r": (278, 4, 1, long(1))}, {"s": (277, 3, 1, long(0))}, {"s": (277, 3, 1, long(60000))},
    {"p": (317, 3, 1, long(9))}, {"p": (284, 3, 1, long(3))}, {"t": (324, 4, 1, long(8))}, {"n": (279, 2, 1, long(8))},
]


def test_every_fault_is_a_tiff_error(spark):
    (page,) = media.read_tiff(directory(**PLAIN))
    assert page.pixels.shape == (2, 4, 1)
    files = [directory(**(PLAIN | tags)) for tags in BROKEN]
    for data in files:
        with pytest.raises(media.TiffError):
            list(media.read_tiff(data))
    out = media.pages(spark.createDataFrame([(i, d) for i, d in enumerate(files)], "doc_id long, media binary"), "doc_id", "media").collect()
    assert len(out) == len(files) and all(r.error and r.page == 0 for r in out)


def test_bombs_are_refused():
    small = media.write_tiff([np.zeros((2000, 2000), np.uint8)], rows_per_strip=2000)
    with pytest.raises(media.TiffError, match="more than"):
        list(media.read_tiff(small, most=1_000_000))
    assert len(list(media.read_tiff(small))) == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 5), st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), max_size=8), st.integers(0, 200))
def test_damaged_files_never_crash(form, changes, cut):
    pixels = np.arange(640, dtype=np.uint8).reshape(10, 64)
    data = bytearray(media.write_pages([(pixels, media.FORMS[form])] * 2))
    for at, value in changes:
        data[-(at % min(400, len(data))) - 1] = value
    try:
        assert all(p.pixels.size for p in media.read_tiff(bytes(data[: len(data) - cut])))
    except media.TiffError:
        pass


def test_directory_loop():
    data = bytearray(media.write_tiff([np.zeros((4, 4), np.uint8)]))
    (first,) = struct.unpack_from("<I", data, 4)
    data[-4:] = struct.pack("<I", first)
    with pytest.raises(media.TiffError, match="loop"):
        list(media.read_tiff(bytes(data)))


def test_documents(odd_docs, no_docs):
    rows = media.store_documents(odd_docs).collect()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(rows) == odd_docs.count()
    for r in rows:
        fits = [t for t in texts[r.doc_id] if len(t) == r.n_bytes]
        payload = fits[0] + b"\0" * ((-len(fits[0])) % 64 or (0 if fits[0] else 64))
        assert r.payload_bytes == len(payload) > 0 and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    same = {tuple(r)[1:] for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert media.store_documents(no_docs).collect() == []


def test_all_codecs_store_documents():
    met = {"small": set(), "large": set()}
    for n in (*range(64, 64 * 40, 64), *(50_000 // 64 * 64 + 64 * i for i in range(30)), 3 << 20):
        payload = bytes(np.random.default_rng(n).integers(32, 127, n).astype(np.uint8))
        stored = media.store_payload(payload)
        assert media.features(stored)[0] == payload
        found = list(media.read_tiff(stored))
        assert len(found) == -(-n // media.PAGE_BYTES)
        met["small" if n < 10_000 else "large"].update((p.compression, p.tiled) for p in found)
    assert all(len(x) == len(media.FORMS) for x in met.values())
