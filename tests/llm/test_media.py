import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import media

RNG = np.random.default_rng(0)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_payloads(payload):
    n, size, digest, crc, stored, stored_digest, feature, thumb, n_tiles, tiles = media.payload_features(payload)
    padded = payload + bytes((-len(payload)) % 64 or (64 if not payload else 0))
    assert n == len(payload) and size == len(padded) and size % 64 == 0 and size > 0
    assert digest == hashlib.sha256(padded).hexdigest() and crc == zlib.crc32(padded[-64:])
    file = b"P5\n64 %d\n255\n" % (size // 64) + padded
    assert stored == len(file) and stored_digest == hashlib.sha256(file).hexdigest()
    assert len(feature) == 16 and media.payload_features(payload) == (n, size, digest, crc, stored, stored_digest, feature, thumb, n_tiles, tiles)
    assert n_tiles == -(-size // (media.TILE * media.WIDTH)) and len(tiles) == 64


def test_netpbm_kinds():
    grey, colour = RNG.integers(0, 256, (5, 7), np.uint8), RNG.integers(0, 256, (4, 3, 3), np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey)
    assert np.array_equal(media.decode(media.encode_ppm(colour)), colour)
    plain = "P2 # a comment\n7 5\n# another\n255\n" + " ".join(map(str, grey.ravel()))
    assert np.array_equal(media.decode(plain.encode()), grey)
    plain = "P3\n3 4 255\n" + "\n".join(map(str, colour.ravel()))
    assert np.array_equal(media.decode(plain.encode()), colour)
    bits = RNG.integers(0, 2, (3, 11), np.uint8)
    assert np.array_equal(media.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes()), (1 - bits) * 255)
    assert np.array_equal(media.decode(f"P1\n11 3\n{''.join(map(str, bits.ravel()))}".encode()), (1 - bits) * 255)
    deep = RNG.integers(0, 60_000, (2, 3))
    assert np.array_equal(media.decode(b"P5 3 2 65535\n" + deep.astype(">u2").tobytes()), deep)


@pytest.mark.parametrize("bits", [1, 4, 8, 24, 32])
@pytest.mark.parametrize("width", [1, 5, 8])
def test_bmp_kinds(bits, width):
    import struct

    h = 3
    if bits >= 24:
        image = RNG.integers(0, 256, (h, width, 3), np.uint8)
        body = image[:, :, ::-1] if bits == 24 else np.concatenate([image[:, :, ::-1], np.zeros((h, width, 1), np.uint8)], 2)
        rows, palette = body.reshape(h, -1), b""
    else:
        colours = RNG.integers(0, 256, (1 << bits, 4), np.uint8)
        at = RNG.integers(0, 1 << bits, (h, width), np.uint8)
        image, palette = colours[at][:, :, 2::-1], colours.tobytes()
        if bits == 8:
            rows = at
        elif bits == 4:
            even = np.pad(at, ((0, 0), (0, width % 2)))
            rows = even[:, ::2] << 4 | even[:, 1::2]
        else:
            rows = np.packbits(at, axis=1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    for height, order in ((h, rows[::-1]), (-h, rows)):
        start = 54 + len(palette)
        data = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, 0, 0, 0, 0, 0) + palette + order.tobytes()
        assert np.array_equal(media.decode(data), image)
    if bits == 24:
        assert np.array_equal(media.decode(media.encode_bmp(image)), image)


def brute_resize(image, height, width):
    """Mean of each target cell, by fine sampling of a common multiple grid."""
    fine = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    return fine.reshape(height, image.shape[0], width, image.shape[1]).mean((1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 64), (130, 3), (8, 9)])
@pytest.mark.parametrize("to", [(1, 1), (8, 9), (16, 16), (3, 20)])
def test_area_resize(shape, to):
    image = RNG.integers(0, 256, shape)
    assert np.allclose(media.resize(image, *to), brute_resize(image, *to))


def test_tiles_cover_the_image():
    image = RNG.integers(0, 256, (10, 7), np.uint8)
    back = np.zeros_like(image)
    for i, j, data in media.tiles(image, 4, 4):
        part = np.load(io.BytesIO(data))
        back[4 * i : 4 * i + part.shape[0], 4 * j : 4 * j + part.shape[1]] = part
    assert np.array_equal(back, image)


def test_difference_hash():
    ramp = np.tile(np.arange(90), (16, 1))
    assert media.difference_hash(ramp) == "0" * 16 and media.difference_hash(ramp[:, ::-1]) == "f" * 16


def test_frames(spark):
    rows = [(1, "héllo", 5), (2, None, 6), (3, "", 7), (None, "héllo", 8), (4, "z" * 3_000_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.doc_id: r for r in media.features(docs).collect()}
    assert got[1][1:] == got[None][1:] and got[2][1:] == got[3][1:]
    assert got[2].n_bytes == 0 and got[2].payload_bytes == 64 and got[4].payload_bytes == 3_000_000
    assert media.features(docs.limit(0)).collect() == []


def test_image_columns(spark):
    image = RNG.integers(0, 256, (20, 30, 3), np.uint8)
    rows = [("a", media.encode_ppm(image)), ("b", media.encode_bmp(image)), ("bad", b"GIF89a"), ("none", None), ("cut", media.encode_pgm(image[..., 0])[:50])]
    got = media.image_columns(spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in rows], "id string, data binary"), "id", "data", 8, 8, 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r)
    assert len(by["a"]) == 4 and [r.npy for r in by["a"]] == [r.npy for r in by["b"]]
    assert all(len(by[k]) == 1 and by[k][0].npy is None for k in ("bad", "none", "cut"))
