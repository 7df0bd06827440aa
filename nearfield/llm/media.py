"""Media columns: Netpbm and BMP to numpy arrays, area resizing, NPY tiles, difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, 8 and 16 bit) and BMP (1, 4, 8, 24 and 32 bit,
uncompressed). ``resize`` averages exact areas by an integral image. ``tiles`` writes NPY files.
``difference_hash`` compares neighbours in a 9 x 8 reduction. Everything works on one value at a
time, so memory follows the largest single value, and rows need no shuffle.

Defined cases: null or empty text is the payload of 64 zero bytes; equal texts give equal values;
rows with a null key are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of the stored image.
WIDTH = 64


def encode_pgm(samples: np.ndarray) -> bytes:
    """Raw 8-bit PGM of a (height, width) array."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a (height, width, 3) array in RGB order."""
    h, w, _ = samples.shape
    pad = -(3 * w) % 4
    rows = np.zeros((h, 3 * w + pad), np.uint8)
    rows[:, : 3 * w] = samples[::-1, :, ::-1].reshape(h, 3 * w)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Integers of a Netpbm header (comments skipped) and the place after its last white space."""
    out, at = [], 2
    while len(out) < fields:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            if data[at : at + 1] == b"#":
                stop = data.find(b"\n", at)
                at = len(data) if stop < 0 else stop
            at += 1
        begin = at
        while data[at : at + 1].isdigit():
            at += 1
        if begin == at:
            raise ValueError("broken Netpbm header")
        out.append(int(data[begin:at]))
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    bitmap, raw, depth = kind in (1, 4), kind >= 4, 3 if kind in (3, 6) else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    w, h, top = *numbers[:2], 1 if bitmap else numbers[2]
    n = w * h * depth
    if not raw:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        if bitmap:
            values = np.frombuffer(bytes(c for c in body if c in b"01"), np.uint8)[:n] - 48
        else:
            values = np.array(body.split()[:n], np.int64)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w]
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    if values.size != n:
        raise ValueError("a Netpbm file that ends early")
    if bitmap:
        values = (1 - values) * 255
    return values.reshape((h, w, 3) if depth == 3 else (h, w)).astype(np.uint16 if top > 255 else np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packing = struct.unpack_from("<10xIIiiHHI", data)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of BMP that isn't read")
    flip, h = h > 0, abs(h)
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    rows = rows[::-1] if flip else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1].copy()
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        at = rows[:, :w]
    elif bits == 4:
        at = np.stack([rows >> 4, rows & 15], 2).reshape(h, -1)[:, :w]
    else:
        at = np.unpackbits(rows, axis=1)[:, :w]
    return palette[at]


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP bytes to an array: (h, w) for grey, (h, w, 3) for colour."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def grey(image: np.ndarray) -> np.ndarray:
    """Luma (BT.601 weights) of a colour image; grey images pass."""
    return image if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (size / parts)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area that each target sample covers.

    The integral image is taken over bands of rows, so that a tall image needs little memory.
    """
    low, rest = _edges(image.shape[0], height)
    # integral over rows, only at the target's edges
    at = np.empty((height + 1, image.shape[1]))
    whole = np.zeros(image.shape[1])
    seen = 0
    for k in range(height + 1):
        for a in range(seen, low[k], 1 << 14):
            whole = whole + image[a : min(a + (1 << 14), low[k])].sum(0, dtype=np.float64)
        seen = low[k]
        at[k] = whole + rest[k] * image[low[k]]
    table = np.zeros((height + 1, image.shape[1] + 1))
    np.cumsum(at, axis=1, out=table[:, 1:])
    left, part = _edges(image.shape[1], width)
    cut = table[:, left] + part * (table[:, left + 1] - table[:, left])
    total = np.diff(np.diff(cut, axis=0), axis=1)
    return total * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each sample of the 9 x 8 reduction brighter than its right neighbour."""
    small = resize(grey(image), 8, 9)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, height: int, width: int):
    """(row, column, NPY bytes) of each tile, in reading order; border tiles are smaller."""
    for i in range(0, image.shape[0], height):
        for j in range(0, image.shape[1], width):
            yield i // height, j // width, npy(image[i : i + height, j : j + width])


#: Columns that ``features`` returns after the key.
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, thumb_sha256 string, n_tiles long, tiles_sha256 string"
#: Rows of a tile.
TILE = 1024


def media(payload: bytes) -> bytes:
    """A payload, padded with zeros to whole rows of ``WIDTH`` samples (one at least), as a PGM file."""
    padded = payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def payload_features(payload: bytes) -> tuple:
    """Store a payload as media, decode it into NPY tiles, read the payload back from the tiles, and describe all of them."""
    stored = media(payload)
    image = decode(stored)
    digest, back_digest, n, last, size = hashlib.sha256(), hashlib.sha256(), 0, b"", 0
    for _, _, data in tiles(image, TILE, WIDTH):
        digest.update(data)
        body = np.load(io.BytesIO(data), allow_pickle=False).tobytes()
        back_digest.update(body)
        n, last, size = n + 1, body[-64:], size + len(body)
    thumb = np.rint(resize(image, 16, 16)).astype(np.uint8)
    thumb_digest = hashlib.sha256(b"".join(data for _, _, data in tiles(thumb, 16, 16))).hexdigest()
    return (len(payload), size, back_digest.hexdigest(), zlib.crc32(last), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), thumb_digest, n, digest.hexdigest())


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Features of every whole text stored as an image; one row per row of ``docs``."""
    kept = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").cast("binary").alias("payload"))
    names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)
    kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]

    def run(batches):
        for batch in batches:
            rows = [payload_features(x.as_py() or b"") for x in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [key, *names])

    return kept.mapInArrow(run, f"{key} long, {SCHEMA}")


def image_columns(images: DataFrame, key: str, content: str, height: int, width: int, tile: int) -> DataFrame:
    """Decode image files and write each, area-resized to (height, width), as NPY tiles.

    One row per tile: key, row, col, npy (bytes), dhash (of the whole image). Content that is null
    or not readable gives one row with null tile columns, so that no input row is lost.
    """

    def run(batches):
        for batch in batches:
            out = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decode(x.as_py() or b"")
                except (ValueError, struct.error, IndexError):
                    out.append((k, None, None, None, None))
                    continue
                mark = difference_hash(image)
                planes = [image] if image.ndim == 2 else [image[..., c] for c in range(3)]
                small = np.stack([np.rint(resize(p, height, width)) for p in planes], -1).astype(image.dtype)
                out += [(k, i, j, data, mark) for i, j, data in tiles(small if image.ndim == 3 else small[..., 0], tile, tile)]
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["key", "row", "col", "npy", "dhash"])

    kept = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))
    return kept.mapInArrow(run, "key string, row int, col int, npy binary, dhash string")
