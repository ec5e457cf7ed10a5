"""Media columns: PNG in binary columns, written, read back and hashed.

Payload bytes become 8-bit grey samples of a picture 64 wide. The writer filters rows,
deflates them and frames chunks with checksums. The reader tests the signature, every
chunk's CRC-32 and the deflate stream's own checksum, then undoes the filters with
array operations over runs of rows. The feature is a perceptual hash: signs of the
low-frequency cosine-transform coefficients against their median.

Nulls and empty texts are pictures of one row of zero bytes. Texts of any length make
pictures of as many rows. Equal payloads give equal media and features. A picture that
fails a test raises ``ValueError``. Repeated rows give repeated rows, null ids stay null, an
empty table gives no rows, and columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import pieces, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def payload(text: bytes) -> bytes:
    """The bytes, filled with 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A grey 8-bit PNG; each row has whichever filter of none, left and up gives the smallest sum."""
    h, w = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    cost = np.stack([np.minimum(x, -x).sum(1, dtype=np.int64) for x in (samples, left, up)])
    kind = cost.argmin(0).astype(np.uint8)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.where(kind[:, None] == 0, samples, np.where(kind[:, None] == 1, left, up))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kind, out = rows[:, 0], rows[:, 1:].copy()
    cuts = np.append(np.flatnonzero(np.append(True, kind[1:] != kind[:-1])), len(kind))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        k, above = kind[lo], out[lo - 1] if lo else np.zeros(out.shape[1], np.uint8)
        if k == 1:
            np.cumsum(out[lo:hi], axis=1, dtype=np.uint8, out=out[lo:hi])
        elif k == 2:
            out[lo] += above
            np.cumsum(out[lo:hi], axis=0, dtype=np.uint8, out=out[lo:hi])
        elif k in (3, 4):
            for i in range(lo, hi):
                row, b, a, c = out[i], out[i - 1].astype(int) if i else np.zeros(out.shape[1], int), 0, 0
                for x in range(len(row)):
                    if k == 3:
                        guess = (a + b[x]) // 2
                    else:
                        p = a + b[x] - c
                        guess = min((abs(p - a), 0, a), (abs(p - b[x]), 1, b[x]), (abs(p - c), 2, c))[2]
                    a, c = (int(row[x]) + int(guess)) & 255, b[x]
                    row[x] = a
        elif k:
            raise ValueError(f"unknown filter {k}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG that is not interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        at += 12 + n
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a complete grey 8-bit picture")
    w, h = head[:2]
    try:
        rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if rows.size != h * (w + 1):
        raise ValueError("rows are missing")
    return _unfilter(rows.reshape(h, w + 1))


@lru_cache(maxsize=4096)
def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(low)[:, None]).astype(np.float32)


def cosine_hash(samples: np.ndarray, low: int = 8) -> str:
    """Signs of the low-frequency coefficients against their median, as hex digits."""
    h, w = samples.shape
    rows = np.zeros((low, w), np.float32)
    for at in range(0, h, 1 << 14):  # bounded memory for long pictures
        part = samples[at : at + (1 << 14)].astype(np.float32)
        rows += (_cosines(h, low) if h <= 2048 else np.cos(np.pi / h * (np.arange(at, at + len(part)) + 0.5) * np.arange(low)[:, None]).astype(np.float32))[:, at if h <= 2048 else 0 :][:, : len(part)] @ part
    c = np.rint((rows @ _cosines(w, low).T).astype(np.float64) * 16 / max(h, 1)).ravel()
    bits = c > np.median(c[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the texts' payloads as PNG."""

    def write(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                buf, offs = utf8(part.column(1))
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(offs[:-1], offs[1:])]
                media = [encode_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads stored pictures of ``media(doc_id, n_bytes, media)`` and computes digests and the hash."""

    def read(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for m in batch.column(2):
                data = m.as_py()
                samples = decode_png(data)
                raw = samples.tobytes()
                for c, v in zip(out, (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples))):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=names)

    return media.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
