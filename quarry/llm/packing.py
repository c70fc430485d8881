"""Arrays of numbers as one small binary value: each in the narrowest width, its bytes by place, compressed."""

from __future__ import annotations

import ctypes
import struct

import numpy as np
import pyarrow as pa

CODEC = "zstd"


def narrow(x: np.ndarray) -> np.ndarray:
    if x.dtype.kind in "iu" and len(x) and x.dtype.itemsize > 1 and (x.dtype.kind == "u" or x.min() >= 0):
        top = int(x.max())
        return x.astype(next(t for t, most in ((np.uint8, 255), (np.uint16, 65535), (np.uint32, 2**32 - 1), (np.uint64, 2**64)) if top <= most))
    return x


def give_back() -> None:
    """Return memory that is free to the system, so that a worker holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    head, body = [], []
    for x in arrays:
        small = narrow(np.ascontiguousarray(x))
        head.append(struct.pack("<2s2sq", x.dtype.str[1:].encode(), small.dtype.str[1:].encode(), len(small)))
        body.append(np.ascontiguousarray(small.view(np.uint8).reshape(len(small), -1).T).tobytes() if len(small) else b"")
    raw = struct.pack("<q", len(arrays)) + b"".join(head) + b"".join(body)
    return struct.pack("<q", len(raw)) + pa.Codec(CODEC, compression_level=1).compress(raw, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<q", value)
    raw = pa.Codec(CODEC).decompress(memoryview(value)[8:], decompressed_size=size, asbytes=True)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8 + 12 * n, []
    for i in range(n):
        kind, small, count = struct.unpack_from("<2s2sq", raw, 8 + 12 * i)
        t = np.dtype(small.decode())
        planes = np.frombuffer(raw, np.uint8, count * t.itemsize, at).reshape(t.itemsize, count)
        at += count * t.itemsize
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(count).astype(np.dtype(kind.decode())))
    return out
