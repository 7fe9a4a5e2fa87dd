"""Hashes of words and windows of words, and compact blobs of integers."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

_ODD = (np.uint64(0x9E3779B97F4A7C1B), np.uint64(0xC2B2AE3D27D4EB53))  # 3 modulo 8: powers differ in a low bit


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Windows:
    """128-bit hashes of all windows of ``size`` consecutive words, in two lanes."""

    def __init__(self, size: int):
        self.size = size
        self.scale = [_powers(size, b)[::-1].copy() for b in _ODD]

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(words) - self.size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2)
        out = []
        with np.errstate(over="ignore"):
            for lane, scale in zip((0, 1), self.scale):
                word = lanes[:, lane].astype(np.uint64)
                total = np.zeros(n, np.uint64)
                for k in range(self.size):
                    total += word[k : k + n] * scale[k]
                out.append(mixed(total))
        return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input reaches the high bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def squeeze(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as byte planes under zstd."""
    packer = zstandard.ZstdCompressor(level=1)
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T) for c in columns]
    return packer.compress(b"".join(p.tobytes() for p in planes))


def expand(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """The columns that ``squeeze`` packed."""
    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * size
    return out
