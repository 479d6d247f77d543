"""Vectorised hashing of words and byte strings, shared by the operators of this package.

Texts are handled as UTF-8 bytes. Every character class that the operators use is closed over ASCII and takes all other
characters as word characters, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are hashed at a time.
CHUNK = 500_000
_powers: dict[str, np.ndarray] = {}


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), BASE if kind == "up" else INVERSE, U)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: True for the bytes of words: all but white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: True for the bytes of words: ASCII digits and letters and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of texts that are joined into one buffer.

    hash: 64-bit hash of each word; start, end: its bytes in buf; first: first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool = True) -> None:
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        buf = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
        self.buf = LOWER[buf] if lower else buf
        self.text_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
        flag = np.zeros(len(buf) + 2, np.int8)
        flag[1:-1] = kind[buf]
        edge = np.diff(flag)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(buf) + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * _pow("up", len(buf)), out=sums[1:])
        self.sums = sums
        self.hash = mix((sums[self.end] - sums[self.start]) * _pow("down", len(buf) + 1)[self.start] + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, self.text_at)

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(which words have more than k bytes, hashes of their first k)."""
        long = np.flatnonzero(self.end - self.start > k)
        at = self.start[long]
        return long, mix((self.sums[at + k] - self.sums[at]) * _pow("down", len(self.buf) + 1)[at] + U(k + 1000))

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words that begin at each word; windows may run over the end of a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        out = np.zeros(n, U)
        for i in range(k):
            out = out * BASE + self.hash[i : i + n]
        return mix(out)


def chunks(texts: list[bytes], most: int = CHUNK):
    """(first, last) of runs of texts of about that many bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def utf8(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
