"""NumPy kernels shared by the operators that work on whole texts.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Those delimiters are ASCII, so UTF-8
bytes can be cut without decoding. Every kernel works on a list of texts at once and holds a few arrays of the
size of the texts; callers hand over batches of a few MB, and only a single longer text makes a longer batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODES_LOWER = _CODES[_LOWER]

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * _PIECE:
            _POWERS[base] = have
    return have[:n]


class Words:
    """The words of some texts: 64-bit hashes, byte ranges in ``data`` and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False, breaks: np.ndarray = SPACE):
        self.buffer = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))
        space = breaks[data]
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            turn = np.concatenate(([0], turn))
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.data = data
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.codes = _CODES_LOWER if lower else _CODES
        self.hashes = self.prefixes()

    def prefixes(self, most: int | None = None) -> np.ndarray:
        """Hashes of the words, or of their first ``most`` bytes; equal bytes have equal hashes."""
        codes, out = self.codes, np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            lo = self.starts[i]
            j = max(int(np.searchsorted(self.ends, lo + _PIECE, side="right")), i + 1)
            n = int(self.ends[j - 1] - lo)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(codes[self.data[lo : lo + n]] * _powers(_BASE, n), out=total[1:])
            at, to = self.starts[i:j] - lo, self.ends[i:j] - lo
            if most is not None:
                to = np.minimum(to, at + most)
            out[i:j] = mix((total[to] - total[at]) * _powers(_INVERSE, n)[at] + (to - at).astype(np.uint64))
            i = j
        return out

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` words, at its first word. Runs that cross texts are there too."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    if n <= 8:
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out *= np.uint64(_BASE)
            out += hashes[k : len(hashes) - n + 1 + k]
        return mix(out + np.uint64(n))
    out = np.empty(len(hashes) - n + 1, dtype=np.uint64)
    for lo in range(0, len(out), _PIECE):
        part = hashes[lo : lo + _PIECE + n - 1]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _powers(_BASE, len(part)), out=total[1:])
        here = len(part) - n + 1
        out[lo : lo + here] = mix((total[n:] - total[:here]) * _powers(_INVERSE, here) + np.uint64(n))
    return out


def gram_mask(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the ``size`` runs that grams() returns lie in one text."""
    out = np.ones(size, dtype=bool)
    for back in range(1, n):
        at = first[1:] - back
        out[at[(at >= 0) & (at < size)]] = False
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from each ``first`` to the next."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def covered(marks: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of the words lie in a run of ``n`` words whose first word is marked."""
    change = np.zeros(words + 1, dtype=np.int32)
    at = np.flatnonzero(marks)
    np.add.at(change, at, 1)
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def blocks(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a column of texts (None reads as empty) into lists of about ``most`` bytes, each with its first row."""
    at, out, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if out and size + len(raw) > most:
            yield at, out
            at, out, size = i, [], 0
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield at, out
