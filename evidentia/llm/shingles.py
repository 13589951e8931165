"""Words and shingles of text batches as 64-bit hashes, vectorised with numpy.

Words are runs of characters other than space and the control characters 9 to
13, after lower-casing A-Z. ``bytes.lower`` and ``bytes.split`` follow just
that rule, and so does the byte table used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE, _LEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but letters: words without digits and punctuation.
NOT_LETTERS = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])
#: Texts are handled in runs of about this many bytes, so arrays stay in cache.
RUN_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def runs(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices (from, to, lower-cased bytes) of about ``RUN_BYTES`` each."""
    begin, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(encode(text))
        total += len(held[-1])
        if total >= RUN_BYTES:
            yield begin, i + 1, held
            begin, held, total = i + 1, [], 0
    if held:
        yield begin, len(texts), held


class Words:
    """The words of a run of texts.

    ``start`` and ``size`` are in bytes of ``data``; ``ptr[i]:ptr[i + 1]`` are
    the words of text ``i``; ``at`` is each text's first byte.
    """

    def __init__(self, raw: list[bytes], breaks: np.ndarray = _SPACE):
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        space = breaks[self.data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, end = edge[0::2], edge[1::2]
        self.size = end - self.start
        lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        self.ptr = np.searchsorted(self.start, self.at)

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.size if prefix is None else np.minimum(self.size, prefix)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        powers = np.cumprod(np.full(int(size.max()), _BASE, dtype=np.uint64))
        values = (self.data[np.repeat(self.start, size) + place].astype(np.uint64) + np.uint64(1)) * powers[place]
        return mix64(np.add.reduceat(values, first) + size.astype(np.uint64) * _LEN)


def shingle_sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with fewer words, the whole sequence is one."""
    words = Words(raw)
    h = words.hashes()
    n = len(h)
    if n >= k:
        grams = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            grams *= _BASE
            grams += h[j : n - k + 1 + j]
        grams = mix64(grams)
    out = []
    for begin, end in zip(words.ptr[:-1], words.ptr[1:], strict=True):
        if end - begin >= k:
            out.append(np.unique(grams[begin : end - k + 1]))
        elif end > begin:
            whole = np.zeros(1, dtype=np.uint64)
            for i in range(begin, end):
                whole = whole * _BASE + h[i : i + 1]
            out.append(mix64(whole + np.array([end - begin], dtype=np.uint64) * _LEN))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
