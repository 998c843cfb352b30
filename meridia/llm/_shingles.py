"""Word shingles of a text as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

SPAN = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Odd multipliers for the places of a shingle, and of sequences shorter than a shingle, by length.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SHORT = np.array([0, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of the words of texts: sums of byte codes times powers of an odd number, over prefix sums of all bytes.

    Texts are taken together up to LIMIT bytes, a longer one in parts that end at blanks, so memory stays bounded.
    """

    LIMIT = 1 << 20
    _BASE = 0x9FB21C651E98DF25

    def __init__(self):
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * _PLACE[2])
        self.blank = np.zeros(256, np.bool_)
        self.blank[list(b" \t\n\v\f\r")] = True
        self._tables(self.LIMIT)

    def _tables(self, n: int) -> None:
        power = np.full(n, self._BASE, np.uint64)
        inverse = np.full(n, pow(self._BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def _hash(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        if len(raw) > len(self.power):
            self._tables(len(raw))
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~self.blank[raw]
        step = np.diff(inside)
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.code[raw] * self.power[: len(raw)], out=run[1:])
        return mix((run[end] - run[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)), begin

    def _one(self, text: bytes) -> np.ndarray:
        out, raw, at = [], np.frombuffer(text, np.uint8), 0
        while at < len(raw):
            end = at + self.LIMIT
            while end < len(raw) and not self.blank[raw[end]]:
                end += 1
            out.append(self._hash(raw[at:end])[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def of_many(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
        out: list[np.ndarray] = []
        at = 0
        while at < len(plain):
            size, to = len(plain[at]) + 1, at + 1
            while to < len(plain) and size + len(plain[to]) < self.LIMIT:
                size += len(plain[to]) + 1
                to += 1
            if to == at + 1:
                out.append(self._one(plain[at]))
            else:
                words, begin = self._hash(np.frombuffer(b"\n".join(plain[at:to]), np.uint8))
                edge = np.cumsum([len(p) + 1 for p in plain[at:to]])
                out.extend(np.split(words, np.searchsorted(begin, edge[:-1])))
            at = to
        return out

    def of(self, text: str | None) -> np.ndarray:
        return self.of_many([text])[0]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words has its whole sequence as one, a text without words none."""
    n = len(words)
    if n == 0:
        return words
    if n < SPAN:
        return mix((words * _PLACE[:n]).sum(keepdims=True) + _SHORT[n : n + 1])
    total = words[: n - SPAN + 1] * _PLACE[0]
    for k in range(1, SPAN):
        total += words[k : n - SPAN + 1 + k] * _PLACE[k]
    return np.unique(mix(total))


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers of a set, the same for equal sets."""
    size = np.array([len(shingles)], np.uint64)
    one = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + size * _PLACE[1]
    two = mix(shingles * _PLACE[3] + _PLACE[2]).sum(keepdims=True) + size * _PLACE[4]
    return int(mix(one).view(np.int64)[0]), int(mix(two).view(np.int64)[0])


#: Bits of a parity sketch.
PARITY_BITS = 512


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether the shingles of each of PARITY_BITS parts of the universe are odd in number, as signed 64-bit words.

    Two sets differ in at least as many shingles as their sketches do in bits.
    """
    odd = np.bincount((shingles & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)
