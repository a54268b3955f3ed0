"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

A word's hash is a polynomial over random values of its bytes, modulo 2**64, and is mixed afterwards.  All
words of a text are hashed at once: each byte's value is multiplied by a power of the base that goes by its
place in the text, sums are taken from word to word, and the power of a word's start is divided out again
(the base is odd, so it has an inverse).  Long texts are taken in blocks that end between words, so only the
powers of one block are kept; a word longer than a block has powers of its own for a moment.  Two different
shingles of one pair of documents share a hash with a probability of about 1e-13 for the longest texts.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2 = np.uint64(32), np.uint64(29)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 17


_KEPT: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of the base and of its inverse; those of a block are kept."""
    if _KEPT and n <= BLOCK:
        return _KEPT[0], _KEPT[1]
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


_KEPT += powers(BLOCK)


class Words:
    """Hashes of the runs between separator bytes, A-Z taken as a-z unless `fold` is off."""

    def __init__(self, separators: bytes, fold: bool = True):
        values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.values = np.where(self.inside, values, np.uint64(0))

    def _block(self, raw: np.ndarray) -> np.ndarray:
        inside = self.inside[raw]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if len(raw) and inside[0]:
            starts = np.concatenate((np.zeros(1, np.int64), starts))
        if not len(starts):
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(raw))
        return np.add.reduceat(self.values[raw] * power[: len(raw)], starts) * inverse[starts]

    def _blocks(self, raw: np.ndarray):
        begin = 0
        while begin < len(raw):
            end = min(begin + BLOCK, len(raw))
            if end < len(raw) and self.inside[raw[end]]:
                gaps = np.flatnonzero(~self.inside[raw[begin:end]])
                if len(gaps):
                    end = begin + int(gaps[-1]) + 1
                while not len(gaps) and end < len(raw):  # one word from end to end: to where it ends
                    further = np.flatnonzero(~self.inside[raw[end : end + BLOCK]])
                    end = end + int(further[0]) if len(further) else min(end + BLOCK, len(raw))
                    gaps = further
            yield self._block(raw[begin:end])
            begin = end

    def hashes(self, text: bytes | None) -> np.ndarray:
        raw = np.frombuffer(text or b"", np.uint8)
        out = self._block(raw) if len(raw) <= BLOCK else np.concatenate(list(self._blocks(raw)))
        out ^= out >> _S1
        out *= _M1
        out ^= out >> _S2
        return out


#: Words between ASCII white space.
PLAIN = Words(b" \t\n\x0b\x0c\r")


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words, in the text's order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out ^= hashes[j : j + n]
        out *= _M1
        out ^= out >> _S1
    out *= _M2
    out ^= out >> _S2
    return out


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Distinct shingles in ascending order; a text of fewer than k words is one shingle, one without words has none."""
    hashes = PLAIN.hashes(text)
    if not len(hashes):
        return hashes
    out = np.sort(windows(hashes, min(k, len(hashes))))
    return out[np.concatenate((np.ones(1, bool), out[1:] != out[:-1]))]
