"""Words, and hashes of word shingles, of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from spinward.llm.common import ASCII_LOWER

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """64-bit hashes of words, each computed once; forgets them beyond `limit`."""

    def __init__(self, limit: int = 400_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def hashes(self, text: bytes) -> np.ndarray:
        """Hashes of the words `[^\\x20\\x09-\\x0D]+` of the text, A-Z lower-cased."""
        words = text.translate(ASCII_LOWER).split()
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` successive words; of all of them if they are fewer; none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ words[k : n - size + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
        out *= _STEP
        out ^= out >> np.uint64(32)
    return out


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(rolled(words, size))


def set_digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()
