"""Sets of word shingles as 64-bit hashes.

A word is hashed by XXH3, shingles from their words' hashes. That two different shingles get one hash has a chance of about
2**-64, so a join of documents with S shingles in all meets one with a chance of about S * S / 2**65.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

WORDS = 5
#: Bytes of a text that are taken at a time, and up to the next white space.
CHUNK = 1 << 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = re.compile(rb"[ \t-\r]")


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _MIX


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words: runs of bytes other than white space of ASCII, A-Z as a-z; a word may be of any length."""
    parts, a = [np.zeros(0, np.uint64)], 0
    while a < len(text):
        gap = _SPACE.search(text, a + CHUNK)
        b = gap.start() if gap else len(text)
        words = text[a:b].lower().split()
        parts.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        a = b
    return np.concatenate(parts) if len(parts) > 2 else parts[-1]


def shingle_set(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of `size` words; of fewer words, the one of the whole sequence."""
    if not len(words):
        return words
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        h = words[: len(words) - width + 1] + np.uint64(width)
        for j in range(1, width):
            h = _mixed(h) + words[j : len(words) - width + 1 + j]
        h = _mixed(_mixed(h))
    return np.unique(h)


def batch_sets(column, size: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow string column; null and empty texts have none."""
    for text in column:
        yield shingle_set(word_hashes(text.as_buffer().to_pybytes() if text.is_valid else b""), size)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
