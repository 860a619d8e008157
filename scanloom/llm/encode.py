"""Token ids of whole texts from a `tokenizers` file, with the words' ids remembered per Python worker."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .shared import LONGEST_REMEMBERED, WORKER_CACHES, Remembered, make_room

#: Words and pieces remembered per worker; their number bounds its memory.
WORDS, PIECES = 700_000, 700_000
_SEPARATORS = "\x1c", "\x1d", "\x1e", "\x1f"
_PLAIN_SPACE = re.compile("[ \t\n\r]+")
#: Words of these characters (no digits but 0-9, no letter whose lower case has two) need no normaliser but lower().
_LATIN = re.compile("[!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017f]+")
#: The file's own splitting pattern on such words; must equal what `_splits_at_white_space` checks.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Per worker: the encoder of each file.
_encoders: dict[str, "WordEncoder"] = {}
WORKER_CACHES.append(_encoders)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next unused one from 256."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


class WordEncoder:
    """Encodes a text word by word when the file's normaliser and splitter never join text across white space.

    That holds if its pre-tokeniser splits by a pattern whose matches hold no white space and drops the rest, and
    its normaliser maps white space to white space only; `by_words` checks the file for exactly this shape. Any
    other file is given whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = self._splits_at_white_space(spec)
        self.words = Remembered(self._word, WORDS)
        self.pieces = Remembered(self._piece, PIECES)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    @staticmethod
    def _splits_at_white_space(spec: dict) -> bool:
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": r"\s+"}:
            return False
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"]:
            return False
        covers = steps[0]["pattern"].get("Regex") == _PATTERN
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        return steps[0]["behavior"] == "Removed" and steps[0]["invert"] and covers and plain

    def _word(self, word: str) -> bytes:
        """Ids of a word: piece by piece if it is plain Latin and holds no special token, else by the tokenizer."""
        if _LATIN.fullmatch(word) and "<|" not in word and len(word) <= LONGEST_REMEMBERED:
            return b"".join(map(self.pieces.__getitem__, _LATIN_PIECES.findall(word.lower())))
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one split piece by the tokenizer's merging model, which sees bytes as letters."""
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [x.id for x in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_words:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        # str.split also splits at the four separators, which the tokenizer's \s does not hold.
        words = _PLAIN_SPACE.split(text) if any(c in text for c in _SEPARATORS) else text.split()
        return b"".join(map(self.words.__getitem__, words))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def only_encoder(path: str) -> WordEncoder:
    """The encoder, in a worker that has given back what other operators left."""
    make_room(keep=_encoders)
    return encoder(path)
