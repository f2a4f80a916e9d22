"""Token ids of whole texts from a public BPE tokenizer, with a bounded cache of words.

The tokenizer lower-cases, drops white space and encodes each word by itself, so a text's ids are the ids of its words
in order. Texts of plain letters, digits and signs below U+0250 are split here and their words given to the tokenizer's
model directly, each once, whatever its case and the signs around it; in other texts this holds of what stands between
white space and is plain, and the rest goes through the tokenizer as a whole. Texts that hold one of its special tokens,
or characters that only one side takes as white space, are encoded undivided.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import regex

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7e¡-įı-ɏ]+")
_PLAIN_TEXT = re.compile(r"[\t-\r\x20-\x7e¡-įı-ɏ]*")


def _class(first: str) -> str:
    """Characters of plain texts, in lower case, whose category begins with ``first``."""
    return "".join(sorted({low for k in range(0x21, 0x250) if len(low := chr(k).lower()) == 1 and unicodedata.category(low)[0] == first}))


#: The same split as ``_WORDS`` for plain texts in lower case, by ``re``, which is faster.
_PLAIN_WORDS = re.compile(rf"[{_class('L')}]+|'(?:[stmd]|re|ve|ll)|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
_ASCII_WORDS = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9]+")
_UNDIVIDED = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return {b: chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)}


class _Recent(dict):
    """Values by key; of ``limit`` entries the half used least recently goes at once."""

    def __init__(self, limit: int, make):
        super().__init__()
        self._half, self._make, self._older = max(1, limit // 2), make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._half:
            self._older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordCache:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes; at most ``limit`` words, and as many with their signs."""

    def __init__(self, path: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._words = _Recent(limit, self._word)
        self._chunks = _Recent(limit, self._chunk)

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not (chunk.isascii() and chunk.isalnum()) and not _PLAIN.fullmatch(chunk):
            return self._whole(chunk)
        low = chunk.lower()
        return self._word(low) if low.isalpha() else b"".join(map(self._words.__getitem__, _WORDS.findall(low)))

    def encode(self, text: str) -> bytes:
        if any(map(text.__contains__, _UNDIVIDED)):
            return self._whole(text)
        if text.isascii() or _PLAIN_TEXT.fullmatch(text):
            words = _ASCII_WORDS if text.isascii() else _PLAIN_WORDS
            return b"".join(map(self._words.__getitem__, words.findall(text.lower())))
        return b"".join(map(self._chunks.__getitem__, text.split()))
