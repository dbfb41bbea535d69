"""Token ids by the tokenizers library, whole texts at a time, with a bounded cache of words.

Both kinds of vocabulary here cut a text into pieces before they merge bytes, and a piece's ids do
not depend on its neighbours. So ids are looked up word by word, and only the pieces of words not
seen lately go to the library's model. A text with anything for which this might not hold, and any
other kind of vocabulary, is encoded by the library whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array
from collections.abc import Callable

import regex

#: Words and pieces per generation of a task's cache, which holds two.
CACHED = 400_000
#: Special tokens' strings, and white space on which Python and the library might differ (in UTF-8,
#: some also the start of other characters).
_WHOLE = [b"<|", *(x.encode() for x in "\x85\xa0\u1680\u180e\u3000\ufeff"), b"\xe2\x80", b"\xe2\x81"]
_CONTROLS = bytes([0, *range(0x1C, 0x20)])
#: White space that splitting at single spaces does not handle.
_EDGES = ("  ", " \n", "\n ", "\t", "\r", "\v", "\f")
#: The patterns by which the two vocabularies cut texts into pieces.
_LOWER_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACED_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


class _Known(dict):
    """Computes what it does not hold. When full it starts anew, but words that were held until then
    are taken over as they are met again, so that frequent ones are computed once.
    """

    def __init__(self, make: Callable[[str], bytes]):
        self._make = make
        self._before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self._before.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= CACHED:
            self._before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """``ids(text)``: the text's token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # Byte-level models merge stand-in characters; the library says which one a byte has.
        self._stand_ins = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        self._stand_ins |= {b: self._stand_in(level, b) for b in range(128, 256)}
        self._lower = self._tokenizer.normalizer is not None
        self._words = _Known(self._lower_word if self._lower else self._spaced_word)
        self._piecewise = self._agrees(level)

    @staticmethod
    def _stand_in(level, byte: int) -> str:
        # As the last byte of a two-byte character, or else as a first one.
        if byte < 0xC0:
            return level.pre_tokenize_str(bytes([0xC3, byte]).decode())[0][0][1]
        first = {0xC0: None, 0xC1: None}.get(byte, byte)
        if first is None or byte > 0xF4:
            return ""
        tail = {0xE0: b"\xa0\x80", 0xF0: b"\x90\x80\x80"}.get(
            byte, b"\x80" * (1 if byte < 0xE0 else 2 if byte < 0xF0 else 3)
        )
        return level.pre_tokenize_str((bytes([byte]) + tail).decode())[0][0][0]

    def _agrees(self, level) -> bool:
        """Whether this is one of the two kinds, tried on a text with every sort of piece."""
        text = "It's we'll IT'RE the end.\nNext 1234 line,  two ... é Ünï ñandú 日本 #!? x\n\n y"
        try:
            return self._by_word(text) == self._whole(text)
        except Exception:  # another kind of model
            return False

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._stand_ins)
        elif not piece.isalpha():
            piece = piece.translate(self._stand_ins)
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _lower_word(self, word: str) -> bytes:
        low = word.lower()
        if not word.isascii() and (len(low) != len(word) or "Σ" in word or "İ" in word):
            return self._whole(word)
        if low.isalpha():
            return self._piece(low) if low == word else self._words[low]
        if low[-1] in ".," and low[:-1].isalpha():
            return self._words[low[:-1]] + self._words[low[-1]]
        return self._cut(_LOWER_PIECES.findall(low))

    def _spaced_word(self, word: str) -> bytes:
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self._piece(word)
        return self._cut(_SPACED_PIECES.findall(word))

    def _cut(self, pieces: list[str]) -> bytes:
        """The ids of a word's pieces, each of which is a word of one piece itself."""
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join([self._words[p] for p in pieces])

    def _by_word(self, text: str) -> bytes:
        if self._lower:
            words = self._lowered(text).split()
        elif text[-1:] == " " or any(x in text for x in _EDGES):
            words = _SPACED_PIECES.findall(text)
        else:
            # A single space between two other characters always starts a piece.
            first, *rest = text.split(" ")
            words = [first, *[" " + w for w in rest]]
        return b"".join(map(self._words.__getitem__, words))

    @staticmethod
    def _lowered(text: str) -> str:
        """In lower case, where that is the same for the whole text as for each word."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        low = text.lower()
        return text if len(low) != len(text) or "Σ" in text or "İ" in text else low

    def ids(self, text: str) -> bytes:
        data = text.encode()
        if (
            not self._piecewise
            or any(x in data for x in _WHOLE)
            or len(data.translate(None, _CONTROLS)) != len(data)
        ):
            return self._whole(text)
        return self._by_word(text)


@functools.lru_cache(maxsize=1)
def kept_encoder(path: str) -> Encoder:
    """An encoder that stays with the Python worker, whose later tasks meet the same words again."""
    return Encoder(path)
