"""Token ids of whole texts by a tokenizer file, word by word with a memory of known words.

The two tokenizer kinds used here split texts at white space before any merge, so a text's ids are
those of its words put together. `space` says where a single space between two words belongs:
"before" (to the word after it: byte-level BPE) or "none" (dropped: BPE with word ends, lower case).
Both also part letters from marks, so a word like `end.` is made from its runs. A run of Latin
letters goes to the tokenizer's model as it is; anything less plain goes to the tokenizer as a whole:
words with apostrophes, digits, other scripts, the strings of special tokens, characters that normalising
or lower-casing takes apart, or where more white space meets. With space=None each text is encoded as a whole, which is right for any tokenizer.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Runs that a Python worker remembers, and the longest of them.
KNOWN_WORDS = 1_000_000
WORD_CHARS = 48
#: Up to this length a word is remembered with the mark after it, too.
SHORT = 8

_uneven = re.compile(r" \s|\s ")
_rare_blank = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]")
_between = re.compile(r"(?<=\S) (?=\S)")
_runs = re.compile(r'[A-Za-zÀ-ÖØ-öø-ÿ]+|[,.;:!?#*$%&|<>()"/=+-]+|\n')

_MARKS = frozenset(",.;:!?")


def _stays(word: str) -> bool:
    """Whether normalising and lower-casing change no number of code points."""
    return len(word.lower()) == len(word) and unicodedata.normalize("NFC", word) == word


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed,
    else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Known:
    """The ids of words that have been met, after a prefix."""

    def __init__(self, encoder: Encoder, prefix: str):
        self.encoder, self.prefix = encoder, prefix
        self.words: dict[str, bytes] = {}

    def ids(self, word: str) -> bytes:
        found = self.words.get(word)
        return self._new(word) if found is None else found

    def all(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.ids(w) if x is None else x for x, w in zip(found, words, strict=True)]
        return found

    def _new(self, word: str) -> bytes:
        code = self.encoder
        if not word or len(word) > WORD_CHARS or not (word.isascii() or _stays(word)):
            return code.whole(self.prefix + word)
        if word[-1] in _MARKS and word[:-1].isalpha():
            ids = self.ids(word[:-1]) + code.first.ids(word[-1])
            if len(word) > SHORT:
                return ids
        elif word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
            ids = code.letters(self.prefix, word)
        else:
            runs = _runs.findall(word)
            if len(runs) > 1 and sum(map(len, runs)) == len(word) and "<|" not in word and "\n\n" not in word:
                ids = self.ids(runs[0]) + b"".join(code.first.all(runs[1:]))
            else:
                ids = code.whole(self.prefix + word)
        if len(self.words) < KNOWN_WORDS:
            self.words[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, space: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if small else "<u4")
        self.letter = "H" if small else "I"
        self.space = space
        self.later = _Known(self, " " if space == "before" else "")
        self.first = self.later if space == "none" else _Known(self, "")

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def letters(self, prefix: str, word: str) -> bytes:
        """The ids of a run of Latin letters."""
        if self.space == "none":
            word = word.lower()
        else:
            word = prefix + word
        if not (word.isascii() and self.space == "none"):
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def encode(self, text: str) -> bytes:
        """The ids of the text, as bytes of little-endian integers of self.kind."""
        if self.space is None:
            return self.whole(text)
        uneven = "  " in text or "\n " in text or " \n" in text or (_rare_blank.search(text) and _uneven.search(text))
        words = _between.split(text) if uneven else text.split(" ")
        return self.first.ids(words[0]) + b"".join(self.later.all(words[1:]))


@lru_cache(maxsize=4)
def encoder(path: str, space: str | None) -> Encoder:
    """One for each worker and file; its memory lasts as long as the worker."""
    return Encoder(path, space)
