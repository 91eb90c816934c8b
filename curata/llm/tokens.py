"""Token ids by public tokenizer files, with a bounded memo of words.

White space never lies inside a token of either vocabulary used here, so the ids of a
text are those of its white-space separated words, one after the other. A word's ids are
worked out once per worker and kept in a bounded memo; a text with characters outside the
plain Latin range (where normal forms or case rules may look at neighbours), or one that
holds the string of an added token (as ``<|endoftext|>``, which the library makes one id
wherever it stands), goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

MEMO_WORDS = 700_000
#: printable ASCII, tab, line feed, carriage return, Latin-1 and Latin Extended-A
#: letters without the four that lower-casing or normal forms treat specially
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens(dict):
    """word -> its ids as little-endian uint32 bytes, filled on demand, bounded."""

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.limit = limit
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.letters = _byte_letters()

    def _merge(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        pieces = [word] if word.isalpha() else self.split(word)
        got = self._merge(word) if pieces == [word] else b"".join([self[p] for p in pieces])
        if len(self) >= self.limit:
            self.clear()
        self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian uint32 bytes."""
        if _PLAIN.fullmatch(text):
            plain = text.lower()
            if not any(mark in plain for mark in self.added):
                return b"".join(map(self.__getitem__, plain.split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One tokenizer and memo per Python worker and vocabulary file."""
    return WordTokens(path)
