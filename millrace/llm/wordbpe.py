"""Word-level BPE of a local tokenizer file, with a bounded word cache.

Texts of Latin-1 characters go a short way that gives the tokenizer's own ids: for these characters normalisation is
lower-casing, and every match of the pre-tokenizer's pattern is encoded by the tokenizer's model and kept by word.
All other texts, and those that hold an added token's characters (which the tokenizer's default call gives that token's id), go through the tokenizer as
they are.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: The Latin-1 letters (after lower-casing), numbers and white space of the tokenizer's pattern.
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Words kept by a worker; beyond it the cache starts anew.
CACHE_WORDS = 500_000
#: Longer matches aren't kept.
CACHE_CHARS = 64


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if self.special.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PATTERN.findall(text.lower())))


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
