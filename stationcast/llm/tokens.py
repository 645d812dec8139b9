"""Token ids of whole texts, with the words' ids kept per task so that each distinct word is encoded once."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import cache
from itertools import chain, count, islice

import numpy as np
from tokenizers import Tokenizer

#: Words kept at most; then the store starts anew.
MOST_WORDS = 600_000


def _class(categories: str, upto: int = 0x250) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, upto) if unicodedata.category(chr(c))[0] in categories)


LETTERS, NUMBERS = _class("L"), _class("N")
#: Texts of other characters are split by the library: combining marks, white space and case have special rules there.
SPECIAL = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]|<\\|")


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class WordStore:
    """Ids of words by row: ``rows`` numbers the words, ``ids`` are all their ids one after the other."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        # Looking a new word up gives it the next row; its ids are added right after.
        self.index: defaultdict[str, int] = defaultdict(count().__next__)
        self.ends = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > MOST_WORDS:
            self.clear()
        index, before = self.index, len(self.index)
        rows = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        new = len(index) - before
        if new:
            found = [self.encode(w) for w in reversed(list(islice(reversed(index), new)))]
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=new)
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(lengths))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(found), dtype=np.uint32,
                                                       count=int(lengths.sum())))
        return rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in these rows, and how many each word has."""
        lengths = self.ends[rows + 1] - self.ends[rows]
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self.ends[rows] - before, lengths)
        return self.ids[at], lengths


class WordBpe:
    """The lower-casing BPE with word ends: the same ids as the library's, without special tokens added."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+").findall
        self.tokenize = self.library.model.tokenize
        self.letters = {b: ord(c) for c, b in byte_letters().items()}
        self.store = WordStore(self._encode)

    def _encode(self, word: str) -> list[int]:
        """The ids of one word: the library's merges over the letters that stand for its bytes."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(word)]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        words: list[str] = []
        plain, counts = [], []
        for i, t in enumerate(texts):
            if SPECIAL.search(t):
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                found = self.split(t.lower())
                words += found
                plain.append(i)
                counts.append(len(found))
        ids, lengths = self.store.gather(self.store.rows(words))
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(counts)] if plain else []
        lo = 0
        for i, hi in zip(plain, ends):
            out[i] = ids[lo:hi]
            lo = hi
        return out
