"""Token ids of a public tokenizer, with words cached inside each Python worker."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

#: Letters of Latin-1: normalisation form C leaves them alone and lower case is one character each, alike in every library.
_LETTERS = "a-zªµºß-öø-ÿ"
_PLAIN = re.compile("[\t-\r\x20-\x7e\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
#: What the vocabulary's splitter makes of such text, as a pattern of `re`. Fixed value.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9ªº]|[^\\s{_LETTERS}0-9]+")
#: Entries of a generation of a worker's cache; a full one becomes the old one, whose entries live on if used again.
CACHE = 400_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself, or the next one from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in same)}


class _Cache(dict):
    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class WordEncoder:
    """text -> ids as little-endian unsigned 32-bit integers, equal to the tokenizers library's for the whole text.

    No match of the vocabulary's splitter crosses white space, so a text is encoded word by word; each new word's
    letters go to the library's BPE model once. Any text with a character outside ASCII and Latin-1 letters, or with
    a special token's opening, goes to the library as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        letters, tokenize = _byte_letters(), self.library.model.tokenize

        def piece(p: str) -> bytes:
            # printable ASCII letters stand for themselves
            return array("I", [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))]).tobytes()

        def word(w: str) -> bytes:
            if w.isascii() and w.isalpha():
                return piece(w)
            pieces = _PIECES.findall(w)
            return piece(w) if len(pieces) == 1 else b"".join([known[x] for x in pieces])

        self.word = known = _Cache(word)

    def __call__(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            word = self.word
            return b"".join([word[w] for w in text.lower().split()])
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_workers: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]
