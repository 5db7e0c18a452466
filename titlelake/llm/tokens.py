"""Token ids by the tokenizers library, one call for each distinct word.

The byte-level pattern cuts a text into words that are encoded one by one, so
a word's ids never depend on its neighbours: each worker has the library's
model encode the words it hasn't met and joins remembered ids.  A text that
holds an added token's string, and any tokenizer of another make, goes to the
library whole.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from titlelake.llm.pretoken import words

#: Words remembered for each worker, in each of two generations.
CACHE_WORDS = 400_000
#: Words longer than this are not remembered.
LONG_WORD = 64


class Remembered(dict):
    """What ``make`` gives for each word.  A full generation becomes the old
    one, from which words still in use move over, so rare words alone are made again."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte:
    itself for the visible characters of Latin-1, the others from 256 on in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class Tokens:
    """ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known = Remembered(self._word)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()

    def _word(self, word: str) -> bytes:
        own = [t.id for t in self.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(own)}I", *own)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_word or any(a in t for a in self.added)]
        if whole:
            for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = ids
        get = self.known.__getitem__
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = b"".join(map(get, words(t)))
        return out


_open: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process and file."""
    if path not in _open:
        _open[path] = Tokens(path)
    return _open[path]


def forget() -> None:
    """Drop the words that this worker remembers."""
    for own in _open.values():
        own.known.clear()
        own.known.old = {}
