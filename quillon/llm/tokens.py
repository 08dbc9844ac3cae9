"""Token ids of whole texts with the installed public tokenizer, words cached."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Texts of these characters alone are their own composed form and lower-case character by character, so that their words can be
#: split here and looked up; any other text goes to the tokenizer whole.
_ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
MOST_CACHED = 250_000
#: Byte-level spelling: bytes without a printable Latin-1 character of their own take the code points from 256 on, in order.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN)}
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so its cache outlives tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Words(dict):
    """ids of words, found when first asked for; words that are still in use come back from the older half."""

    def __init__(self, ids):
        super().__init__()
        self.ids, self.older = ids, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.ids(word)
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > MOST_CACHED:
            self.older = dict(self)
            self.clear()


class Encoder:
    """ids of texts, as little-endian unsigned 32-bit numbers, of a tokenizer that lower-cases and splits by words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.cache = self.tokenizer.model.tokenize, _Words(self._word)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """ids of a word that the splitter would leave whole: straight from the model, bytes spelled as it spells them."""
        found = self.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLED))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (odd if _ODD.search(t) else plain).append(i)
        self.cache.trim()
        get = self.cache.__getitem__
        for i in plain:
            out[i] = b"".join(map(get, _PIECE.findall(texts[i].lower())))
        for i, ids in zip(odd, self._ids([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out
