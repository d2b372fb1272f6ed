"""Token ids of whole texts by a public tokenizer file, word by word through a bounded cache.

The tokenizer drops white space and never joins what stands on two sides of it, so a text's ids are
its words' ids in order. Only space, tab, carriage return and line feed part words here; any other
white space stays inside a word and is left to the tokenizer. The tokenizer lowers case, so plain Latin texts are lowered first and share words.
Words that the cache lacks are encoded together, as one text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Words up to so many characters are kept, and so many words: where half of them are new, those not seen since go.
CACHED_LENGTH = 48
CACHED_WORDS = 400_000
#: Above these characters lower case and composition do not depend on one another's order.
_BEYOND = re.compile("[\u0130\u0300-\U0010ffff]|<\\|")
#: Marks between a letter and white space are a word of their own.
_MARK = r"[!-/:-@\[-`{-~]"
_STOP = re.compile(_MARK + "(?<=[a-z\u00df-\u00f6\u00f8-\u00ff].)" + _MARK + "*(?=[ \n\t\r]|$)")

_loaded: dict[str, WordTokenizer] = {}
_sizes: dict[str, int] = {}


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, special tokens included."""
    if path not in _sizes:
        from tokenizers import Tokenizer

        _sizes[path] = max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
    return _sizes[path]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def forget() -> None:
    """Empties the caches of this worker process, for tasks that do not tokenize."""
    for tokenizer in _loaded.values():
        tokenizer.known, tokenizer.older = {"": b""}, {}


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    @staticmethod
    def load(path: str) -> WordTokenizer:
        """One tokenizer for each worker process."""
        if path not in _loaded:
            _loaded[path] = WordTokenizer(path)
        return _loaded[path]

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """A word of letters alone ends with the first id that ends a word, so many share one text."""
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        found = self._encode([" ".join(plain), *rest])
        out = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(rest, found[1:], strict=True)}
        ids = np.array(found[0].ids, dtype="<u4")
        cuts = ((np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4).tolist()
        if len(cuts) == len(plain):
            raw = ids.tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(plain, [0, *cuts], cuts, strict=False))
        else:
            out.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(plain, self._encode(plain), strict=True))
        return out

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if "<|" not in text if text.isascii() else not _BEYOND.search(text):
            text = _STOP.sub(r" \g<0>", text.lower())
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        fresh = set(words).difference(known)
        if not fresh:
            return b"".join(map(known.__getitem__, words))
        if len(known) + len(fresh) > CACHED_WORDS // 2:
            self.older, known = known, {"": b""}
            self.known = known
            fresh = set(words).difference(known)
        older = self.older
        back = {w: older[w] for w in fresh if w in older}
        known.update(back)
        if len(back) == len(fresh):
            return b"".join(map(known.__getitem__, words))
        here = self._ids([w for w in fresh if w not in back])
        if max(map(len, here)) <= CACHED_LENGTH:
            known.update(here)
            return b"".join(map(known.__getitem__, words))
        known.update((w, x) for w, x in here.items() if len(w) <= CACHED_LENGTH)
        return b"".join([known[w] if w in known else here[w] for w in words])
