"""Exact, cached tokenisation with the tokenizers library.

Random text is dominated by rare words, and the library spends most of its
time on words that it has met before. Both vocabularies cut a text at white
space before any merge is applied, so a text's ids are the ids of its words
put together; each distinct word is given to the library once per worker.
Texts for which that is not evident (unusual white space, special-token
strings) go to the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

from .common import PrefixHash

_ODD = re.compile(r"[\x00\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]|<\|")
#: Runs of white space with a blank; white space beyond ASCII is odd.
_RUNS = ["  ", *[pair for c in "\t\n\v\f\r" for pair in (c + " ", " " + c)]]
_BREAKS = re.compile(r"(?<=\S)(\n)(?=\S)")
#: Words kept per worker. Beyond it, words are learned for one batch only, which
#: bounds memory; the words met first are the common ones.
CACHE_WORDS = 900_000


class WordTokenizer:
    """ids(texts) gives one flat id array and each text's count.

    kind "word": white space is dropped (lower-casing BPE with word ends).
    kind "byte": a single blank belongs to the word that follows it.
    """

    def __init__(self, path: str, kind: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.kind = kind
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.start = np.zeros(1 << 18, dtype=np.int64)
        self.size = np.zeros(1 << 18, dtype=np.int32)
        self.used = self.words = 0
        self.kept: tuple[int, int] | None = None  # ids and words at the time the cache was full

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, word: str) -> list[str]:
        """Parts of a word that are tokenised on their own in any text."""
        if "'" in word or word[-1].isalpha() and "\n" not in word:
            return [word]
        out = []
        for part in _BREAKS.split(word) if "\n" in word else (word,):
            core = part.rstrip(".,;:!?")
            if core and len(core) < len(part) and core[-1].isalnum():
                out += [core, part[len(core) :]]
            else:
                out.append(part)
        return out

    def _grown(self, have: np.ndarray, need: int) -> np.ndarray:
        while need > len(have):
            have = np.concatenate([have, np.zeros(max(len(have) // 2, 1), have.dtype)])
        return have

    def _store(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, total = len(words), len(ids)
        self.flat = self._grown(self.flat, self.used + total)
        self.start = self._grown(self.start, self.words + n)
        self.size = self._grown(self.size, self.words + n)
        at = slice(self.words, self.words + n)
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = ids
        self.index.update(zip(words, range(self.words, self.words + n), strict=True))
        self.used += total
        self.words += n

    def _learn(self, words: list[str]) -> None:
        """Store distinct words that aren't stored."""
        own, built = [], {}  # words that are one piece, and the pieces of the others
        for w in words:
            if w.isalpha() or len(pieces := self._pieces(w)) == 1:
                own.append(w)
            else:
                built[w] = pieces
        new = list(dict.fromkeys(chain(own, (p for s in built.values() for p in s if p not in self.index))))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            rows = self.whole(part)
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            self._store(part, sizes, np.fromiter(chain.from_iterable(rows), dtype=np.uint32, count=int(sizes.sum())))
        built = {w: s for w, s in built.items() if w not in self.index}
        if built:
            k = np.array([self.index[p] for s in built.values() for p in s], dtype=np.int64)
            group = np.repeat(np.arange(len(built)), [len(s) for s in built.values()])
            self._store(list(built), np.bincount(group, self.size[k], len(built)).astype(np.int64), self._gather(k))

    def _gather(self, k: np.ndarray) -> np.ndarray:
        sizes = self.size[k].astype(np.int64)
        src = np.repeat(self.start[k] - (np.cumsum(sizes) - sizes), sizes)
        src += np.arange(len(src))
        return self.flat[src]

    def _forget(self) -> None:
        """Drop what one batch taught a full cache."""
        if self.kept is None:
            if self.words > CACHE_WORDS:
                self.kept = (self.used, self.words)
        elif self.words > self.kept[1]:
            for _ in range(self.words - self.kept[1]):
                self.index.popitem()
            self.used, self.words = self.kept

    def _words(self, text: str) -> list[str] | None:
        """The words of a text, or None where the library must see it whole."""
        if _ODD.search(text):
            return None
        if self.kind == "word":
            return text.split()
        if text == "":
            return []
        if text[0].isspace() or text[-1].isspace() or any(r in text for r in _RUNS):
            return None
        return text.replace(" ", "\0 ").split("\0")  # an odd text may hold a zero, this one doesn't

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._forget()
        split = [self._words(t) for t in texts]
        rest = [i for i, s in enumerate(split) if s is None]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]) if rest else (), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        plain = [i for i, s in enumerate(split) if s is not None]
        words = list(chain.from_iterable(split[i] for i in plain))
        k = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(k < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            self._learn(list(dict.fromkeys(unknown)))
            k[missing] = np.fromiter(map(self.index.__getitem__, unknown), dtype=np.int64, count=len(unknown))
        flat = self._gather(k)
        cum = np.concatenate([[0], np.cumsum(self.size[k], dtype=np.int64)])
        ends = cum[np.cumsum([len(split[i]) for i in plain], dtype=np.int64)]
        if not rest:
            return flat, np.diff(ends, prepend=0)
        for i, a, b in zip(plain, [0, *ends.tolist()], ends.tolist(), strict=False):
            out[i] = flat[a:b]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)


loaded: dict[tuple[str, str], WordTokenizer] = {}


def tokenizer(path: str, kind: str) -> WordTokenizer:
    """One tokenizer per Python worker; workers are reused between tasks."""
    if (path, kind) not in loaded:
        loaded.clear()
        PrefixHash._powers.clear()
        loaded[path, kind] = WordTokenizer(path, kind)
    return loaded[path, kind]
