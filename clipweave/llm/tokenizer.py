"""Whole-text encoding with a public tokenizer file, one encoding per distinct word.

The vocabulary file's pre-tokenizer never joins characters across white space, so
the ids of a text are the ids of its words in a row. Each Python worker keeps the
ids of the words it has seen in flat arrays and gathers a batch of texts from them.
Where the file's normalizer lower-cases, texts are lower-cased first, so that fewer words
are distinct; words of lower-case ASCII letters alone skip the normalizer and the
pre-tokenizer, which leave them as they are.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np

from .common import free_memory, kept_in_worker

#: What may follow a word's letters and is a token run of its own for the pre-tokenizer.
TAIL = b".,;:!?%&*$#|()"


#: Words and parts that an encoder keeps before it starts anew.
MOST_WORDS = 800_000


class WordEncoder:
    """texts (UTF-8 bytes or None) -> (ids, offsets). most_words bounds the cache, in which words and their parts stand together."""

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        vocab = self.tokenizer.get_vocab()
        self.lowers = self._ids("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == self._ids("abcdefghijklmnopqrstuvwxyz")
        self.bare = Tokenizer.from_file(path)  # for words that normalizer and pre-tokenizer leave as they are
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        probe = [t.removesuffix("</w>") for t in sorted(vocab)[::97]]
        probe = " ".join(t for t in probe if t.isascii() and t.isalpha() and t.islower())
        if not self.lowers or self._ids(probe) != self.bare.encode(probe, add_special_tokens=False).ids:
            self.bare = self.tokenizer
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)  # ids that close a pre-token
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}  # word or part of one -> place in starts and sizes
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.count = 0

    @staticmethod
    def _divide(word: bytes) -> tuple[bytes, bytes]:
        """Two parts whose ids, in a row, are the word's: its letters and the marks after them; the second may be empty."""
        core = word.rstrip(TAIL)
        if core.isalpha() or (core and core.decode("utf-8", "replace").isalpha()):  # bytes: A-Z and a-z only
            return core, word[len(core) :]
        return word, b""

    def _joined(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """ids of single pre-tokens in a row, and their sizes, encoded many to a string and told apart by their closing ids; None for a vocabulary without word ends."""
        coded = tokenizer.encode_batch_fast([" ".join(texts[i : i + 512]) for i in range(0, len(texts), 512)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int64)
        sizes = np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)
        return (ids, sizes) if len(sizes) == len(texts) and int(sizes.sum()) == len(ids) else None

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the parts in a row, and their sizes."""
        text = [p.decode("utf-8", "replace") for p in parts]
        # 0: lower-case ASCII letters; 1: other single pre-tokens; 2: the rest, encoded one by one.
        kind = np.fromiter((0 if p.isalpha() and p.islower() else 1 if t.isalpha() or (t and not p.strip(TAIL)) else 2 for p, t in zip(parts, text, strict=True)), np.int8, len(parts))
        sizes, found = np.zeros(len(parts), np.int64), {}
        for k, tokenizer in ((0, self.bare), (1, self.tokenizer), (2, self.tokenizer)):
            at = np.flatnonzero(kind == k)
            own = [text[i] for i in at.tolist()]
            got = self._joined(tokenizer, own) if k < 2 else None
            if got is None:
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                got = np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
            found[k], sizes[at] = got
        owner = np.repeat(kind, sizes)
        out = np.empty(len(owner), np.int64)
        for k, ids in found.items():
            out[owner == k] = ids
        return out, sizes

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Appends entries; the place of the first."""
        n, more = len(sizes), int(sizes.sum())
        if len(ids) and int(ids.max()) > 0xFFFF and self.flat.dtype == np.uint16:
            self.flat = self.flat.astype(np.uint32)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : self.used + more] = ids
        self.sizes[self.count : self.count + n] = sizes
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + more, self.count + n
        return self.count - n

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the entries in a row, and their sizes."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes

    def _add(self, words: list[bytes]) -> None:
        divided = list(map(self._divide, words))
        flat = list(chain.from_iterable(divided))
        fresh = list(set(flat).difference(self.index))
        if fresh:
            n = self._store(*self._encode_parts(fresh))
            self.index.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        both = [i for i, (_, tail) in enumerate(divided) if tail]  # the others are their own first part
        if both:
            at = np.fromiter((self.index[p] for i in both for p in divided[i]), np.int64, 2 * len(both))
            ids, sizes = self._gather(at)
            n = self._store(ids, sizes.reshape(-1, 2).sum(1))
            self.index.update(zip((words[i] for i in both), range(n, n + len(both)), strict=True))

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, each followed by the id end; offsets has len(texts) + 1 entries."""
        if len(self.index) > self.most_words:
            self._clear()
        if self.lowers:  # texts that may name a special token stay as they are
            texts = [t.lower() if t and b"<|" not in t else t for t in texts]
        split = [t.split() if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = [words[i] for i in missing]
            self._add(list(set(lost)))
            at[missing] = np.fromiter(map(self.index.__getitem__, lost), np.int64, len(lost))
        ids, sizes = self._gather(at)
        ends = np.cumsum(sizes)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]  # ids before each text
        offsets = upto + np.arange(len(texts) + 1)
        out = np.full(int(offsets[-1]), end, np.uint32)
        place = np.ones(len(out), bool)
        place[offsets[1:] - 1] = False
        out[place] = ids
        return out, offsets


_encoders: dict[str, WordEncoder] = kept_in_worker("tokenizer", {})


def encoder(path: str, most_words: int = MOST_WORDS) -> WordEncoder:
    """One encoder per worker process and file, kept until a task of another operator frees it."""
    free_memory("tokenizer")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].most_words = most_words
    return _encoders[path]
