"""ids of a word-level byte BPE tokenizer file, computed for many words at once.

The library's encoder spends some 15 microseconds on a word. Words repeat, so ids are kept by word; words that are new
are merged together, one merge per word and round, in numpy. Whatever is not plain Latin text goes to the library itself,
so the ids are those of the library for any text (the tests compare them).
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Entries kept per cache and worker, and the longest word that is kept or merged here.
CACHE_WORDS, CACHE_WORD_CHARS = 600_000, 48

# The characters that this module handles itself, and the pre-tokenizer's pattern over them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿĀ-įĴ-ķĹ-ľŁ-ňŌ-ŕŖ-ž]+")
ODD = re.compile("[İı]|<\\|")
#: All that PLAIN's letters become when lower-cased.
LOWER = "a-z" + "".join(sorted({c.lower() for c in map(chr, range(0xC0, 0x180)) if PLAIN.match(c) and not ODD.match(c)}))
PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^{LOWER}0-9]+")


class WordBpe:
    """For a tokenizer file of this shape: NFC, white space to one space, lower case; the pattern above; byte-level BPE with a word-end suffix."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        one = {b: self._byte_symbol(ByteLevel, b) for b in range(128)}
        # bytes of 128 and above, as the two- and three-byte characters hold them, follow from the alphabet in order
        spare = iter(sorted(set(ByteLevel.alphabet()) - set(one.values()) - self._latin()))
        for b in range(128, 256):
            c = chr(b)
            one[b] = c if c in self._latin() else next(spare)
        self.inner = np.array([vocab[one[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[one[b] + end] for b in range(256)], dtype=np.int64)
        self.base = len(vocab) + 2
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.none = len(pairs)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _latin() -> set[str]:
        """Characters of the upper half of Latin-1 that stand for their own byte."""
        return {chr(b) for b in range(0xA1, 0x100) if b != 0xAD}

    @staticmethod
    def _byte_symbol(kind, b: int) -> str:
        return kind(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def merge(self, words: list[str]) -> list[bytes]:
        """ids of pre-tokens: in each round every word merges its pair of lowest rank, the leftmost of equals."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        last = np.cumsum(size) - 1
        ids = self.inner[data]
        ids[last] = self.final[data[last]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_word = [], []
        rank = np.full(len(ids), self.none)
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(ids[:-1], ids[1:]), self.none)
        while len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(ids)])
            busy = np.repeat(least < self.none, length)
            if not busy.all():
                done_ids.append(ids[~busy])
                done_word.append(word[~busy])
                ids, word, rank = ids[busy], word[busy], rank[busy]
                keep = least < self.none
                least, length = least[keep], length[keep]
                if not len(ids):
                    break
                first = np.r_[0, np.cumsum(length)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(least, length))
            at = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            ids[at] = self.made[rank[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            new = at - np.arange(len(at))
            rank[at] = rank[at + 1]
            ids, word, rank = ids[stay], word[stay], rank[stay]
            for left in (new, new - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                rank[left] = self._ranks(ids[left], ids[left + 1])
            end = new[(new + 1 >= len(ids)) | (word[np.minimum(new + 1, len(ids) - 1)] != word[new])]
            rank[end] = self.none
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """ids by the library."""
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """ids of white-space-delimited chunks that are not kept yet."""
        found: dict[str, bytes] = {}
        plain, odd = [], []
        for c in chunks:
            (plain if len(c) <= CACHE_WORD_CHARS and PLAIN.fullmatch(c) and not ODD.search(c) else odd).append(c)
        parts = [PRETOKENS.findall(c.lower()) for c in plain]
        words = self.words
        new = list(set().union(*parts).difference(words))
        if len(words) + len(new) > CACHE_WORDS:
            words.clear()
            new = list(set().union(*parts))
        if new:
            words.update(zip(new, self.merge(new), strict=True))
        for c, p in zip(plain, parts, strict=True):
            found[c] = b"".join([words[w] for w in p])
        for lo in range(0, len(odd), 1024):
            found.update(zip(odd[lo : lo + 1024], self.whole(odd[lo : lo + 1024]), strict=True))
        return found

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after the other.

        The pattern never matches across white space, so a text's ids are those of its chunks. Texts that hold one of the
        four control characters at which Python splits and the tokenizer does not are encoded whole.
        """
        collected = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and passes over the large caches cost a quarter of the time
        try:
            out = self._ids(texts)
        finally:
            if collected:
                gc.enable()
        yield from out

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        split = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        every = set().union(*(x for x in split if x))
        new = every.difference(self.chunks)
        if len(self.chunks) + len(new) > CACHE_WORDS:
            self.chunks.clear()
            new = every
        once: dict[str, bytes] = {}
        if new:
            for c, ids in self._learn(list(new)).items():
                (self.chunks if len(c) <= CACHE_WORD_CHARS else once)[c] = ids
        kept = self.chunks
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.whole([text])[0])
            elif once:
                out.append(b"".join([once[w] if w in once else kept[w] for w in words]))
            else:
                out.append(b"".join(map(kept.__getitem__, words)))
        return out
