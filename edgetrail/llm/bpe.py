"""Byte-level BPE inside tasks: ids of many texts, each distinct word encoded once, and a heap-based token counter.

Text is cut before each single space, where the pre-tokenizer always cuts too; the counter looks its pieces up in a
per-process cache. A text in which a space touches other white space in a way that could change the cut (a part is
empty or begins with white space), or that holds a special string, is handled whole.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE_ENTRIES = 800_000
CACHED_CHARS = 64
_UNSAFE = re.compile(r"\s \s|\s \Z")
_made: dict[str, object] = {}


def tokenizer_text(path: str) -> str:
    """The tokenizer file's content, a vocabulary of fixed size, to be broadcast to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def once(kind: Callable[[str], object], text: str) -> object:
    """One object of a kind for each tokenizer and Python process."""
    key = f"{kind.__name__}-{hashlib.sha256(text.encode()).hexdigest()}"
    if key not in _made:
        _made[key] = kind(text)
    return _made[key]


def special_pattern(spec: dict) -> re.Pattern | None:
    found = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, found))) if found else None


class Encoder:
    """Ids as the tokenizers library gives them. Words of texts that can be cut go through tiktoken with the same
    vocabulary, which gives the same ids for plain text, each distinct word of many texts once and all in one call."""

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.tokenizer = Tokenizer.from_str(text)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items()}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.coding = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = np.zeros(1 + max(vocab.values(), default=0), np.int64)  # of each id
        self.bytes[list(vocab.values())] = list(map(len, vocab))

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        """Special strings are plain text here."""
        return self.coding.encode_to_numpy(text, disallowed_special=())

    def words(self, words: list[str], size: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each word that is not apart, one after the other, and how many each word has."""
        ids = self.plain(" ".join(["", *itertools.compress(words, ~apart)]))
        ends = np.cumsum(np.where(apart, 0, 1 + size))
        reached = np.searchsorted(np.cumsum(self.bytes[ids]), ends, "right")
        return ids, np.diff(reached, prepend=0)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each text end. A null text has none."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(cut.flatten())
        word, firsts = coded.indices.to_numpy().copy(), cut.offsets.to_numpy()[:-1]
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        apart = np.fromiter((not w or w[0].isspace() for w in words), bool, len(words))
        ids, n = self.words(words, pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False), apart)
        # A text is handled whole where a word after its first is apart, or where it holds a special string.
        after = apart[word]
        after[firsts] = False
        uncut = np.logical_or.reduceat(after, firsts)
        for s in self.special:
            uncut |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        own = [self.whole(texts[i].as_py()) if uncut[i] else self.plain(words[word[at]]) for i, at in enumerate(firsts.tolist())]
        word[firsts] = len(n) + np.arange(len(texts))
        n = np.append(n, list(map(len, own)))
        start, ids = np.cumsum(n) - n, np.concatenate([ids, *own])
        times = n[word]
        if uncut.any():
            rest = np.repeat(uncut, np.diff(np.append(firsts, len(word))))
            rest[firsts] = False
            times[rest] = 0
        to = np.cumsum(times)
        return ids[np.repeat(start[word] - to + times, times) + np.arange(to[-1])], to[np.append(firsts[1:], len(word)) - 1]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.many(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


class Counter:
    """The number of tokens: symbols at the start minus merges. Pairs wait in a heap by rank and place; symbols
    form a linked list; no ids are made."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        self.special = special_pattern(spec)
        merges = spec["model"]["merges"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}
        self.pieces = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.words: dict[str, int] = {}
        self.cache: dict[str, int] = {}

    def merged(self, word: str) -> int:
        sym: list[str | None] = [self.letters[b] for b in word.encode("utf-8")]
        n = len(sym)
        if n < 2:
            return n
        rank, last = self.rank.get, n - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(last) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j > last or rank((sym[i], sym[j])) != r:
                continue  # one of the two has changed since
            sym[i] += sym[j]
            sym[j] = None
            after[i] = k = after[j]
            left -= 1
            if k <= last:
                before[k] = i
                if (r := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def part(self, text: str) -> int:
        total, words = 0, self.words
        for w in self.pieces(text):
            n = words.get(w)
            if n is None:
                n = self.merged(w)
                if len(w) <= CACHED_CHARS:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return sum(self.part(x) for x in self.special.split(text)) + len(self.special.findall(text))
        if _UNSAFE.search(text):
            return self.part(text)
        first, *rest = text.split(" ")
        cache = self.cache
        try:
            return self.part(first) + sum(map(cache.__getitem__, rest))
        except KeyError:
            new = set(rest).difference(cache)
            if len(cache) + len(new) > CACHE_ENTRIES:
                cache.clear()
                new = set(rest)
            for p in new:
                cache[p] = self.part(" " + p)
            return self.part(first) + sum(map(cache.__getitem__, rest))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where printable, else
    the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
