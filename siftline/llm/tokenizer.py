"""Byte-level BPE with the merge ranks of a public vocabulary.

A text is cut into pieces by the vocabulary's own pattern. Each distinct piece is encoded by a priority queue
of merge ranks over a doubly linked symbol list; entries whose symbols have changed since are skipped. Words are
kept with their ids in a worker's cache (which is emptied when full: that costs time, never results).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import regex

# Fixed values of the public vocabulary: its split pattern and its files' folder.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"

LONG_WORD = 64
SPACES = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
CACHE_ENTRIES = 300_000


def tokenizer_path(path: str | None = None) -> str:
    return path or os.path.join(os.environ.get("SIFTLINE_TOKENIZERS", TOKENIZER_DIR), TOKENIZER_FILE)


def read_ranks(path: str | None = None) -> bytes:
    """The vocabulary file as it is, for a broadcast (its size is that of the vocabulary, not of any data)."""
    with open(tokenizer_path(path), "rb") as f:
        return f.read()


class _Words(dict):
    """Ids, packed as int32, of a word with (``lead`` = ' ') or without the space before it."""

    def __init__(self, bpe: Bpe, lead: str):
        super().__init__()
        self.bpe, self.lead = bpe, lead

    def __missing__(self, word: str) -> bytes:
        if self.lead and (not word or word[0] in SPACES):
            raise _Irregular
        ids = self.bpe.split_and_encode(self.lead + word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


class _Irregular(Exception):
    """A run of white space: the text is cut by the pattern instead of by single spaces."""


class Bpe:
    def __init__(self, ranks: bytes):
        self.rank: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        self.token = {v: k for k, v in self.rank.items()}
        self._find = regex.compile(PATTERN).findall
        self._cut = regex.compile(r" (?=\S)").split
        self._pieces: dict[str, bytes] = {}
        self._head, self._tail = _Words(self, ""), _Words(self, " ")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        rank, n = self.rank, len(piece)
        if n == 1:
            return [rank[piece]]
        sym = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = rank.get(sym[i] + sym[i + 1])
            if r is not None:
                queue.append((r, i, sym[i] + sym[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged = heapq.heappop(queue)
            j = after[i]
            if sym[i] is None or j >= n or sym[i] + sym[j] != merged:
                continue
            sym[i], sym[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank.get(merged + sym[k])
                if r is not None:
                    heapq.heappush(queue, (r, i, merged + sym[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(sym[h] + merged)
                if r is not None:
                    heapq.heappush(queue, (r, h, sym[h] + merged))
        return [rank[s] for s in sym if s is not None]

    def split_and_encode(self, text: str) -> bytes:
        pieces, out = self._pieces, []
        for p in self._find(text):
            ids = pieces.get(p)
            if ids is None:
                ids = np.array(self.merge(p.encode("utf-8", "surrogatepass")), np.int32).tobytes()
                if len(p) <= LONG_WORD:
                    if len(pieces) >= CACHE_ENTRIES:
                        pieces.clear()
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def words(self, text: str) -> list[str]:
        """The text cut before each single space that a piece can start with; encoding word by word is encoding the text."""
        words = text.split(" ")
        if any(not w or w[0] in SPACES for w in words[1:]):
            words = self._cut(text)
        return [words[0], *(" " + w for w in words[1:])] if words[0] else [" " + w for w in words[1:]]

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian int32; nothing for an empty or null text."""
        if not text:
            return b""
        words = text.split(" ")
        tail = self._tail.__getitem__
        try:
            return self._head[words[0]] + b"".join(map(tail, words[1:])) if words[0] else b"".join(map(tail, words[1:]))
        except _Irregular:
            words = self._cut(text)
            return self._head[words[0]] + b"".join(map(tail, words[1:])) if words[0] else b"".join(map(tail, words[1:]))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_packed(text)) // 4

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.token[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def bpe_of(ranks: bytes) -> Bpe:
    """One encoder per worker process and vocabulary; its caches serve all tasks of the worker."""
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(ranks)
    return _LOADED[key]


def encode_column(bpe: Bpe, texts: Iterable[str | None]) -> Iterator[bytes]:
    for text in texts:
        yield bpe.encode_packed(text)
