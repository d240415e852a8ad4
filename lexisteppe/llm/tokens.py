"""Encoding with a public byte-level BPE vocabulary (problem 8).

Pre-tokens are merged with a rank queue: a bucket for each merge rank holds the positions, in a linked list of
symbols, of the pairs of that rank; a three-level bitmap over the ranks gives the lowest rank that has any by
find-first-set. Entries whose pair has changed meanwhile are skipped when their bucket comes. A pre-token of n
bytes so takes O(n) queue operations, however long it is.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; rows are given as they come.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..runtime import arrow_map

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Which ranks wait, as bits of words at three levels of 64, with a bucket of positions for each."""

    def __init__(self) -> None:
        self.top, self.mid, self.low = 0, {}, {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        word, group = rank >> 6, rank >> 12
        self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
        self.mid[group] = self.mid.get(group, 0) | 1 << (word & 63)
        self.top |= 1 << group

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank that waits and its positions from the left."""
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        m = self.mid[group]
        word = group << 6 | (m & -m).bit_length() - 1
        x = self.low[word]
        rank = word << 6 | (x & -x).bit_length() - 1
        self.low[word] = x = x & (x - 1)
        if not x:
            self.mid[group] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Byte-level BPE over the ranks of a vocabulary file (one base64 token and its rank on each line)."""

    def __init__(self, path: str, pattern: str = PATTERN, most_kept: int = 300_000) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [self.ranks[bytes([i])] for i in range(256)]
        names = {v: k for k, v in self.ranks.items()}
        self.pairs: dict[int, int] = {}  # the rank of two neighbours, found once for each pair
        self.names = names
        self.split = regex.compile(pattern).findall
        self.most_kept = most_kept
        self.kept: dict[str, bytes] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank at which two tokens merge, or -1."""
        key = a << 20 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.names[a] + self.names[b], -1)
        return rank

    def merge(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        symbols = [self.bytes[b] for b in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        queue = RankQueue()
        for i in range(n - 1):
            if (r := self.pair(symbols[i], symbols[i + 1])) >= 0:
                queue.push(r, i)
        while (next_up := queue.pop()) is not None:
            rank, places = next_up
            for i in places:
                j = after[i]
                if not alive[i] or j >= n or self.pair(symbols[i], symbols[j]) != rank:
                    continue  # stale: one of the two was merged meanwhile
                symbols[i], alive[j] = rank, 0
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (r := self.pair(rank, symbols[k])) >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0 and (r := self.pair(symbols[h], rank)) >= 0:
                    queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers. Pre-tokens seen before are looked up."""
        kept, parts = self.kept, []
        for word in self.split(text):
            ids = kept.get(word)
            if ids is None:
                ids = np.array(self.merge(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
                if len(word) <= 64:
                    if len(kept) >= self.most_kept:
                        kept.clear()
                    kept[word] = ids
            parts.append(ids)
        return b"".join(parts)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where an installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): each text as token ids. ``path`` names a rank file that every executor can read."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path or vocabulary_path())
        for b in batches:
            parts = [e.encode_bytes(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_column, "ids"])

    return arrow_map(documents.select(id_column, text_column), kernel, f"{id_column} {documents.schema[id_column].dataType.simpleString()}, ids array<int>", 500)
