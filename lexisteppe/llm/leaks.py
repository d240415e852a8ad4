"""Evaluation passages inside training documents (problem 9), by greedy string tiling.

Documents and test items are exploded into seeds, hashes of a few words in a row that running Karp-Rabin gives, and
joined by equal seeds. The length of a seed and the least number of shared ones follow from the definition of a
passage (:func:`seed_rule`), so that no passage is without them. For each joined pair the longest common runs that
do not overlap are marked, longest first: runs in the same order, with few words lost, are a passage; the share of
the item's words under long runs, in whatever order, is its coverage.

Defined results: null and empty texts hold no passages; case, punctuation and line breaks do not count; in scripts
without spaces between words a character is a word; each (item, document) is given once, with the best of its rows;
items shorter than the least passage cannot leak; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, sized_join, spread

# Blocks of scripts that are written without spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORDS = re.compile(r"[^\W_]+")
CHARACTERS = re.compile(f"[{UNSPACED}]")
WORDS_OR_CHARACTERS = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1
SLACK = 2


def words_of(text: str) -> list[str]:
    return (WORDS_OR_CHARACTERS if CHARACTERS.search(text) else WORDS).findall(text.lower())


def seed_rule(least: int = 18, lost: float = 1 / 6) -> tuple[int, int]:
    """(words of a seed, shared seeds at least) of every passage.

    A passage of n words keeps n - k of them, k the lost ones, in k + 1 runs at most: its longest run is no shorter
    than the mean, and m words in a row hold m - size + 1 seeds.
    """
    cases = [(n, int(n * lost + 1e-9)) for n in range(least, 20 * least)]
    size = min(-((k - n) // (k + 1)) for n, k in cases)
    return size, max(1, min(n - k - (size - 1) * (k + 1) for n, k in cases))


def _windows(ids: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of the unmarked windows of a size, each hash rolled on from the one before."""
    h = length = 0
    out = pow(BASE, size, MODULUS)
    for i, x in enumerate(ids):
        if marked[i]:
            h = length = 0
            continue
        h = (h * BASE + x + 1) % MODULUS
        length += 1
        if length > size:
            h = (h - (ids[i - size] + 1) * out) % MODULUS
        if length >= size:
            yield h, i - size + 1


def tiles(doc: list[int], item: list[int], least: int = 2, first: int = 20) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the greedy tiling of two word sequences, in document order."""
    in_doc, in_item = bytearray(len(doc)), bytearray(len(item))
    out: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(doc), len(item)))
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for h, i in _windows(item, in_item, size):
            table[h].append(i)
        matches: list[tuple[int, int, int]] = []
        longer = 0
        for h, d in _windows(doc, in_doc, size):
            for i in table.get(h, ()):
                if doc[d : d + size] != item[i : i + size]:
                    continue
                if d and i and doc[d - 1] == item[i - 1] and not in_doc[d - 1] and not in_item[i - 1]:
                    continue  # part of the match that began one word earlier
                k = size
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and not in_doc[d + k] and not in_item[i + k]:
                    k += 1
                longer = max(longer, k)
                matches.append((k, d, i))
        if longer > 2 * size:
            size = longer
            continue
        for k, d, i in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(in_doc[d : d + k]) and not any(in_item[i : i + k]):
                in_doc[d : d + k] = b"\1" * k
                in_item[i : i + k] = b"\1" * k
                out.append((d, i, k))
        if size == least:
            return sorted(out)
        size = max(least, size // 2)


def common(a: list[int], b: list[int]) -> int:
    """The most words that two short sequences have in the same order."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _beside(doc: list[int], item: list[int], reach: int) -> list[tuple[int, int]]:
    """(words of the item, kept ones) of what may lengthen a passage; both begin beside its end and lead away from it."""
    out = [(0, 0)]
    for m in range(1, min(reach, len(item)) + 1):
        kept = common(item[:m], doc[: m + SLACK])
        if kept > out[-1][1]:
            out.append((m, kept))
    return out


def holds_passage(parts: list[tuple[int, int, int]], doc: list[int], item: list[int], least: int = 18, lost: float = 1 / 6, slack: int = SLACK) -> bool:
    """Whether tiles in the same order in both texts, with single words between them, are a passage of ``least`` words of the item.

    Of the passage at most the share ``lost`` may be missing; the document may hold at most ``slack`` words more
    than the item between two tiles. From every tile the chains with most words kept are followed. No gap between tiles
    of two words or more, of which at least half the words are lost, need be longer than ``reach``: of the two parts
    beside such a gap one is a passage if the whole is; the same holds for the ends.
    """
    if len(item) < least:
        return False
    parts = sorted(parts, key=lambda t: t[1])
    reach = int(least * lost / (0.5 - lost) + 1e-9) if lost < 0.5 else least
    before = [_beside(doc[max(0, d - reach - slack) : d][::-1], item[max(0, i - reach) : i][::-1], reach) for d, i, _ in parts]
    after = [_beside(doc[d + k : d + k + reach + slack], item[i + k : i + k + reach], reach) for d, i, k in parts]
    for a in range(len(parts)):
        begin = parts[a][1]
        best = {a: parts[a][2]}
        for b in range(a, len(parts)):
            if b not in best:
                continue
            d, i, k = parts[b]
            if any(_enough(best[b] + x + y, i + k - begin + m + n, least, lost) for m, x in before[a] for n, y in after[b]):
                return True
            for c in range(b + 1, len(parts)):
                e, j, n = parts[c]
                if j - i - k > reach:
                    break
                if e >= d + k and e - d - k <= j - i - k + slack:
                    best[c] = max(best.get(c, 0), best[b] + n + common(item[i + k : j], doc[d + k : e]))
    return False


def _enough(kept: int, span: int, least: int, lost: float) -> bool:
    size = max(span, least)
    return size - kept <= size * lost + 1e-9


def may_hold(doc: set[int], item: list[int], least: int, lost: float) -> bool:
    """Whether enough of some ``least`` or more words of an item in a row occur in a region at all, in any order."""
    sums, total = [0.0], 0.0
    for x in item:
        total += lost if x in doc else lost - 1
        sums.append(total)
    low = float("inf")
    for end in range(least, len(sums)):
        low = min(low, sums[end - least])
        if sums[end] - low >= -1e-6:
            return True
    return False


class Item:
    """A test item's words as numbers, and its seeds."""

    def __init__(self, text: str, seed: int) -> None:
        self.numbers: dict[str, int] = {}
        self.words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
        self.places: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for i, x in enumerate(zip(*(self.words[k:] for k in range(seed)), strict=False)):
            self.places[x].append(i)


def compared(doc: list[int], item: Item, seed: int, least: int, lost: float, threshold: float) -> tuple[int, bool]:
    """(words of the item under tiles of a seed's length or more, whether the document holds a passage).

    Only the regions around shared seeds are tiled, with room for a whole item on both sides of a seed. What cannot
    be a passage, or cannot cover the threshold, by the words that occur there at all is not tiled; then no words
    count as covered.
    """
    words, known = item.words, item.places
    at = [i for i, x in enumerate(zip(*(doc[k:] for k in range(seed)), strict=False)) if x in known]
    room = (SLACK + 1) * len(words)
    regions: list[list[int]] = []
    for i in at:
        if regions and i - room <= regions[-1][1]:
            regions[-1][1] = min(len(doc), i + seed + room)
        else:
            regions.append([max(0, i - room), min(len(doc), i + seed + room)])
    passage = False
    for a, b in regions:
        part = doc[a:b]
        passage = passage or may_hold(set(part), words, least, lost) and holds_passage(tiles(part, words), part, words, least, lost)
    under = {p + k for x in {tuple(doc[i : i + seed]) for i in at} for p in known[x] for k in range(seed)}
    if len(under) < threshold * len(words):
        return 0, passage
    joined = [x for n, (a, b) in enumerate(regions) for x in (*doc[a:b], -1 - n)]
    return sum(k for _, _, k in tiles(joined, words, seed)) if joined else 0, passage


class Hashes(dict):
    """64-bit hashes of words, found once for each distinct word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _seeds(texts: DataFrame, key: str, size: int) -> DataFrame:
    """(key, seeds): the hashes of all ``size`` words in a row of every text."""
    kind = texts.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            offsets, found = [0], []
            for text in b.column(1).to_pylist():
                words = words_of(text) if text else []
                n = len(words) - size + 1
                if n > 0:
                    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                    h = np.zeros(n, np.uint64)
                    for k in range(size):
                        h = h * np.uint64(BASE) + ids[k : n + k]
                    found.append(h)
                offsets.append(offsets[-1] + (len(found[-1]) if n > 0 else 0))
            values = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[key, "seeds"])

    return arrow_map(texts.select(key, "text").where(F.col("text").isNotNull()), kernel, f"{key} {kind}, seeds array<bigint>", 500)


def coverage(documents: DataFrame, items: DataFrame, threshold: float = 0.5, least: int = 18, lost: float = 1 / 6) -> DataFrame:
    """(item_id, doc_id, words, covered, coverage, passage) of the pairs with a passage, or with so much of the item that
    its passages stand there in another order. With a threshold above 1 only passages count, and nothing is covered.

    Documents give their seeds, which are joined with those of the items, measured and broadcast or else salted.
    Only the documents of the pairs with as many shared seeds as a passage has, a few rows, are tiled.
    """
    size, shared = seed_rule(least, lost)
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    documents = spread(documents.select("doc_id", "text").where("text is not null"))
    item_seeds = _seeds(items, "item_id", size).select("item_id", F.explode("seeds").alias("seed"))
    doc_seeds = _seeds(documents, "doc_id", size).select("doc_id", F.explode("seeds").alias("seed"))
    pairs = sized_join(doc_seeds, item_seeds, ["seed"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared).select("doc_id", "item_id")
    both = sized_join(sized_join(documents, pairs, ["doc_id"]), items.withColumnRenamed("text", "item_text"), ["item_id"])
    doc_kind, item_kind = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Item] = {}
        for b in batches:
            rows = []
            for text, item_text in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                item = held.get(item_text)
                if item is None:
                    if len(held) > 10_000:
                        held.clear()
                    item = held[item_text] = Item(item_text, size)
                covered, passage = compared([item.numbers.get(w, 0) for w in words_of(text)], item, size, least, lost, threshold)
                rows.append((len(item.words), covered, passage))
            words, covered, passage = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(words, pa.int32()), pa.array(covered, pa.int32()), pa.array(passage, pa.bool_())], names=["item_id", "doc_id", "words", "covered", "passage"])

    tiled = arrow_map(both.select("doc_id", "text", "item_id", "item_text"), kernel, f"item_id {item_kind}, doc_id {doc_kind}, words int, covered int, passage boolean", 100)
    wanted = tiled.where((F.col("words") >= least) & (F.col("passage") | (F.col("covered") >= threshold * F.col("words"))))
    best = wanted.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max("covered").alias("covered"), F.max("passage").alias("passage"))
    return best.select("item_id", "doc_id", "words", "covered", F.round(F.col("covered") / F.col("words"), 6).alias("coverage"), "passage")


def leaks(documents: DataFrame, items: DataFrame, least: int = 18, lost: float = 1 / 6) -> DataFrame:
    """The distinct (item_id, doc_id) where a document holds a passage of a test item."""
    return coverage(documents, items, 2.0, least, lost).where("passage").select("item_id", "doc_id")
