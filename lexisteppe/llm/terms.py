"""Frequency of every distinct term (problem 7), by counting in burst tries.

Each task counts its documents' terms into a burst trie: containers of terms with two counters, which burst into
one container for each next letter when they hold too many. The entries of all tasks are routed by adaptive
prefixes: a prefix with too many entries is lengthened to the letter where its terms part, level by level, so that
no group grows with the data however long the terms or large the collection. The entries of one prefix meet in one
group, where the tasks' subtrees are merged into one trie.

Defined results: a null text and a text without letters have no terms, but their rows count in the share of
records; rows are counted as given; an empty table gives no terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import lowered_runs
from ..runtime import arrow_map, checkpointed, ship_package, sized_join, spread

LEAF = "prefix string, terms array<string>, n array<bigint>, docs array<bigint>"


class BurstTrie:
    """Terms with two counters. A node is a dict of letters, a leaf a dict of whole terms."""

    def __init__(self, most: int = 4096) -> None:
        self.most, self.root = most, ("leaf", {})

    def add(self, term: str, n: int, docs: int) -> None:
        node, up, depth = self.root, None, 0
        while node[0] == "node":
            letter = term[depth : depth + 1]
            up, depth = node[1], depth + 1
            node = up.get(letter) or up.setdefault(letter, ("leaf", {}))
            if not letter:
                break
        held = node[1]
        counts = held.get(term)
        if counts is None:
            held[term] = [n, docs]
            if len(held) > self.most and depth < 64:
                self._burst(node, up, term[depth - 1 : depth] if depth else None, depth)
        else:
            counts[0] += n
            counts[1] += docs

    def _burst(self, node: tuple, up: dict | None, letter: str | None, depth: int) -> None:
        parts: dict[str, tuple] = {}
        for term, counts in node[1].items():
            parts.setdefault(term[depth : depth + 1], ("leaf", {}))[1][term] = counts
        if up is None:
            self.root = ("node", parts)
        else:
            up[letter] = ("node", parts)

    def leaves(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(prefix, container) of each leaf; an empty letter marks the term that ends at its node."""
        stack = [("", self.root)]
        while stack:
            prefix, (kind, held) = stack.pop()
            if kind == "leaf":
                if held:
                    yield prefix, held
            else:
                stack += [(prefix + letter, x) for letter, x in held.items()]


def _rows(leaves: Iterator[tuple[str, dict[str, list[int]]]], per_batch: int = 64) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["prefix", "terms", "n", "docs"])

    for prefix, held in leaves:
        out.append((prefix, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()]))
        if len(out) >= per_batch:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = BurstTrie()
    for b in batches:
        n: Counter[str] = Counter()
        docs: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            if text:
                words = lowered_runs(text)
                n.update(words)
                docs.update(set(words))
        for term, k in n.items():
            trie.add(term, k, docs[term])
    yield from _rows(trie.leaves())


def _merge(table: pa.Table) -> pa.Table:
    """One trie of a prefix's entries from all tasks."""
    trie = BurstTrie()
    for term, k, d in zip(*(table.column(x).to_pylist() for x in ("term", "n", "docs")), strict=True):
        trie.add(term, k, d)
    rows = [(term, *counts) for _, held in trie.leaves() for term, counts in held.items()]
    term, n, docs = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"term": pa.array(term, pa.string()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})


def routed(entries: DataFrame, subtree: int) -> DataFrame:
    """Entries (term, ...) with the prefix of their group, which has at most ``subtree`` entries or one term only.

    Each level counts the entries of every prefix that may still be too large and joins the lengths of the next
    prefixes back: the common prefix of the first and the last term is that of all between.
    """
    out = entries.withColumn("prefix", F.substring("term", 1, 1)).withColumn("_open", F.lit(True))
    same = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length("lo"), F.length("hi"))), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substring(F.col("lo"), i, F.lit(1)) == F.substring(F.col("hi"), i, F.lit(1))), i).otherwise(n),
    )
    while True:
        groups = out.where("_open").groupBy("prefix").agg(F.count("*").alias("entries"), F.min("term").alias("lo"), F.max("term").alias("hi"))
        burst = checkpointed(groups.where((F.col("entries") > subtree) & (F.col("lo") != F.col("hi"))).select("prefix", (same + 1).alias("_length")))
        if burst.isEmpty():
            return out.drop("_open")
        longer = F.when(F.col("_open"), F.substring(F.col("term"), F.lit(1), F.col("_length")))
        out = sized_join(out, burst, ["prefix"], "left").withColumn("_open", F.col("_open") & F.col("_length").isNotNull()).withColumn("prefix", F.coalesce(longer, "prefix")).drop("_length")


def term_counts(documents: DataFrame, column: str = "text", subtree: int = 50_000) -> DataFrame:
    """(term, n, docs): occurrences and records of every term of a text column. ``subtree`` is how many entries a merged group may hold."""
    leaves = checkpointed(arrow_map(spread(documents.select(column)), _count, LEAF))
    entries = leaves.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "n", "docs")))
    ship_package(documents.sparkSession)
    return routed(entries, subtree).groupBy("prefix").applyInArrow(_merge, "term string, n bigint, docs bigint")


def marked_terms(documents: DataFrame, common_share: float = 0.2) -> DataFrame:
    """(term, n, docs, mark): mark is rare (in one record), common (in more than the share of all rows) or null."""
    rows = documents.count()
    mark = F.when(F.col("docs") == 1, "rare").when(F.col("docs") > common_share * rows, "common")
    return term_counts(documents).withColumn("mark", mark)
