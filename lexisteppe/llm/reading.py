"""Reading level of each document (problem 10): a familiar-word formula.

A word is familiar when it stands in at least ``familiar_share`` of the documents. A document's difficulty is
the logarithm of its average sentence length and the share of its words outside the familiar list, weighed by a
least-squares fit to readers' grades; the levels are cut between grades 1, 3 and 5. Document frequencies cover
all documents; only the fit uses labelled rows, at most ``most_labels`` of them.

Defined results: documents with fewer than ``min_letters`` letters, without text, or in other languages get no
row; null grades and repeated label rows are left out; without documents graded about 1, 3 and 5 the weights
of ``DEFAULT_WEIGHTS`` hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import LETTER_RUNS, lowered_runs
from ..runtime import arrow_map, checkpointed

#: Grade = weights . (1, log of words a sentence, share of unfamiliar words), as fitted to invented court texts.
DEFAULT_WEIGHTS = (-2.2, 2.1, 0.5)
DEFAULT_CUTS = (2.1, 3.9)
LEVELS = ("easy", "middle", "hard")
SENTENCE_END = regex.compile(r"[.!?…]+(?=\s|$)|\n+")
EASTERN = regex.compile(r"[\p{Han}\p{Arabic}\p{Hiragana}\p{Katakana}]")


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs: Counter[str] = Counter()
        for text in b.column(0).to_pylist():
            if text:
                docs.update(set(lowered_runs(text)))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(docs.values(), pa.int64())], names=["word", "docs"])


def familiar_words(documents: DataFrame, share: float = 0.01) -> frozenset[str]:
    """Words in at least ``share`` of all documents: no more than (words of an average document) / share."""
    rows = documents.count()
    counts = arrow_map(documents.select("text"), _document_words, "word string, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))
    return frozenset(r.word for r in counts.where(F.col("docs") >= share * rows).select("word").collect())


def measures(documents: DataFrame, familiar: frozenset[str]) -> DataFrame:
    """(doc_id, letters, eastern, sentence_words, unfamiliar) of each document with letters."""
    known = documents.sparkSession.sparkContext.broadcast(familiar)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        familiar = known.value
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                words = lowered_runs(text)
                letters = sum(map(len, words))
                if not letters:
                    continue
                sizes = [k for part in SENTENCE_END.split(text) if (k := len(LETTER_RUNS.findall(part))) > 1] or [len(words)]
                unfamiliar = sum(w not in familiar for w in words) / len(words)
                out.append((doc, letters, len(EASTERN.findall(text)), sum(sizes) / len(sizes), unfamiliar))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "letters", "eastern", "sentence_words", "unfamiliar"])

    return arrow_map(documents.select("doc_id", "text"), kernel, "doc_id bigint, letters bigint, eastern bigint, sentence_words double, unfamiliar double")


def fit(measured: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> tuple[tuple[float, ...], tuple[float, float]]:
    """Weights of the formula and the two cuts between levels.

    From at most ``most_labels`` graded documents, taken in the order of a hash of their id. A cut lies half-way
    between the mean results of the documents graded about 1 and 3, 3 and 5.
    """
    grades = labels.where("grade is not null").dropDuplicates(["label_id", "doc_id", "rater", "grade"]).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    rows = measured.join(grades, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).select("sentence_words", "unfamiliar", "grade").collect()
    y = np.array([r.grade for r in rows])
    groups = [y <= 1.5, (y >= 2.5) & (y <= 3.5), y >= 4.5] if rows else []
    if not rows or not all(g.any() for g in groups):
        return DEFAULT_WEIGHTS, DEFAULT_CUTS
    x = np.array([[1, math.log(r.sentence_words), r.unfamiliar] for r in rows])
    weights = np.linalg.lstsq(x, y, rcond=None)[0]
    low, middle, high = (float((x[g] @ weights).mean()) for g in groups)
    return tuple(float(v) for v in weights), ((low + middle) / 2, (middle + high) / 2)


def levels(documents: DataFrame, labels: DataFrame, min_letters: int = 300, familiar_share: float = 0.01) -> DataFrame:
    """(doc_id, level, grade): the level of each document of ``min_letters`` letters in a script with word spaces."""
    measured = checkpointed(measures(documents, familiar_words(documents, familiar_share)))
    (a, b, c), cuts = fit(measured, labels)
    grade = F.lit(a) + F.lit(b) * F.log("sentence_words") + F.lit(c) * F.col("unfamiliar")
    level = F.when(F.col("grade") < cuts[0], LEVELS[0]).when(F.col("grade") < cuts[1], LEVELS[1]).otherwise(LEVELS[2])
    return measured.where((F.col("letters") >= min_letters) & (F.col("eastern") < 0.5 * F.col("letters"))).select("doc_id", grade.alias("grade")).select("doc_id", level.alias("level"), "grade")
