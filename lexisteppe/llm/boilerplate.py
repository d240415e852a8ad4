"""Lines repeated across the documents of one site or court (problem 1).

Distributed PrefixSpan: each document is the sequence of the identifiers of its long lines, each source and each
court is a database of such sequences. A line's identifier is a 128-bit hash of its letters in lower case. Equal
sequences of frequent lines are one row with a weight, so that copies cost nothing; the lines of the sequences that
are found, single ones included, are then deleted from the documents of their source or court.

Defined results: null and empty texts have no lines but count as documents of their group; rows of ``documents``
are taken as they are (``doc_id`` is unique there); a null source or court is no group; repeated rows of ``acts``
count once and of several courts of one document the smallest name counts; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import JAVA_NOT_LETTERS
from ..runtime import checkpointed, sized_join

ITEM = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The letters of a line, in order and in lower case."""
    return F.lower(F.regexp_replace(line, JAVA_NOT_LETTERS, ""))


def court_key(court: Column) -> Column:
    """A court's name without its case and white space."""
    return F.lower(F.regexp_replace(court, r"(?U)\s+", ""))


def sequences(documents: DataFrame, acts: DataFrame, min_letters: int = 20) -> DataFrame:
    """One row for each document: doc_id, grp (its source and court) and items (line_no and hash of its long lines).

    The lines are hashed before the join with the courts, so that no text is shuffled.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), F.when(F.length(x) >= min_letters, line_key(x)).alias("key")))
    long = F.filter(lines, lambda x: F.length(x["key"]) >= min_letters)
    items = F.transform(long, lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("2"), x["key"]).alias("h2")))
    docs = documents.select("doc_id", "source", items.alias("items"))
    courts = acts.where("court is not null").groupBy("doc_id").agg(F.min(court_key(F.col("court"))).alias("court"))
    groups = F.filter(
        F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")), F.struct(F.lit("court").alias("kind"), F.col("court").alias("name"))),
        lambda g: g["name"].isNotNull(),
    )
    return docs.join(courts, "doc_id", "left").select("doc_id", groups.alias("groups"), F.coalesce("items", F.array().cast("array<struct<line_no:int,h1:bigint,h2:bigint>>")).alias("items"))


def frequent_lines(seqs: DataFrame, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """Level 1 of the search: (kind, name, h1, h2, n, least) of the items with enough supporting documents.

    A document supports an item once, so repeats are removed inside the row and the counts need no distinct.
    Counting combines within each task before its shuffle; no group is gathered anywhere.
    """
    grouped = seqs.select(F.explode("groups").alias("g"), F.array_distinct(F.transform("items", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")))).alias("items"))
    least = grouped.groupBy("g.kind", "g.name").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(min_share)).alias("least"))
    counts = grouped.select("g.kind", "g.name", F.explode("items").alias("i")).groupBy("kind", "name", "i.h1", "i.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return sized_join(counts, least, ["kind", "name"]).where(F.col("n") >= F.col("least"))


def _lines(seqs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, line_no, h1, h2): the long lines of every document in each of its groups."""
    each = seqs.where(F.size("items") > 0).select("doc_id", F.explode("groups").alias("g"), "items").select("doc_id", "g.kind", "g.name", F.explode("items").alias("i"))
    return each.select("doc_id", "kind", "name", "i.line_no", *[F.col(f"i.{x}").alias(x) for x in ITEM])


def mined(seqs: DataFrame, min_docs: int = 5, min_share: float = 0.05, max_gap: int | None = 0, max_length: int | None = None) -> DataFrame:
    """(kind, name, pattern, docs): the frequent sequences of lines of every source and court by prefix growth.

    A sequence is a row of frequent lines with at most ``max_gap`` other frequent lines between neighbours (None: any
    number; lines that are not frequent never count). Without a gap a document of m frequent lines has m * (m + 1) / 2
    sequences at most, with any gaps 2^m. Each level extends every prefix behind all its ends by one line, adds up the
    weights and keeps the prefixes with enough support; it is written, so that no level is worked out again. The search
    ends with the first level that has none, or with ``max_length``.
    """
    first = checkpointed(frequent_lines(seqs, min_docs, min_share))
    kept = sized_join(_lines(seqs), first.select("kind", "name", *ITEM, "least"), ["kind", "name", *ITEM])
    item = F.struct(*ITEM)
    per_doc = kept.groupBy("doc_id", "kind", "name", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", item.alias("item")))), lambda x: x["item"]).alias("items"))
    weighted = per_doc.groupBy("kind", "name", "least", "items").agg(F.count("*").alias("weight"))
    projected = checkpointed(weighted).withColumn("pattern", F.slice("items", 1, 0)).withColumn("ends", F.lit(None).cast("array<int>"))
    size = F.size("items")
    found = None
    for level in count(1):
        # Where the next line may stand, from 1: anywhere at first, then within the gap behind an end.
        behind = F.flatten(F.transform("ends", lambda e: F.when(e < size, F.sequence(e + 1, size if max_gap is None else F.least(e + 1 + max_gap, size))).otherwise(F.array().cast("array<int>"))))
        places = F.when(F.col("ends").isNull(), F.sequence(F.lit(1), size)).otherwise(F.array_distinct(behind))
        grown = projected.withColumn("places", places).withColumn("item", F.explode(F.array_distinct(F.transform("places", lambda p: F.get("items", p - 1)))))
        grown = grown.select("kind", "name", "least", "items", "weight", F.array_append("pattern", F.col("item")).alias("pattern"), F.filter("places", lambda p: F.get("items", p - 1) == F.col("item")).alias("ends"))
        grown = checkpointed(grown)
        support = grown.groupBy("kind", "name", "pattern").agg(F.sum("weight").alias("docs"), F.first("least").alias("least")).where("docs >= least").select("kind", "name", "pattern", "docs")
        support = checkpointed(support)
        found = support if found is None else found.unionByName(support)
        if level == max_length or support.isEmpty():
            return found
        projected = sized_join(grown, support.select("kind", "name", "pattern"), ["kind", "name", "pattern"], "left_semi").where(F.array_min("ends") < size)


def frequent_sequences(documents: DataFrame, acts: DataFrame, max_length: int | None = None, min_letters: int = 20, min_docs: int = 5, min_share: float = 0.05, max_gap: int | None = None) -> DataFrame:
    """(kind, name, pattern, docs) of :func:`mined`, each line of a pattern as 32 hexadecimal digits."""
    found = mined(checkpointed(sequences(documents, acts, min_letters)), min_docs, min_share, max_gap, max_length)
    return found.withColumn("pattern", F.transform("pattern", lambda x: F.format_string("%016x%016x", x["h1"], x["h2"])))


def repeated_lines(documents: DataFrame, acts: DataFrame, min_letters: int = 20, min_docs: int = 5, min_share: float = 0.05) -> DataFrame:
    """(doc_id, line_no) of every line of a frequent sequence, in all documents of its source or court.

    Single lines are sequences too, so a line of a longer notice is found also where it stands alone.
    """
    seqs = checkpointed(sequences(documents, acts, min_letters))
    patterns = mined(seqs, min_docs, min_share)
    wanted = patterns.select("kind", "name", F.inline("pattern")).distinct()
    hits = sized_join(_lines(seqs), wanted, ["kind", "name", *ITEM], "left_semi")
    return hits.groupBy("doc_id", "line_no").agg(F.count("*").alias("groups")).select("doc_id", "line_no")


def without_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text): every document without the given lines; a null text stays null."""
    gone = lines.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return documents.select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))
