"""Queries of the training-text operators over the tables of a data directory, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read, spread
from . import boilerplate, canonical, language, leaks, names, pii, reading, sentences, terms, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(read(spark, sf_dir, "documents"), read(spark, sf_dir, "acts"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_lines(read(spark, sf_dir, "documents"), p1_found(spark, sf_dir))


def p1_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.frequent_sequences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "acts"), max_gap=0).selectExpr("kind", "name", "array_join(pattern, ' ') as pattern", "docs")


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contexts = read(spark, sf_dir, "documents"), read(spark, sf_dir, "para_contexts")
    coder = language.corpus_coder(docs, contexts)
    found = language.languages(spread(docs), coder, "doc_id", True).select(F.lit("documents").alias("tbl"), "row_id", "line_no", "lang", "confidence")
    paras = sentences.distinct_texts(contexts)
    return found.unionByName(language.languages(paras, coder, "para_id", False).select(F.lit("para_contexts").alias("tbl"), "row_id", "line_no", "lang", "confidence"))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contexts = read(spark, sf_dir, "documents"), read(spark, sf_dir, "para_contexts")
    return language.language_spans(spread(docs), language.corpus_coder(docs, contexts), "doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, contexts = read(spark, sf_dir, "documents"), read(spark, sf_dir, "para_contexts")
    coder = language.corpus_coder(docs, contexts)
    wrong = (F.col("line_no") >= 0) | ~F.col("lang").eqNullSafe(F.col("stored"))
    found = language.languages(spread(docs), coder, "doc_id", True, stored="lang").select(F.lit("documents").alias("tbl"), "row_id", "line_no", "lang", "stored")
    paras = contexts.groupBy("para_id").agg(F.min_by(F.struct("text", "lang"), F.struct("text", "lang")).alias("r")).select("para_id", "r.*")
    found = found.unionByName(language.languages(paras, coder, "para_id", False, stored="lang").select(F.lit("para_contexts").alias("tbl"), "row_id", "line_no", "lang", "stored"))
    return found.where(wrong).drop("stored")


def _checked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paras = read(spark, sf_dir, "paras").select(F.lit("paras").alias("tbl"), F.col("para_id").alias("row_id"), "text")
    return paras.unionByName(read(spark, sf_dir, "issues").select(F.lit("issues").alias("tbl"), F.col("issue_id").alias("row_id"), F.col("context").alias("text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.lookalike_rows(_checked_texts(spark, sf_dir), ["tbl", "row_id"])


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.in_one_form(_checked_texts(spark, sf_dir), ["tbl", "row_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(read(spark, sf_dir, "documents")).select("doc_id", "line_no", "kind").distinct()


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(read(spark, sf_dir, "documents"))


def _named_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text")
    return docs.unionByName(read(spark, sf_dir, "paras").select(F.lit("paras").alias("tbl"), F.col("para_id").alias("row_id"), "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link(_named_texts(spark, sf_dir), read(spark, sf_dir, "registry"), ["tbl", "row_id"])


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.links(_named_texts(spark, sf_dir), read(spark, sf_dir, "registry"), ["tbl", "row_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.distinct_sentences(read(spark, sf_dir, "para_contexts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked_terms(read(spark, sf_dir, "documents")).where("mark is not null").select("term", "mark")


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_counts(read(spark, sf_dir, "documents"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "reading_labels")).select("doc_id", "level")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_clean, p1_sequences, p2_found, p2_languages, p2_segments, p3_found, p3_canonical, p4_found, p4_redacted, p5_found, p5_links, p6_found, p7_found, p7_counts, p8_ids, p9_found, p9_coverage, p10_found)}

_P1_LINES = r"""
lines as (
  select doc_id, source, cast(i - 1 as bigint) as line_no, lower(regexp_replace(pieces[i], '[^\p{L}]+', '', 'g')) as k
  from (select doc_id, source, string_split(text, chr(10)) as pieces from documents where text is not null) d, unnest(range(1, len(pieces) + 1)) as u(i)),
courts as (select doc_id, min(lower(regexp_replace(court, '[\s\p{Z}]+', '', 'g'))) as court from acts where court is not null group by doc_id),
grouped as (
  select d.doc_id, 'source' as kind, source as name from documents d where source is not null
  union all select d.doc_id, 'court', c.court from documents d join courts c using (doc_id)),
least as (select kind, name, greatest(5, 0.05 * count(*)) as least from grouped group by kind, name),
frequent as (
  select g.kind, g.name, l.k from lines l join grouped g using (doc_id) where length(l.k) >= 20
  group by g.kind, g.name, l.k having count(distinct l.doc_id) >= (select least from least x where x.kind = g.kind and x.name = g.name)),
found as (select distinct l.doc_id, l.line_no from lines l join grouped g using (doc_id) join frequent f on f.kind = g.kind and f.name = g.name and f.k = l.k)
"""
_P7_COUNTS = r"""
words as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as term from documents),
counts as (select term, count(*) as n, count(distinct doc_id) as docs from words group by term)
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": f"with {_P1_LINES} select doc_id, line_no from found",
    "p1_clean": f"""with {_P1_LINES},
pieces as (select doc_id, i, pieces[i] as piece from (select doc_id, string_split(text, chr(10)) as pieces from documents where text is not null) d, unnest(range(1, len(pieces) + 1)) as u(i)),
kept as (select p.doc_id, string_agg(piece, chr(10) order by i) as text from pieces p left join found f on f.doc_id = p.doc_id and f.line_no = p.i - 1 where f.doc_id is null group by p.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text from documents d left join kept k using (doc_id)""",
    "p7_found": f"with {_P7_COUNTS} select term, case when docs = 1 then 'rare' else 'common' end as mark from counts where docs = 1 or docs > 0.2 * (select count(*) from documents)",
    "p7_counts": f"with {_P7_COUNTS} select term, n, docs from counts",
}
