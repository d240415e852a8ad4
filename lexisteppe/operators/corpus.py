"""Analytics of a whole collection: samples, lexicon, names, stop words, noise of the rules."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LETTERS
from ..functions.segment import WORD, words
from ..runtime import arrow_map, checkpointed, sized_join
from .onepass import compiled, is_lower, is_title

FLAG_SHARE = 0.34


def paragraphs_of(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc, para, text): the lines of every document; null texts have none."""
    return documents.select(key, F.posexplode(F.split("text", "\n")).alias("para", "text"))


def kk_share(text: Column) -> Column:
    """How many in a hundred characters are the small letters ә қ ң ү; null for an empty text."""
    return F.when(F.length(text) > 0, (F.length(text) - F.length(F.translate(text, "әқңү", ""))) * F.lit(100.0) / F.length(text))


def share_language(text: Column) -> Column:
    return F.when(kk_share(text) > 1, "kk").otherwise("ru")


def with_court(documents: DataFrame, acts: DataFrame, measured: bool = False) -> DataFrame:
    """Documents with their court, else with the part of the file name before its first hyphen, in capitals.

    ``measured``: by :func:`sized_join`, so that few courts are joined without moving the texts.
    """
    courts = acts.where("court is not null").groupBy("doc_id").agg(F.min("court").alias("_court"))
    prefix = F.when(F.instr("filename", "-") > 0, F.upper(F.substring_index("filename", "-", 1))).otherwise(F.when(F.col("filename").isNotNull(), ""))
    joined = sized_join(documents, courts, ["doc_id"], "left") if measured else documents.join(courts, "doc_id", "left")
    return joined.withColumn("court", F.coalesce("_court", prefix)).drop("_court")


def stratified_sample(documents: DataFrame, quotas: dict[str, int], seed: str, least: int = 4_000, most: int = 30_000) -> DataFrame:
    """(doc_id, lang, place): for each language the first documents in the order of a seeded hash of their id.

    The largest quota is a literal bound of the rank, so every task keeps that many rows of a language at most and
    only those are exchanged; smaller quotas are cut afterwards. A language without a quota has none.
    """
    fit = documents.where(F.length("text").between(least, most)).select("doc_id", share_language(F.col("text")).alias("lang"), F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))).alias("_h"))
    ranked = fit.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("place") <= F.lit(max(quotas.values(), default=0)))
    limit = F.lit(0)
    for lang, n in quotas.items():
        limit = F.when(F.col("lang") == lang, n).otherwise(limit)
    return ranked.where(F.col("place") <= limit).select("doc_id", "lang", "place")


def corpus_words(documents: DataFrame) -> DataFrame:
    """(doc_id, court, word, title, lower) of words of three letters or more without Latin letters.

    ``title``: capitalised and not behind a sentence's end; ``lower``: wholly in small letters.
    """
    start = rf"(?Um)(?:^|[.!?»]\s+)([{LETTERS}]+(?:[-'’][{LETTERS}]+)*)"
    exploded = documents.select("doc_id", "court", F.explode(words(F.col("text"))).alias("word"), F.lit(False).alias("starts"))
    firsts = documents.select("doc_id", "court", F.explode(F.regexp_extract_all("text", F.lit(start), F.lit(1))).alias("word"))
    # A word is counted as a name only for its occurrences that begin no sentence.
    begun = firsts.groupBy("doc_id", "word").agg(F.count("*").alias("_begun"))
    counted = exploded.groupBy("doc_id", "court", "word").agg(F.count("*").alias("n"))
    fit = (F.length("word") >= 3) & ~F.col("word").rlike(r"(?U)[A-Za-z\d]")
    joined = counted.where(fit).join(begun, ["doc_id", "word"], "left")
    title = F.col("word").rlike(r"(?U)^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$") & (F.col("n") > F.coalesce("_begun", F.lit(0)))
    return joined.select("doc_id", "court", "word", "n", title.alias("title"), F.col("word").rlike(r"(?U)^[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$").alias("lower"))


_MOST_WORDS = 300_000


def word_totals(documents: DataFrame) -> DataFrame:
    """(word, lower, docs, courts): how many documents and courts have each small-letter word and, not ``lower``, each title.

    What grouping the rows of :func:`corpus_words` gives, where every document is one row; words are counted in each
    task before they are exchanged.
    """
    # The beginnings of corpus_words, with a line feed before the text.
    begins = r"[.!?»\n\r\u0085\u2028\u2029](?:(?<=[.!?»])\s+|(?<![.!?»]))"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, start, capital = compiled(WORD), compiled(rf"(?U){begins}([{LETTERS}]+(?:[-'’][{LETTERS}]+)*)"), compiled(r"(?U)\p{Lu}")
        latin = compiled("[A-Za-z]")
        kinds: dict[str, int] = {}
        totals: dict[str | None, Counter] = {}

        def kind(w: str) -> int:
            return 0 if len(w) < 3 or latin.search(w) else 1 if is_lower(w) else 2 if is_title(w) else 0

        def flushed() -> pa.RecordBatch:
            rows = [(w, kinds[w] == 1, court, n) for court, counts in totals.items() for w, n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            totals.clear()
            kinds.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["word", "lower", "court", "n"])

        for b in batches:
            for court, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                counts = Counter(word.findall(text))
                for w in counts.keys() - kinds.keys():
                    kinds[w] = kind(w)
                titles = [w for w in counts if kinds[w] == 2] if capital.search(text) else []
                begun = Counter(start.findall("\n" + text)) if titles else {}
                here = totals.setdefault(court, Counter())
                here.update([w for w in counts if kinds[w] == 1])
                here.update([w for w in titles if counts[w] > begun.get(w, 0)])
            if len(kinds) + sum(map(len, totals.values())) > _MOST_WORDS:
                yield flushed()
        yield flushed()

    found = arrow_map(documents.select("court", "text"), kernel, "word string, lower boolean, court string, n bigint")
    by_court = found.groupBy("word", "lower", "court").agg(F.sum("n").alias("n"))
    return by_court.groupBy("word", "lower").agg(F.sum("n").alias("docs"), F.count("court").alias("courts"))


def mined_lists(documents: DataFrame, acts: DataFrame, min_docs: int = 3, min_courts: int = 2, lower_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The words of :func:`lexicon_candidates` and of :func:`corpus_names` as two lists (form), written, from one pass over the texts.

    Documents of which an id stands in several rows, or none, are grouped by :func:`corpus_words`.
    """
    ids = documents.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        totals = checkpointed(word_totals(with_court(documents, acts, measured=True)))
        enough = totals.where((F.col("docs") >= min_docs) & (F.col("courts") >= min_courts))
        small = totals.where("lower").select(F.col("word").alias("_low"), F.col("docs").alias("_small"))
        proper = enough.where(~F.col("lower")).join(small, F.lower("word") == F.col("_low"), "left").where(F.coalesce("_small", F.lit(0)) <= lower_share * F.col("docs"))
        forms = enough.where("lower")
    else:
        found = checkpointed(corpus_words(with_court(documents, acts)))
        forms, proper = lexicon_candidates(found, min_docs=min_docs, min_courts=min_courts), corpus_names(found, None, min_docs, min_courts, lower_share)
    return checkpointed(forms.select(F.col("word").alias("form"))), checkpointed(proper.select(F.col("word").alias("form")))


def lexicon_candidates(words_: DataFrame, known: DataFrame | None = None, min_docs: int = 5, min_courts: int = 3) -> DataFrame:
    """(word, docs, courts) of small-letter words in enough documents and courts that no list (form) knows.

    Rows are one for each document and word already, so documents are counted without a distinct.
    """
    counted = words_.where("lower").groupBy("word").agg(F.count("*").alias("docs"), F.count_distinct("court").alias("courts")).where((F.col("docs") >= min_docs) & (F.col("courts") >= min_courts))
    return counted if known is None else counted.join(known.select(F.col("form").alias("word")).distinct(), "word", "left_anti")


def corpus_names(words_: DataFrame, known: DataFrame | None = None, min_docs: int = 3, min_courts: int = 2, lower_share: float = 0.1) -> DataFrame:
    """(word, docs, courts) of capitalised words that are hardly ever written small."""
    names = words_.where("title").groupBy("word").agg(F.count("*").alias("docs"), F.count_distinct("court").alias("courts")).where((F.col("docs") >= min_docs) & (F.col("courts") >= min_courts))
    small = words_.where("lower").groupBy(F.col("word").alias("_low")).agg(F.count("*").alias("_small"))
    out = names.join(small, F.lower("word") == F.col("_low"), "left").where(F.coalesce("_small", F.lit(0)) <= lower_share * F.col("docs")).select("word", "docs", "courts")
    return out if known is None else out.join(known.select(F.col("form").alias("word")).distinct(), "word", "left_anti")


def stop_words(words_: DataFrame, limit: int = 300) -> DataFrame:
    """(word, n): the most frequent words in lower case; of equally frequent ones the first in order."""
    return words_.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def noise_report(issues: DataFrame, files: DataFrame, key: str = "file_id", flag_share: float = FLAG_SHARE) -> DataFrame:
    """(rule, issues, docs, share, flagged, examples) of every engine and rule, up to three distinct fragments each.

    ``issues`` has the key, engine, rule_id and fragment. Counts combine before the exchange; documents of a rule
    are counted from its distinct (rule, document) pairs.
    """
    total = files.select(key).distinct().agg(F.count("*").alias("total"))
    rule = F.concat_ws(":", "engine", "rule_id").alias("rule")
    per_doc = issues.groupBy(rule, key).agg(F.count("*").alias("n"))
    rows = per_doc.groupBy("rule").agg(F.sum("n").alias("issues"), F.count(key).alias("docs"))
    fragments = issues.where("fragment is not null").groupBy(rule, "fragment").agg(F.lit(1).alias("_one"))
    three = fragments.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("fragment"))).where("_r <= 3").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("fragment")), "; ").alias("examples"))
    share = F.col("docs") / F.col("total")
    return rows.join(F.broadcast(total)).join(three, "rule", "left").select("rule", "issues", "docs", F.round(share, 6).alias("share"), (share > flag_share).alias("flagged"), F.coalesce("examples", F.lit("")).alias("examples"))


def spelling_fragments(issues: DataFrame, limit: int = 40) -> DataFrame:
    """(fragment, n, capital): the fragments with most spelling issues; ties by the fragment."""
    spelling = issues.where("category = 'spelling' and fragment is not null")
    return spelling.groupBy("fragment").agg(F.count("*").alias("n")).withColumn("capital", F.col("fragment").rlike(r"(?U)^\p{Lu}")).orderBy(F.desc("n"), "fragment").limit(limit)


def known_by_parts(words_: DataFrame, forms: DataFrame) -> DataFrame:
    """Words of several hyphenated parts all of which are dictionary forms: every part must find its form."""
    parts = F.filter(F.split("word", "-"), lambda p: p != "")
    pieces = checkpointed(words_.select("word").distinct().where(F.size(parts) > 1).select("word", F.explode(parts).alias("form")))
    known = sized_join(pieces, forms.select("form", F.lit(True).alias("_known")).distinct(), ["form"], "left")
    return known.groupBy("word").agg(F.min(F.coalesce("_known", F.lit(False))).alias("all_known")).where("all_known").select("word")
