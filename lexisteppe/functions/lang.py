"""Language of paragraphs by letters and frequent words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixed import KK_LOWER, KK_UPPER, KK_WORDS, RU_WORDS
from .segment import words

KK_LETTER = f"[{KK_LOWER}{KK_UPPER}]"


def has_kk_letters(word: Column) -> Column:
    return word.rlike(KK_LETTER)


def kk_letters(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, KK_LOWER + KK_UPPER, ""))


def lowered_words(text: Column) -> Column:
    return F.transform(words(text), F.lower)


def score(text: Column, lowered: Column | None = None) -> Column:
    """(kk, ru): three for a Kazakh letter, two for a frequent word. ``lowered``: the text's words, if a column has them."""
    lowered = lowered_words(text) if lowered is None else lowered
    kk = F.size(F.filter(lowered, lambda w: w.isin(*KK_WORDS)))
    ru = F.size(F.filter(lowered, lambda w: w.isin(*RU_WORDS) & ~w.isin(*KK_WORDS)))
    return F.struct((3 * kk_letters(text) + 2 * kk).alias("kk"), (2 * ru).alias("ru"))


def evidence(text: Column, lowered: Column | None = None) -> Column:
    """(kk, ru): words with Kazakh letters or of the Kazakh list, and words of the Russian list."""
    lowered = lowered_words(text) if lowered is None else lowered
    is_kk = lambda w: w.rlike(KK_LETTER) | w.isin(*KK_WORDS)
    kk = F.size(F.filter(lowered, is_kk))
    ru = F.size(F.filter(lowered, lambda w: ~is_kk(w) & w.isin(*RU_WORDS)))
    return F.struct(kk.alias("kk"), ru.alias("ru"))


def own_language(kk: Column, ru: Column, kk_words: Column, ru_words: Column) -> Column:
    """ru, kk, mixed, or null where nothing speaks for a language."""
    return (
        F.when((kk == 0) & (ru == 0), F.lit(None))
        .when((kk_words >= 3) & (ru_words >= 3), "mixed")
        .when(ru_words >= 2 * F.greatest(kk_words, F.lit(1)), "ru")
        .when(kk_words >= 2 * F.greatest(ru_words, F.lit(1)), "kk")
        .when(kk > ru, "kk")
        .otherwise("ru")
    )


def detect(text: Column, ru_known_words: Column | None = None) -> Column:
    """A paragraph's own language. ``ru_known_words``: a count of dictionary words in place of the Russian list's."""
    e = evidence(text)
    return own_language(score(text)["kk"], score(text)["ru"], e["kk"], e["ru"] if ru_known_words is None else ru_known_words)


def _scored(paragraphs: DataFrame, text: Column) -> DataFrame:
    """Scores over one array of words, which is found once for each paragraph."""
    low = paragraphs.withColumn("_low", lowered_words(text))
    return low.withColumn("_score", score(text, F.col("_low"))).withColumn("_evidence", evidence(text, F.col("_low"))).drop("_low")


def with_languages(paragraphs: DataFrame, key: str = "doc_id", mode: str = "auto", ru_known: DataFrame | None = None) -> DataFrame:
    """Paragraphs (key, para, text, ...) with a column ``lang``.

    A paragraph that speaks for no language takes the last one before it that is not mixed, Russian at the start.
    ``mode`` ru or kk forces a language. ``ru_known`` is a table (form) of a Russian dictionary. Null texts speak
    for no language.
    """
    if mode in ("ru", "kk"):
        return paragraphs.withColumn("lang", F.lit(mode))
    text = F.coalesce(F.col("text"), F.lit(""))
    if ru_known is None:
        own = _scored(paragraphs, text)
        own = own.withColumn("_own", own_language(F.col("_score.kk"), F.col("_score.ru"), F.col("_evidence.kk"), F.col("_evidence.ru")))
    else:
        from ..runtime import sized_join

        candidate = F.filter(words(text), lambda w: ~w.rlike(KK_LETTER) & ~F.lower(w).isin(*KK_WORDS) & (F.length(w) >= 3))
        exploded = paragraphs.select(key, "para", F.explode(candidate).alias("form"))
        known = sized_join(exploded, ru_known.select("form").distinct(), ["form"], "left_semi").groupBy(key, "para").agg(F.count("*").alias("_known"))
        own = _scored(paragraphs.join(known, [key, "para"], "left"), text)
        own = own.withColumn("_own", own_language(F.col("_score.kk"), F.col("_score.ru"), F.col("_evidence.kk"), F.coalesce("_known", F.lit(0))))
    before = Window.partitionBy(key).orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("_own") != "mixed", F.col("_own")), ignorenulls=True).over(before)
    return own.withColumn("lang", F.coalesce("_own", carried, F.lit("ru"))).drop("_score", "_evidence", "_own", "_known")
