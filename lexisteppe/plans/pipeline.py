"""The whole check: languages, engines, rules, filters, overlaps, order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lang import with_languages
from ..operators.external import Checker, external_issues, refined_spelling
from ..operators.issues import Settings, fragment, in_order, wanted, without_accepted, without_overlaps
from ..operators.onepass import COLUMNS, ListSet, kernel
from ..operators.names import official_issues, variant_issues
from ..operators.rules import Rule, default_rules, rule_issues, soglasno_forms
from ..operators.spell import Words, spelling_issues, suggestions, word_tokens
from ..runtime import MOST_BYTES, checkpointed, ship_package, sized_join, small_set, spread


@dataclass
class Resources:
    """What a check reads besides the documents. Everything is optional.

    ``morphology`` is (form, lemma, is_name), and with (genitive, dative) it serves ``legal.soglasno``.
    """

    ru: Words | None = None
    kk: Words | None = None
    official_ru: list[str] = field(default_factory=list)
    official_kk: list[str] = field(default_factory=list)
    user_rules: list[Rule] = field(default_factory=list)
    user_words: DataFrame | None = None
    phrases: list[str] = field(default_factory=list)
    morphology: DataFrame | None = None
    checker: Checker | None = None


def _sets(lists: Words, most_bytes: int) -> ListSet | None:
    """The lists of a language as sets, if each of them is small."""
    tables = {"forms": lists.forms, "lexicon": lists.lexicon, "names": lists.names, "user_words": lists.user_words, "other": lists.other}
    lowered = lambda name, t: t.select(F.lower(t.columns[0])) if t is not None and name in ("lexicon", "user_words") else t if t is None else t.select("form")
    found: dict[str, frozenset[str]] = {}
    for name, table in tables.items():
        values = small_set(lowered(name, table), most_bytes)
        if values is None:
            return None
        found[name] = values
    return ListSet(lists.engine, foreign_message=lists.foreign_message, **found)


def _one_pass(paragraphs: DataFrame, resources: Resources, settings: Settings, most_bytes: int) -> DataFrame | None:
    """The check in one pass over whole documents, if nothing but lists is given and these are small enough for the workers."""
    r, words = resources, [w for w in (resources.ru, resources.kk) if w is not None]
    if r.official_ru or r.official_kk or r.user_rules or r.user_words is not None or r.phrases or r.morphology is not None or r.checker or any(w.phrases for w in words):
        return None
    spark = paragraphs.sparkSession
    sets = {k: _sets(w, most_bytes) for k, w in (("ru", r.ru), ("kk", r.kk)) if w is not None}
    if None in sets.values():
        return None
    ship_package(spark)
    shared = spark.sparkContext.broadcast((sets.get("ru"), sets.get("kk")))
    ordered = spread(paragraphs.select("doc_id", "para", "text"), "doc_id").sortWithinPartitions("doc_id", "para")
    keys = ", ".join(f"{c} {paragraphs.schema[c].dataType.simpleString()}" for c in ("doc_id", "para"))
    found = ordered.mapInArrow(kernel(settings, lambda: shared.value, ("doc_id", "para")), f"{keys}, {COLUMNS}")
    if not (r.ru and r.kk):
        return found.drop("_lists")
    found = checkpointed(found)
    near = []
    for k, lists in (("ru", r.ru), ("kk", r.kk)):
        unknown = found.where(F.col("_lists") == k).select(F.col("fragment").alias("word")).distinct()
        near.append(suggestions(unknown, lists.forms).select(F.lit(k).alias("_lists"), F.col("word").alias("fragment"), F.col("suggestions").alias("_near")))
    hinted = sized_join(found, near[0].unionByName(near[1]), ["_lists", "fragment"], "left")
    return hinted.withColumn("suggestions", F.coalesce("_near", "suggestions")).select(*[c for c in found.columns if c != "_lists"])


def check(paragraphs: DataFrame, resources: Resources | None = None, settings: Settings | None = None, most_bytes: int = MOST_BYTES // 8) -> DataFrame:
    """Issues of paragraphs (doc_id, para, text), numbered in each document, with the fragment and the language.

    Disabled rules are not planned at all. Where only word lists are given, each of at most ``most_bytes``, documents
    pass through :mod:`onepass` once. Else the enriched paragraphs are written once; every engine reads that table.
    """
    resources, settings = resources or Resources(), settings or Settings()
    quick = _one_pass(paragraphs, resources, settings, most_bytes)
    if quick is not None:
        return quick
    known = resources.ru.forms if resources.ru else None
    texts = checkpointed(with_languages(spread(paragraphs.select("doc_id", "para", "text"), "doc_id"), "doc_id", settings.language, known))
    off = tuple(settings.disabled_rules)
    dative = {} if "legal.soglasno" in off else soglasno_forms(texts, resources.morphology)
    parts = [rule_issues(texts, default_rules(settings.sentence_words_limit, dative, tuple(resources.user_rules)), disabled=off)]
    if "names.variants" not in off:
        parts.append(variant_issues(texts, morphology=resources.morphology))
    if (resources.official_ru or resources.official_kk) and "names.official" not in off:
        parts.append(official_issues(texts, resources.official_ru, resources.official_kk))
    if resources.ru and resources.kk:
        parts.append(spelling_issues(texts, resources.ru, resources.kk, russian_by_lists=resources.checker is None))
    if resources.checker:
        russian = texts.where(F.col("lang") == "ru")
        found = external_issues(russian, resources.checker)
        parts.append(refined_spelling(checkpointed(found), word_tokens(russian), resources.ru) if resources.ru else found)
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    issues = checkpointed(wanted(issues, settings)).join(texts.select("doc_id", "para", "text", "lang"), ["doc_id", "para"])
    if resources.user_words is not None or resources.phrases:
        words = resources.user_words if resources.user_words is not None else issues.sparkSession.createDataFrame([], "entry string")
        issues = without_accepted(issues, words, resources.phrases)
    shown = issues.withColumn("fragment", fragment(F.col("text"), F.col("start_pos"), F.col("end_pos"))).drop("text")
    return in_order(without_overlaps(shown))
