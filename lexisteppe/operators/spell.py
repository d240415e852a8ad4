"""Spelling by word lists: membership is a join of distinct words, policy is a column expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lang import KK_LETTER
from ..functions.segment import sentences, tokens
from ..runtime import checkpointed, sized_join
from .issues import covered
from .names import title_case

STAGES = {"mixed": 0, "ru": 1, "ru_names": 2, "kk": 3}


@dataclass
class Words:
    """The lists of one language: ``forms`` (form) is the dictionary, ``lexicon`` (form in lower case), ``names`` (form)."""

    engine: str
    forms: DataFrame
    lexicon: DataFrame | None = None
    names: DataFrame | None = None
    user_words: DataFrame | None = None
    phrases: list[str] = field(default_factory=list)
    other: DataFrame | None = None
    foreign_message: str = "A word of the other language"


def abbreviation_like(word: Column) -> Column:
    """Two capitals or more, one small letter at most, up to seven characters."""
    count = lambda cls: F.length(F.regexp_replace(word, rf"(?U)[^\p{{{cls}}}]", ""))
    return (count("Lu") >= 2) & (count("Ll") <= 1) & (F.length(word) <= 7)


def unchecked(word: Column) -> Column:
    """Words that are never checked: short ones, with digits or Latin letters, abbreviations."""
    return (F.length(word) < 2) | word.rlike(r"(?U)\d") | abbreviation_like(word) | word.rlike("[A-Za-z]")


def inside_quotes(text: Column, start: Column) -> Column:
    before = F.substring(text, F.lit(1), start)
    count = lambda c: F.length(before) - F.length(F.replace(before, F.lit(c), F.lit("")))
    return (count("«") > count("»")) | (count('"') % 2 == 1)


def accepted_words(words: DataFrame, lists: Words) -> DataFrame:
    """(word, accepted, foreign) of distinct words: listed somewhere, or a compound of listed parts.

    A compound counts when every one of its parts is in the dictionary, or in lower case in the lexicon.
    """
    distinct = words.select("word").where("word is not null").distinct()
    parts = F.filter(F.split("word", "[-'’]"), lambda p: p != "")
    pieces = distinct.select("word", F.explode(F.when(F.size(parts) > 1, F.array_union(parts, F.array("word"))).otherwise(F.array("word"))).alias("part"))
    flag = lambda df, column: df.select(F.col("form").alias("_key")).where("form is not null").distinct().withColumn(column, F.lit(True))
    marked = sized_join(pieces.withColumn("_key", F.col("part")), flag(lists.forms, "_form"), ["_key"], "left").drop("_key")
    for column, table in (("_lexicon", lists.lexicon), ("_user", lists.user_words)):
        if table is not None:
            table = table.select(F.lower(table.columns[0]).alias("form"))
            marked = sized_join(marked.withColumn("_key", F.lower("part")), flag(table, column), ["_key"], "left").drop("_key")
        else:
            marked = marked.withColumn(column, F.lit(None).cast("boolean"))
    for column, table in (("_name", lists.names), ("_other", lists.other)):
        if table is not None:
            marked = sized_join(marked.withColumn("_key", F.col("part")), flag(table, column), ["_key"], "left").drop("_key")
        else:
            marked = marked.withColumn(column, F.lit(None).cast("boolean"))
    listed = F.coalesce("_form", F.lit(False)) | F.coalesce("_lexicon", F.lit(False))
    whole = F.col("part") == F.col("word")
    itself = F.max(whole & (listed | F.coalesce("_user", F.lit(False)) | F.coalesce("_name", F.lit(False))))
    all_parts = F.min(F.when(~whole, listed))
    return marked.groupBy("word").agg(F.coalesce(itself | F.coalesce(all_parts, F.lit(False)), F.lit(False)).alias("accepted"), F.coalesce(F.max(whole & F.coalesce("_other", F.lit(False))), F.lit(False)).alias("foreign"))


def word_tokens(paragraphs: DataFrame, keys: tuple[str, str] = ("doc_id", "para"), phrases: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lang, start_pos, end_pos, word, starts, quoted, covered) of every word.

    ``starts``: it begins a sentence by the Russian splitter; ``quoted``: it stands inside quotes; ``covered``: a
    user's phrase lies over it. The text itself is not carried on.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = paragraphs.select(*keys, "lang", text.alias("text"), F.filter(tokens(text), lambda t: t["kind"] == "word").alias("_t"), F.transform(sentences(text, "ru"), lambda s: s["start"]).alias("_s"), text.rlike('[«"]').alias("_q"))
    each = base.select(*keys, "lang", "text", "_s", "_q", F.explode("_t").alias("t"))
    start, end = F.col("t.start"), F.col("t.end")
    return each.select(
        *keys, "lang", start.alias("start_pos"), end.alias("end_pos"), F.col("t.text").alias("word"), F.array_contains("_s", start).alias("starts"),
        F.when(F.col("_q"), inside_quotes(F.col("text"), start)).otherwise(False).alias("quoted"), (covered(F.col("text"), start, end, list(phrases)) if phrases else F.lit(False)).alias("covered"),
    )


def check(words: DataFrame, lists: Words, stage: str, keys: tuple[str, str] = ("doc_id", "para"), foreign_hints: bool = True, repeated_names: bool = False, marks: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Issues of the words (from :func:`word_tokens`) that no list accepts.

    In this order: unchecked or accepted words and words within a user's phrase are none; words of the other
    language get a hint outside quotes; capitalised words inside a sentence get a hint, none if ``repeated_names``
    and the same form stands twice in the document; all others are errors. ``marks`` are the words' marks by
    :func:`accepted_words`, if they are known already; ``hints`` (word, suggestions) are given with errors.
    """
    if repeated_names:
        words = words.withColumn("_n", F.count("*").over(Window.partitionBy(keys[0], "word")))
    else:
        words = words.withColumn("_n", F.lit(1))
    candidates = words.where(~unchecked(F.col("word")) & ~F.col("covered"))
    joined = sized_join(candidates, accepted_words(candidates, lists) if marks is None else marks, ["word"]).where(~F.col("accepted"))
    name = title_case(F.col("word")) & ~F.col("starts")
    kind = F.when(F.col("foreign"), F.when(F.lit(foreign_hints) & ~F.col("quoted"), "foreign")).when(name, F.when(F.col("_n") < 2, "name")).otherwise("unknown")
    kinds = joined.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    kinds = sized_join(kinds, hints, ["word"], "left") if hints is not None else kinds.withColumn("suggestions", F.lit(None).cast("array<string>"))
    shown = F.when(F.col("_kind") == "unknown", F.col("suggestions"))
    style = F.col("_kind") == "foreign"
    message = F.when(style, lists.foreign_message).when(F.col("_kind") == "name", "An unknown capitalised word: is the name right?").otherwise("Perhaps a spelling error")
    return kinds.select(
        *keys, "start_pos", "end_pos", F.when(style, "style").otherwise("spelling").alias("category"), F.when(F.col("_kind") == "unknown", "error").otherwise("hint").alias("level"),
        F.concat(F.lit(f"{lists.engine}:"), "_kind").alias("rule_id"), F.lit(lists.engine).alias("engine"), message.alias("message"), F.coalesce(shown, F.array().cast("array<string>")).alias("suggestions"),
        F.struct(F.lit(STAGES[stage]).alias("stage"), F.lit(0).alias("rule"), F.col("start_pos").alias("pos")).alias("seq"),
    )


def spelling_issues(paragraphs: DataFrame, ru: Words, kk: Words, keys: tuple[str, str] = ("doc_id", "para"), russian_by_lists: bool = True, suggest: int = 5) -> DataFrame:
    """Every paragraph's words to the lists of its language.

    Russian paragraphs: all words to the Russian lists (unless an external checker sees them, then
    ``russian_by_lists`` is false), and words with Kazakh letters to the Kazakh ones; Kazakh paragraphs to the Kazakh lists; in mixed ones words with Kazakh letters to the Kazakh lists without hints, the
    rest to the Russian ones unless the Kazakh dictionary knows them. The words are found once and written; each
    list is looked up once for every distinct word. Errors carry up to ``suggest`` forms of the dictionary that are near,
    found once for every distinct unknown word (0: none).
    """
    words = checkpointed(word_tokens(paragraphs, keys, tuple({*ru.phrases, *kk.phrases})))
    with_kk = F.col("word").rlike(KK_LETTER)
    candidates = words.where(~unchecked(F.col("word")))
    marks_ru = checkpointed(accepted_words(candidates.where("lang <> 'kk'"), ru))
    marks_kk = checkpointed(accepted_words(candidates.where(with_kk | (F.col("lang") == "kk")), kk))
    near = lambda marks, lists: checkpointed(suggestions(marks.where(~F.col("accepted") & ~F.col("foreign")), lists.forms, suggest)) if suggest else None
    hints_ru, hints_kk = near(marks_ru, ru), near(marks_kk, kk)
    russian, kazakh, mixed = (words.where(F.col("lang") == lang) for lang in ("ru", "kk", "mixed"))
    rest = mixed.where(~with_kk).join(kk.forms.select(F.col("form").alias("word")).distinct(), "word", "left_anti").select(words.columns)
    parts = [
        check(mixed.where(with_kk), kk, "mixed", keys, foreign_hints=False, marks=marks_kk, hints=hints_kk),
        check(rest, ru, "mixed", keys, marks=marks_ru, hints=hints_ru),
        *([check(russian, ru, "ru", keys, repeated_names=True, marks=marks_ru, hints=hints_ru)] if russian_by_lists else []),
        check(russian.where(with_kk), kk, "ru_names", keys, marks=marks_kk, hints=hints_kk),
        check(kazakh, kk, "kk", keys, repeated_names=True, marks=marks_kk, hints=hints_kk),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def suggestions(words: DataFrame, forms: DataFrame, limit: int = 5) -> DataFrame:
    """(word, suggestions): up to ``limit`` dictionary forms within one slip of each distinct word, nearest and then first in order.

    Words and forms meet by equal deletion keys.
    """
    drop = lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
    left = words.select("word").where("length(word) > 0").distinct().withColumn("key", F.explode(drop(F.lower("word"))))
    right = forms.select("form").where("length(form) > 0").distinct().withColumn("key", F.explode(drop(F.lower("form"))))
    distance = F.levenshtein(F.lower("word"), F.lower("form"))
    met = left.join(right, "key").select("word", "form").distinct().withColumn("d", distance)
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("d", "form"))).where(F.col("r") <= limit)
    return ranked.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "form"))), lambda x: x["form"]).alias("suggestions"))
