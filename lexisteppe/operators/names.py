"""Variant spellings of names inside one document, and names of bodies against an official list."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.match import alternatives
from ..functions.segment import sentences_by_language, tokens
from ..runtime import arrow_map, checkpointed

VARIANTS_STAGE, OFFICIAL_ORDER = 8, 1_000
TITLE_CASE = r"(?U)^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"


def title_case(word: Column) -> Column:
    """A capital, then letters of which none is a capital and one at least is small."""
    return word.rlike(TITLE_CASE)


def stripped(stem: Column, endings: list[str], rounds: int = 6, least: int = 4) -> Column:
    """A stem without its endings, the longest first, again and again while ``least`` letters stay."""
    pattern = rf"^(.{{{least},}}?){alternatives(endings)}$"
    for _ in range(rounds):
        stem = F.regexp_replace(stem, pattern, "$1")
    return stem


def name_lemma(word: Column, lang: Column) -> Column:
    """The stem of a name without case endings: Kazakh affixes, then Russian endings."""
    low = F.lower(word)
    return stripped(F.when(lang == "kk", stripped(low, X.NAME_AFFIXES_KK)).otherwise(low), X.NAME_ENDINGS_RU)


def is_patronymic(word: Column) -> Column:
    return F.lower(word).rlike(f"{alternatives(X.PATRONYMIC_ENDINGS)}$")


def name_occurrences(paragraphs: DataFrame, keys: tuple[str, str] = ("doc_id", "para"), morphology: DataFrame | None = None) -> DataFrame:
    """(doc, para, start_pos, end_pos, form, lemma) of capitalised words inside sentences.

    ``morphology`` (form in lower case, lemma, is_name) gives lemmas of known words; known words that are no names
    are left out of Russian and mixed paragraphs.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # A name inside a sentence is a capital behind some character and four letters more.
    may = paragraphs.where(text.rlike(rf"(?Us).\p{{Lu}}(?:[{X.LETTERS}]|[-'’]){{4,}}"))
    base = may.withColumn("_s", sentences_by_language(text, F.col("lang"))).withColumn("_t", F.filter(tokens(text), lambda t: (t["kind"] == "word") & (F.length(t["text"]) >= 5)))
    found = base.select(*keys, "lang", "_s", F.explode("_t").alias("t")).where(title_case(F.col("t.text")) & ~is_patronymic(F.col("t.text")))
    inner = ~F.exists("_s", lambda s: s["start"] == F.col("t.start"))
    out = found.where(inner).select(*keys, "lang", F.col("t.start").alias("start_pos"), F.col("t.end").alias("end_pos"), F.col("t.text").alias("form"))
    if morphology is None:
        return out.withColumn("lemma", name_lemma(F.col("form"), F.col("lang"))).drop("lang")
    known = morphology.select(F.col("form").alias("_low"), F.col("lemma").alias("_lemma"), "is_name").dropDuplicates(["_low"])
    joined = out.withColumn("_low", F.when(F.col("lang") != "kk", F.lower("form"))).join(known, "_low", "left").where(F.coalesce("is_name", F.lit(True)))
    return joined.withColumn("lemma", F.coalesce("_lemma", name_lemma(F.col("form"), F.col("lang")))).drop("lang", "_low", "_lemma", "is_name")


def _deletion_keys(lemma: Column) -> Column:
    """The lemma with up to one letter left out (two of long lemmas): lemmas within that distance share one."""
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.concat(F.array(lemma), drop(lemma))
    return F.array_distinct(F.when(F.length(lemma) > 9, F.concat(once, F.flatten(F.transform(drop(lemma), drop)))).otherwise(once))


def variant_pairs(occurrences: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, rare, rare_n, frequent, frequent_n, frequent_form): each rarer lemma and the most frequent near one.

    Near: one slip, two for lemmas of more than nine letters, and strictly more frequent; of several the most
    frequent, then the first in the document. Candidates meet by equal deletion keys, never all pairs.
    """
    first = F.min(F.struct("para", "start_pos"))
    forms = occurrences.groupBy(doc, "form").agg(F.count("*").alias("n"), first.alias("at"), F.min_by("lemma", F.struct("para", "start_pos")).alias("lemma"))
    forms = checkpointed(forms)
    best = F.max_by("form", F.struct(F.col("n"), -F.col("at.para"), -F.col("at.start_pos")))
    lemmas = forms.groupBy(doc, "lemma").agg(F.sum("n").alias("n"), F.min("at").alias("at"), best.alias("form"))
    keyed = lemmas.withColumn("key", F.explode(_deletion_keys(F.col("lemma"))))
    # A rare lemma of up to nine letters may meet a longer one by its own single deletions only.
    rare = keyed.select(doc, "key", F.col("lemma").alias("rare"), F.col("n").alias("rare_n"))
    frequent = keyed.select(doc, "key", F.col("lemma").alias("frequent"), F.col("n").alias("frequent_n"), F.col("at").alias("frequent_at"), F.col("form").alias("frequent_form"))
    limit = F.when(F.length("rare") <= 9, 1).otherwise(2)
    met = rare.join(frequent, [doc, "key"]).where((F.col("frequent_n") > F.col("rare_n")) & (F.levenshtein("rare", "frequent") <= limit))
    top = F.min_by(F.struct("frequent", "frequent_n", "frequent_form"), F.struct(-F.col("frequent_n"), "frequent_at"))
    return met.groupBy(doc, "rare", "rare_n").agg(top.alias("x")).select(doc, "rare", "rare_n", "x.*")


def variant_issues(paragraphs: DataFrame, keys: tuple[str, str] = ("doc_id", "para"), morphology: DataFrame | None = None) -> DataFrame:
    """Issues of rule names.variants: every occurrence of a rarer spelling of a name in its document."""
    found = checkpointed(name_occurrences(paragraphs, keys, morphology))
    lemma_of = found.groupBy(keys[0], "form").agg(F.min_by("lemma", F.struct("para", "start_pos")).alias("rare"))
    pairs = variant_pairs(found, keys[0])
    marked = found.drop("lemma").join(lemma_of, [keys[0], "form"]).join(pairs, [keys[0], "rare"])
    same = F.length("form") == F.length("frequent_form")
    message = F.format_string("Two spellings of one name: %s (%d) and %s (%d)", "form", "rare_n", "frequent_form", "frequent_n")
    order = F.row_number().over(Window.partitionBy(keys[0]).orderBy("para", "start_pos")).cast("int")
    return marked.select(
        *keys, "start_pos", "end_pos", F.lit("style").alias("category"), F.lit("warning").alias("level"), F.lit("names.variants").alias("rule_id"), F.lit("rules").alias("engine"), message.alias("message"),
        F.when(same, F.array("frequent_form")).otherwise(F.array().cast("array<string>")).alias("suggestions"),
        F.struct(F.lit(VARIANTS_STAGE).alias("stage"), F.lit(0).alias("rule"), order.alias("pos")).alias("seq"),
    )


_WORD = regex.compile(rf"[{X.LETTERS}]+(?:[-'’][{X.LETTERS}]+)*|\d+(?:[.,]\d+)*(?:-(?:\d+|[{X.LETTERS}]+))*")


def _spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text) if not m.group()[0].isdigit()]


class Official:
    """Official names by the beginnings of their first and last word and their number of words, in list order."""

    def __init__(self, names: list[str]) -> None:
        self.by_ends: dict[tuple[str, str, int], list[tuple[int, str, list[str]]]] = {}
        for order, name in enumerate(names):
            words = [w for _, _, w in _spans(name)]
            if len(words) > 1:
                self.by_ends.setdefault((words[0][:4].lower(), words[-1][:4].lower(), len(words)), []).append((order, name, words))
        self.sizes = sorted({k[2] for k in self.by_ends})
        self.firsts = {k[0] for k in self.by_ends}

    def check(self, text: str) -> list[tuple[int, int, int, str, bool]]:
        """(order, start, end, official name, only the case differs) of each deviating name, an earlier name's span taken first."""
        words = _spans(text)
        met = []
        for i, (_, _, w) in enumerate(words):
            if w[:4].lower() not in self.firsts:
                continue
            for n in self.sizes:
                if i + n <= len(words):
                    for order, name, canon in self.by_ends.get((w[:4].lower(), words[i + n - 1][2][:4].lower(), n), ()):
                        met.append((order, i, name, canon))
        out, taken = [], []
        for order, i, name, canon in sorted(met, key=lambda m: (m[0], m[1])):
            window = words[i : i + len(canon)]
            start, end = window[0][0], window[-1][1]
            if any(s <= start < e for s, e in taken):
                continue
            pairs = [(w[2], c) for w, c in zip(window, canon, strict=True)]
            cut = [(w[: min(4, len(c))], c[:4]) for w, c in pairs]
            if all(a == b for a, b in cut):
                continue
            differing = [k for k, (a, b) in enumerate(cut) if a.lower() != b.lower()]
            near = min((difflib.SequenceMatcher(None, w.lower(), c.lower()).ratio() for w, c in pairs if w[:4].lower() != c[:4].lower()), default=1.0)
            if not differing or len(differing) == 1 and near >= 0.75:
                out.append((order, start, end, name, not differing))
                taken.append((start, end))
        return out


def official_issues(paragraphs: DataFrame, official_ru: list[str], official_kk: list[str], keys: tuple[str, str] = ("doc_id", "para")) -> DataFrame:
    """Issues of rule names.official; the similarity of words has no native form, so paragraphs pass through Arrow once."""
    types = {f.name: f.dataType.simpleString() for f in paragraphs.schema.fields}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {"kk": Official(official_kk), "ru": Official(official_ru)}
        for b in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for i, (text, lang) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for k, (_, start, end, name, case) in enumerate(known["kk" if lang == "kk" else "ru"].check(text or "")):
                    rows.append(i)
                    out.append((start, end, name, case, k))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            picked = [b.column(j).take(pa.array(rows, pa.int32())) for j in (0, 1)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([*picked, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[*keys, "start_pos", "end_pos", "name", "case_only", "k"])

    schema = f"{keys[0]} {types[keys[0]]}, {keys[1]} {types[keys[1]]}, start_pos int, end_pos int, name string, case_only boolean, k int"
    found = arrow_map(paragraphs.select(*keys, "text", "lang"), kernel, schema)
    message = F.when(F.col("case_only"), F.concat(F.lit("The official case is "), "name")).otherwise(F.concat(F.lit("The official name is "), "name"))
    return found.select(
        *keys, "start_pos", "end_pos", F.lit("style").alias("category"), F.lit("hint").alias("level"), F.lit("names.official").alias("rule_id"), F.lit("rules").alias("engine"),
        message.alias("message"), F.array("name").alias("suggestions"), F.struct(F.lit(9).alias("stage"), F.lit(OFFICIAL_ORDER).alias("rule"), F.col("k").alias("pos")).alias("seq"),
    )


def near_repeats(paragraphs: DataFrame, stop_words: DataFrame, keys: tuple[str, str] = ("doc_id", "para"), lemmas: DataFrame | None = None) -> DataFrame:
    """Rule rep.near (off by default): a word of more than five letters that stands in the sentence before as well.

    ``lemmas`` (form in lower case, lemma) is optional; capitalised words inside a sentence are taken for names.
    The join is by equality of document, paragraph, lemma and the sentence's number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = paragraphs.withColumn("_s", sentences_by_language(text, F.col("lang"))).withColumn("_t", F.filter(tokens(text), lambda t: (t["kind"] == "word") & (F.length(t["text"]) > 5)))
    each = base.select(*keys, "_s", F.explode("_t").alias("t")).withColumn("sent", F.expr("aggregate(_s, 0, (a, s) -> a + if(s.start <= t.start, 1, 0))"))
    inner_name = F.col("t.text").rlike(r"(?U)^\p{Lu}") & ~F.exists("_s", lambda s: s["start"] == F.col("t.start"))
    words = each.where(~inner_name).select(*keys, "sent", F.col("t.start").alias("start_pos"), F.col("t.end").alias("end_pos"), F.col("t.text").alias("form"), F.lower("t.text").alias("low"))
    if lemmas is not None:
        words = words.join(lemmas.select(F.col("form").alias("low"), "lemma").dropDuplicates(["low"]), "low", "left").withColumn("lemma", F.coalesce("lemma", "low"))
    else:
        words = words.withColumn("lemma", F.col("low"))
    stops = stop_words.select(F.col("word").alias("lemma")).distinct()
    kept = words.join(stops, "lemma", "left_anti").join(stops.withColumnRenamed("lemma", "low"), "low", "left_anti")
    firsts = checkpointed(kept.groupBy(*keys, "sent", "lemma").agg(F.min(F.struct("start_pos", "end_pos", "form")).alias("x")))
    before = firsts.select(*keys, (F.col("sent") + 1).alias("sent"), "lemma")
    return firsts.join(before, [*keys, "sent", "lemma"], "left_semi").select(*keys, "x.start_pos", "x.end_pos", F.col("x.form").alias("fragment"), F.lit("rep.near").alias("rule_id"))
