"""Rules as row-generating expressions: one projection over the paragraphs for all of them, no shuffle.

A rule maps a paragraph to an array of issues. All arrays are concatenated and exploded once, so the paragraphs
are scanned once, however many rules run. Rules that look at a whole document are in :mod:`names`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.match import alternatives, expand, finditer
from ..functions.segment import ALL_LETTERS, TOKEN_TYPE, sentences_by_language, tokens

SUGGESTIONS = "array<string>"
ISSUE_FIELDS = ("start_pos", "end_pos", "category", "level", "rule_id", "engine", "message", "suggestions", "seq")
ISSUE_TYPE = (
    "array<struct<start_pos:int,end_pos:int,category:string,level:string,rule_id:string,engine:string,message:string,"
    "suggestions:array<string>,seq:struct<stage:int,rule:int,pos:int>>>"
)
RULE_STAGE = 9


@dataclass(frozen=True)
class Rule:
    """A rule's constants and what it finds: ``spans`` gives an array of (start, end, suggestions, message).

    ``may`` is a quick condition on the text without which a rule over tokens finds nothing; only where some such
    condition holds are a paragraph's tokens and sentences found at all. ``pattern`` (with its replacement) and ``limit`` tell
    :mod:`onepass` the same.
    """

    id: str
    lang: str
    category: str
    level: str
    message: str
    spans: Callable[[], Column] = field(repr=False)
    engine: str = "rules"
    may: Callable[[], Column] | None = field(default=None, repr=False)
    pattern: tuple[str, str | None] | None = field(default=None, repr=False)
    limit: int = 0


def _span(start: Column, end: Column, suggestions: Column, message: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), suggestions.cast(SUGGESTIONS).alias("suggestions"), message.alias("message"))


NONE = F.array


def pattern_rule(
    id: str, lang: str, category: str, level: str, message: str, pattern: str, replacement: str | None = None, groups: int = 0,
    condition: Callable[[Column, Column], Column] | None = None, ignore_case: bool = False, engine: str = "rules",
) -> Rule:
    """A rule by regular expression, with a replacement template and a condition on the match and the text.

    Matches whose replacement changes nothing are no issues.
    """

    whole = ("(?iuU)" if ignore_case else "(?U)") + pattern

    def spans() -> Column:
        text = F.col("text")
        found = finditer(text, whole, groups)
        if condition is not None:
            found = F.filter(found, lambda m: condition(m, text))
        if replacement is None:
            return F.transform(found, lambda m: _span(m["start"], m["end"], F.array(), F.lit(message)))
        found = F.filter(found, lambda m: expand(replacement, m) != m["frag"])
        return F.transform(found, lambda m: _span(m["start"], m["end"], F.array(expand(replacement, m)), F.lit(message)))

    return Rule(id, lang, category, level, message, spans, engine, pattern=(whole, replacement))


def _typo(id: str, message: str, pattern: str, replacement: str, groups: int = 0) -> Rule:
    return pattern_rule(id, "any", "typography", "warning", message, pattern, replacement, groups)


TYPOGRAPHY = [
    _typo("typo.double_space", "Double space", r"(?<=\S) {2,}(?=\S)", " "),
    _typo("typo.space_before_punct", "Space before a punctuation mark", r"(?<=\S) +(?=[,;:!?])", ""),
    _typo("typo.space_before_punct", "Space before a full stop", r"(?<=[^\s\d.]) +(?=\.(?:\s|\z))", ""),
    _typo("typo.no_space_after_punct", "No space after a punctuation mark", rf"(?<=[{X.CYR}»)])([,;])(?=[{X.CYR}«(])", r"\1 ", 1),
    _typo("typo.quotes", "Straight quotes where angle quotes are used", r'"([^"\n]{1,120})"', r"«\1»", 1),
    _typo("typo.dash", "A hyphen between spaces where a dash is meant", r"(?<=\S) - (?=\S)", " — "),
    _typo("typo.abbrev_space", "No space after an abbreviation", rf"\b({alternatives(X.SPACED_ABBREVIATIONS, quote=False)})\.(?=[\d{X.UP}])", r"\1. ", 1),
    _typo("typo.abbrev_space", "No space after the number sign", r"№(?=\d)", "№ "),
    _typo("typo.year_g", "A year and its short form run together", r"(?<=\d{4})г\.", " г."),
    _typo("typo.initials", "Initials run together", rf"(?<=\b[{X.UP}]\.)([{X.UP}]\.)(?!\S)", r" \1", 1),
]


def _words() -> Column:
    return F.filter("_tokens", lambda t: t["kind"] == "word")


def _mixed_alphabet() -> Column:
    mixed = F.filter(_words(), lambda t: t["text"].rlike("[A-Za-z]") & t["text"].rlike(f"[{X.CYR}]"))
    meant = lambda t: F.translate(t["text"], X.LATIN_TYPED, X.LATIN_MEANT)
    return F.transform(mixed, lambda t: _span(t["start"], t["end"], F.when(meant(t).rlike("[A-Za-z]"), F.array().cast(SUGGESTIONS)).otherwise(F.array(meant(t))), F.lit(_MIXED)))


_MIXED = "Latin and Cyrillic letters in one word"
_ROMAN = "A Roman numeral in Cyrillic letters"


def _roman() -> Column:
    found = finditer(F.col("text"), rf"(?U)(?<![\w{X.CYR}])[{X.ROMAN_TYPED}]{{1,5}}(?![\w{X.CYR}])")
    found = F.filter(found, lambda m: m["frag"].rlike("[ІХ]") & ((F.length(m["frag"]) > 1) | (F.col("lang") != "kk")))
    return F.transform(found, lambda m: _span(m["start"], m["end"], F.array(F.translate(m["frag"], X.ROMAN_TYPED, X.ROMAN_MEANT)), F.lit(_ROMAN)))


def _double_word() -> Column:
    found = finditer(F.col("text"), rf"(?iuU)(?<![\w-])([{X.CYR}]+)\s+\1(?![\w-])", 1)
    return F.transform(found, lambda m: _span(m["start"], m["end"], F.array(m["g1"]), F.lit("The same word twice in a row")))


def _long_sentence(limit: int) -> Callable[[], Column]:
    def spans() -> Column:
        count = lambda s: F.size(F.filter("_tokens", lambda t: (t["kind"] == "word") & (t["start"] >= s["start"]) & (t["start"] < s["end"])))
        counted = F.transform("_sentences", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), count(s).alias("n")))
        long = F.filter(counted, lambda s: s["n"] > limit)
        return F.transform(long, lambda s: _span(s["start"], s["end"], F.array(), F.format_string("A sentence of %d words", s["n"])))

    return spans


def _at(i: Column) -> Column:
    """The i-th token that is no white space, from 0; null outside."""
    return F.get("_solid", i)


def _numbered(condition: Callable[[Column, Column], Column]) -> Column:
    """Positions among the solid tokens that fulfil a condition on (token, position)."""
    numbered = F.transform("_solid", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.filter(numbered, lambda x: condition(x["t"], x["i"]))


def _starts_sentence(t: Column) -> Column:
    return F.exists("_sentences", lambda s: s["start"] == t["start"])


def _own_sentence_start(t: Column) -> Column:
    """Whether the sentence around a token begins with it."""
    return F.exists("_sentences", lambda s: (s["start"] == t["start"]) & (t["start"] < s["end"]))


def _gap(i: Column, t: Column) -> Column:
    before = _at(i - 1)
    text = F.substring(F.col("text"), before["end"] + 1, t["start"] - before["end"])
    return (t["start"] > before["end"]) & text.rlike(r"(?U)^\s+\z")


def _low(t: Column) -> Column:
    return F.coalesce(F.lower(t["text"]), F.lit(""))


def _comma_before(found: Column) -> Column:
    return F.transform(found, lambda x: _span(_at(x["i"] - 1)["end"], x["t"]["start"], F.array(F.lit(", ")), F.lit(_COMMA)))


_COMMA = "A comma is wanted before the conjunction"


def _comma_conj_ru() -> Column:
    def wanted(t: Column, i: Column) -> Column:
        before, pair = _at(i - 1), F.concat_ws(" ", _low(t), _low(_at(i + 1))).isin(*X.CONJUNCTION_PAIRS_RU)
        single = _low(t).isin(*X.CONJUNCTIONS_RU) & ~_low(before).isin(*X.NO_COMMA_AFTER)
        window = F.slice("_solid", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        stopped = F.exists(window, lambda p: (p["kind"] == "punct") & p["text"].isin(*",;:—–-(«"))
        return (i > 0) & (t["kind"] == "word") & (before["kind"] == "word") & ~_own_sentence_start(t) & (pair | single) & ~stopped & _gap(i, t)

    return _comma_before(_numbered(wanted))


def _comma_conj_kk() -> Column:
    def wanted(t: Column, i: Column) -> Column:
        pair = F.concat_ws(" ", _low(t), _low(_at(i + 1))).isin(*X.CONJUNCTION_PAIRS_KK)
        return (i > 0) & (t["kind"] == "word") & (_at(i - 1)["kind"] == "word") & (_low(t).isin(*X.CONJUNCTIONS_KK) | pair) & ~_own_sentence_start(t) & _gap(i, t)

    return _comma_before(_numbered(wanted))


def _comma_intro_kk() -> Column:
    size = F.size("_solid")

    def last(t: Column, i: Column) -> Column:
        pair = F.concat_ws(" ", _low(t), _low(_at(i + 1))).isin(*X.INTRO_PAIRS_KK) & (i + 2 < size)
        return F.when(pair, i + 1).when(_low(t).isin(*X.INTRO_KK), i)

    def wanted(t: Column, i: Column) -> Column:
        k = last(t, i)
        return (t["kind"] == "word") & _starts_sentence(t) & (i + 1 < size) & k.isNotNull() & (_at(k + 1)["kind"] != "punct") & _gap(k + 1, _at(k + 1))

    found = _numbered(wanted)
    return F.transform(found, lambda x: _span(_at(last(x["t"], x["i"]))["end"], _at(last(x["t"], x["i"]) + 1)["start"], F.array(F.lit(", ")), F.lit("A comma is wanted after the introductory word")))


def _particles_kk() -> Column:
    inside = lambda s: F.filter("_solid", lambda t: (t["start"] >= s["start"]) & (t["start"] < s["end"]))
    particle = lambda t: (t["kind"] == "word") & F.lower(t["text"]).isin(*X.PARTICLES_KK)
    places = lambda ts: F.filter(F.transform(ts, lambda t, i: F.when(particle(t), i)), lambda i: i.isNotNull())

    def one(s: Column) -> Column:
        ts = inside(s)
        a, b = F.get(places(ts), F.lit(0)), F.get(places(ts), F.lit(1))
        between = F.slice(ts, a + 2, b - a - 1)
        right = b.isNotNull() & (b - a > 1) & ~F.exists(between, lambda t: t["kind"] != "word")
        return F.when(right, _span(F.get(ts, a)["start"], F.get(ts, b)["end"], F.array(), F.lit("A comma is wanted between parts with repeated particles")))

    return F.filter(F.transform("_sentences", one), lambda x: x.isNotNull())


def _not_after_privesti(m: Column, text: Column) -> Column:
    near = F.lower(F.substring(text, F.greatest(m["start"] - 59, F.lit(1)), F.least(m["start"], F.lit(60))))
    return ~near.rlike(r"(?U)(привест|привед|привод)\w*(\s+\S+){0,3}\s*\z")


def _holds(*words: str) -> Callable[[], Column]:
    """A quick test whether a text holds one of some words, in any case."""
    pattern = rf"(?iuU)(?<!\w){alternatives(words, quote=False)}(?!\w)"
    return lambda: F.col("text").rlike(pattern)


def soglasno_forms(paragraphs: DataFrame, morphology: DataFrame | None) -> dict[str, tuple[bool, str | None]]:
    """What :func:`soglasno_rule` needs for the words that follow «согласно» in these paragraphs (text, lang).

    ``morphology`` (form in lower case, genitive, dative): ``genitive`` says that the form is a genitive noun, adjective
    or participle without a dative parse. A table without these columns gives nothing; of repeated forms all must say so.
    """
    if morphology is None or not {"genitive", "dative"} <= set(morphology.columns):
        return {}
    held = paragraphs.where((F.col("lang") == "ru") & _holds("согласно")())
    words = F.transform(F.filter(tokens(F.col("text")), lambda t: t["kind"] == "word"), lambda t: F.lower(t["text"]))
    pairs = F.transform("_w", lambda w, i: F.when(w == "согласно", F.get("_w", i + 1)))
    following = held.select(words.alias("_w")).select(F.explode(pairs).alias("form")).where("form is not null").distinct()
    known = morphology.groupBy("form").agg(F.min(F.coalesce("genitive", F.lit(False))).alias("genitive"), F.min("dative").alias("dative"))
    return {r.form: (True, r.dative) for r in known.where("genitive").join(following, "form").orderBy("form").collect()}


def soglasno_rule(morphology: dict[str, tuple[bool, str | None]] | None = None) -> Rule:
    """Genitive after «согласно»: ``morphology`` maps a form to (genitive noun or adjective without a dative parse, its dative if it has one)."""

    def spans() -> Column:
        if not morphology:
            return F.array().cast("array<struct<start:int,end:int,suggestions:array<string>,message:string>>")
        table = F.create_map(*[x for form, (wrong, dative) in morphology.items() if wrong for x in (F.lit(form), F.array(*[F.lit(dative)] * (dative is not None)).cast(SUGGESTIONS))])
        words = _words()
        numbered = F.transform(words, lambda t, i: F.struct(t.alias("t"), F.get(words, i + 1).alias("next")))
        found = F.filter(numbered, lambda x: (F.lower(x["t"]["text"]) == "согласно") & F.element_at(table, F.lower(x["next"]["text"])).isNotNull())
        return F.transform(found, lambda x: _span(x["next"]["start"], x["next"]["end"], F.element_at(table, F.lower(x["next"]["text"])), F.lit("The dative is wanted after «согласно»")))

    return Rule("legal.soglasno", "ru", "grammar", "error", "The dative is wanted after «согласно»", spans, may=_holds("согласно"))


def default_rules(sentence_words: int = 60, morphology: dict[str, tuple[bool, str | None]] | None = None, user_rules: tuple[Rule, ...] = ()) -> list[Rule]:
    """The paragraph rules in their order, the user's last. Order counts where issues overlap."""
    hyphen = lambda id, message, pattern, condition=None: pattern_rule(id, "kk", "typography", "error", message, pattern, r"\1-\2", 2, condition)
    return [
        *TYPOGRAPHY,
        Rule("alpha.mixed", "any", "spelling", "error", _MIXED, _mixed_alphabet, may=lambda: F.col("text").rlike(rf"[A-Za-z][-'’]?[{X.CYR}]|[{X.CYR}][-'’]?[A-Za-z]")),
        Rule("alpha.roman", "any", "typography", "warning", _ROMAN, _roman),
        Rule("rep.double", "any", "style", "error", "The same word twice in a row", _double_word),
        Rule("sent.long", "any", "style", "hint", "A very long sentence", _long_sentence(sentence_words), may=lambda: F.length(F.translate("text", ALL_LETTERS, "")) >= sentence_words, limit=sentence_words),
        pattern_rule("legal.sootvetstvie", "ru", "grammar", "error", "«в соответствии с» is wanted", r"\bв соответствие (с|со)\b", r"в соответствии \1", 1, _not_after_privesti, True),
        pattern_rule("legal.v_techenie", "ru", "grammar", "error", "«в течение» is wanted of a time", rf"\bв течении(?= {alternatives(X.TIME_WORDS, quote=False)}\b)", "в течение", 0, None, True),
        soglasno_rule(morphology),
        Rule("punct.comma_conj", "ru", "punctuation", "error", _COMMA, _comma_conj_ru, may=_holds(*X.CONJUNCTIONS_RU, *(p.replace(" ", r"\s+") for p in X.CONJUNCTION_PAIRS_RU))),
        Rule("kk.comma_conj", "kk", "punctuation", "error", _COMMA, _comma_conj_kk, may=_holds(*X.CONJUNCTIONS_KK, *(p.replace(" ", r"\s+") for p in X.CONJUNCTION_PAIRS_KK))),
        Rule("kk.comma_intro", "kk", "punctuation", "error", "A comma is wanted after the introductory word", _comma_intro_kk, may=_holds(*X.INTRO_KK, *(p.split()[0] for p in X.INTRO_PAIRS_KK))),
        Rule("kk.da_de", "kk", "punctuation", "hint", "A comma is wanted between parts with repeated particles", _particles_kk, may=_holds(*X.PARTICLES_KK)),
        hyphen("kk.hyphen_ordinal", "A hyphen is wanted between a number and its noun", rf"\b(\d+) ({alternatives(X.NUMBERED_NOUNS_KK, quote=False)}[{X.LOW_KK}]*)\b"),
        hyphen("kk.hyphen_suffix", "A hyphen is wanted before a number's suffix", rf"\b(\d+) ({alternatives(X.NUMBER_SUFFIXES_KK, quote=False)})\b"),
        hyphen("kk.hyphen_abbrev", "A hyphen is wanted before an abbreviation's affix", rf"\b([{X.UP}]{{2,6}})([{X.LOW_KK}]{{2,4}})\b", lambda m, _: m["g2"].isin(*X.ABBREVIATION_AFFIXES_KK)),
        *user_rules,
    ]


def enriched(paragraphs: DataFrame, needed: Column | None = None) -> DataFrame:
    """Paragraphs with lang and text, and the arrays that token rules read, empty where they are not needed."""
    base = paragraphs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    found, sentences = tokens(F.col("text")), sentences_by_language(F.col("text"), F.col("lang"))
    if needed is not None:
        base = base.withColumn("_needed", needed)
        found, sentences = F.when(F.col("_needed"), found).otherwise(F.array().cast(TOKEN_TYPE)), F.when(F.col("_needed"), sentences).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    with_tokens = base.withColumn("_tokens", found).withColumn("_sentences", sentences)
    return with_tokens.withColumn("_solid", F.filter("_tokens", lambda t: t["kind"] != "space"))


def _issue_of(rule: Rule, order: int) -> Callable[[Column, Column], Column]:
    def make(s: Column, i: Column) -> Column:
        return F.struct(
            s["start"].cast("int").alias("start_pos"), s["end"].cast("int").alias("end_pos"), F.lit(rule.category).alias("category"), F.lit(rule.level).alias("level"), F.lit(rule.id).alias("rule_id"),
            F.lit(rule.engine).alias("engine"), s["message"].alias("message"), s["suggestions"].alias("suggestions"),
            F.struct(F.lit(RULE_STAGE).alias("stage"), F.lit(order).alias("rule"), i.alias("pos")).alias("seq"),
        )

    return make


def rule_issues(paragraphs: DataFrame, rules: list[Rule] | None = None, keys: tuple[str, ...] = ("doc_id", "para"), disabled: tuple[str, ...] = ()) -> DataFrame:
    """Issues of all paragraph rules: keys, ISSUE_FIELDS. ``paragraphs``: keys, text, lang.

    Mixed paragraphs get the rules of no language; blank and null texts get none; disabled rules are not planned.
    """
    arrays = []
    needed = F.lit(False)
    for order, rule in enumerate(rules if rules is not None else default_rules()):
        if rule.id in disabled:
            continue
        issues = F.transform(rule.spans(), _issue_of(rule, order))
        empty = F.array().cast(ISSUE_TYPE)
        applies = F.lit(True) if rule.lang == "any" else F.col("lang") == rule.lang
        if rule.may is not None:
            applies = applies & rule.may()
            needed = needed | applies
        arrays.append(F.when(applies, F.coalesce(issues.cast(ISSUE_TYPE), empty)).otherwise(empty))
    base = enriched(paragraphs.select(*keys, "text", "lang").where(F.col("text").rlike(r"(?U)\S")), needed)
    if not arrays:
        arrays = [F.array().cast(ISSUE_TYPE)]
    return base.select(*keys, F.inline(F.concat(*arrays)))
