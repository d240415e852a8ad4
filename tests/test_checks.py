import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexisteppe.operators import edits, external, issues, names, rules, spell
from lexisteppe.plans.examples import EXAMPLES, FOUND
from lexisteppe.plans.pipeline import Resources, check
from lexisteppe.functions.fixed import ENGINE_PRIORITY

PARA = "doc_id int, para int, text string, lang string"
ISSUE = "doc_id int, para int, start_pos int, end_pos int, category string, engine string, seq int"


def _forms(spark, *forms):
    return spark.createDataFrame([(f,) for f in forms], "form string")


def test_every_example(spark):
    df = spark.createDataFrame([(i, 0, text, lang) for i, (_, lang, text, _) in enumerate(EXAMPLES)], PARA)
    found = {}
    for r in rules.rule_issues(df).collect():
        found.setdefault((r.doc_id, r.rule_id), []).append(r)
    for i, (rule, _, text, fixed) in enumerate(EXAMPLES):
        got = sorted(found.get((i, rule), []), key=lambda r: tuple(r.seq))
        if fixed is None:
            assert not got, (rule, text)
        elif fixed == FOUND:
            assert got and not got[0].suggestions, (rule, text)
        else:
            assert text[: got[0].start_pos] + got[0].suggestions[0] + text[got[0].end_pos :] == fixed, (rule, text)


def test_examples_cover_the_rules():
    assert {r.id for r in rules.default_rules()} - {"legal.soglasno"} == {e[0] for e in EXAMPLES}


def test_soglasno_with_morphology(spark):
    rule = rules.soglasno_rule({"договора": (True, "договору"), "договору": (False, "договору")})
    df = spark.createDataFrame([(1, 0, "Согласно договора, и согласно договору.", "ru"), (2, 0, "согласно", "ru")], PARA)
    assert [(r.start_pos, r.end_pos, r.suggestions) for r in rules.rule_issues(df, [rule]).collect()] == [(9, 17, ["договору"])]


def test_languages_blank_and_disabled(spark):
    df = spark.createDataFrame([(1, 0, "в течении дня - да", "mixed"), (2, 0, None, "ru"), (3, 0, " ", "ru"), (4, 0, "🙂 - да", "ru")], PARA)
    out = [(r.doc_id, r.rule_id, r.start_pos) for r in rules.rule_issues(df).collect()]
    assert sorted(out) == [(1, "typo.dash", 13), (4, "typo.dash", 1)]
    assert rules.rule_issues(df, disabled=("typo.dash",)).count() == 0 and rules.rule_issues(df.limit(0)).count() == 0 and rules.rule_issues(df, []).count() == 0


def _fold(rows):
    kept = []
    for r in rows:
        for i, o in enumerate(kept):
            if o[2] < r[3] and r[2] < o[3]:
                if ENGINE_PRIORITY.get(r[5], 9) < ENGINE_PRIORITY.get(o[5], 9):
                    kept[i] = r
                break
        else:
            kept.append(r)
    return kept


def test_overlaps_against_the_plain_fold(spark):
    r = random.Random(3)
    rows = [(d, p, s, s + r.randrange(1, 6), r.choice(["style", "spelling"]), r.choice(["rules", "lt", "kk_spell", "other"]), k) for k, (d, p, s) in enumerate((r.randrange(3), r.randrange(2), r.randrange(20)) for _ in range(150))]
    out = {tuple(x) for x in issues.without_overlaps(spark.createDataFrame(rows, ISSUE)).collect()}
    want = set()
    for _, group in itertools.groupby(sorted(rows, key=lambda x: (x[0], x[1], x[4], x[6])), key=lambda x: (x[0], x[1], x[4])):
        want |= set(_fold(list(group)))
    assert out == want and 20 < len(want) < 150
    assert issues.without_overlaps(spark.createDataFrame([], ISSUE)).count() == 0


def test_filters_counts_order_and_states(spark):
    rows = [(1, 0, "a", 5, 6, "spelling", "error", "x", "lt", 1, "суд"), (1, 0, "a", 0, 2, "style", "hint", "y", "rules", 2, "да"), (1, 1, "a", 0, 2, None, "warning", None, "user", 3, None), (1, 0, "a", 5, 6, "style", "hint", "y", "rules", 4, "нет")]
    df = spark.createDataFrame(rows, "doc_id int, para int, text string, start_pos int, end_pos int, category string, level string, rule_id string, engine string, seq int, fragment string")
    assert issues.wanted(df, issues.Settings(categories={"style": False, "spelling": True}, disabled_rules=["x"])).count() == 1
    c = issues.counts(df).first()
    assert (c.issues, c.errors, c.warnings, c.hints) == (4, 1, 1, 2)
    s = issues.opened(df)
    assert [r.seq for r in s.orderBy("number").collect()] == [2, 4, 1, 3]
    s = issues.skipped(s, spark.createDataFrame([(1, 1)], "doc_id int, number int"))
    s = issues.closed_by_word(s, spark.createDataFrame([(1, "СУД")], "doc_id int, entry string"))
    s = issues.closed_by_rule(s, "y")
    assert [r.status for r in s.orderBy("number").collect()] == ["skipped", "closed", "closed", "open"]
    assert issues.visible(s, issues.Settings()).count() == 1


def test_phrases_and_user_words(spark):
    text = "срок иска истёк, срок"
    rows = [(1, 0, text, s, e, c) for s, e, c in ((0, 4, "spelling"), (5, 9, "spelling"), (17, 21, "spelling"), (0, 4, "style"))]
    df = spark.createDataFrame(rows, "doc_id int, para int, text string, start_pos int, end_pos int, category string")
    none = spark.createDataFrame([], "entry string")
    assert sorted((r.start_pos, r.category) for r in issues.without_accepted(df, none, ["срок иска"]).collect()) == [(0, "style"), (17, "spelling")]
    assert sorted((r.start_pos, r.category) for r in issues.without_accepted(df, spark.createDataFrame([("срок",)], "entry string"), []).collect()) == [(0, "style"), (5, "spelling")]


def test_fixes_against_plain_python(spark):
    r = random.Random(1)
    paras, fixes, want = [], [], {}
    for d in range(30):
        text = "".join(r.choice("аб🙂 в") for _ in range(30))
        cuts = sorted(r.sample(range(31), 6))
        mine = [(cuts[i], cuts[i + 1], r.choice(["", "X", "слово"])) for i in (0, 2, 4)]
        paras.append((d, 0, text))
        fixes += [(d, 0, *f) for f in mine]
        for s, e, new in reversed(mine):
            text = text[:s] + new + text[e:]
        want[d] = text
    p = spark.createDataFrame([*paras, (99, 0, None), (98, 0, "нет")], "doc_id int, para int, text string")
    f = spark.createDataFrame([*fixes, (98, 0, 2, 9, "за край"), (98, 0, None, None, None)], "doc_id int, para int, start_pos int, end_pos int, replacement string")
    out = {x.doc_id: x.text for x in edits.applied(p, f).collect()}
    assert out == want | {99: None, 98: "нет"}


def test_shifts_and_runs(spark):
    i = spark.createDataFrame([(1, 0, 0, 2, "open"), (1, 0, 5, 7, "open"), (1, 0, 8, 9, "skipped"), (1, 1, 5, 6, "open")], "doc_id int, para int, start_pos int, end_pos int, status string")
    f = spark.createDataFrame([(1, 0, 4, 6, "длинное"), (1, 0, 2, 3, "")], "doc_id int, para int, start_pos int, end_pos int, replacement string")
    out = sorted((r.para, r.start_pos, r.end_pos, r.status) for r in edits.shifted(i, f).collect())
    assert out == [(0, 0, 2, "open"), (0, 5, 7, "closed"), (0, 12, 13, "skipped"), (1, 5, 6, "open")]
    runs = edits.run_offsets(spark.createDataFrame([(1, 0, 0, "Жир", True), (1, 0, 1, "", False), (1, 0, 2, "ный", False)], "doc_id int, para int, ord int, text string, bold boolean"))
    cut = edits.split_runs(runs, spark.createDataFrame([(1, 0, 1), (1, 0, 3), (1, 0, 5)], "doc_id int, para int, at int"))
    assert sorted((r.start_pos, r.end_pos, r.text, r.bold) for r in cut.collect()) == [(0, 1, "Ж", True), (1, 3, "ир", True), (3, 5, "ны", False), (5, 6, "й", False)]


def test_variants(spark):
    text = "Истец Ахметов и Ахметова, ответчик Ахмедов. Свидетель Ахметов пришёл. А Сериков и Сериков, да Сирик."
    df = spark.createDataFrame([(1, 0, text, "ru"), (2, 0, "Явился Ахмедов.", "ru"), (3, 0, None, "ru")], PARA)
    out = [(r.doc_id, text[r.start_pos : r.end_pos], list(r.suggestions)) for r in names.variant_issues(df).collect()]
    assert out == [(1, "Ахмедов", ["Ахметов"])]
    assert names.variant_issues(df.limit(0)).count() == 0


def test_variant_pairs_against_all_pairs(spark):
    r = random.Random(7)
    stems = ["Абрамцев", "Абрамцов", "Обрамцев", "Кенжебаевский", "Кенжибаевский", "Кинжибаевский", "Сулейман", "Сулеймен"]
    rows = [(d, 0, k * 10, k * 10 + 5, s, s.lower()) for d in range(6) for k, s in enumerate(r.choices(stems, k=14))]
    df = spark.createDataFrame(rows, "doc_id int, para int, start_pos int, end_pos int, form string, lemma string")
    got = {(x.doc_id, x.rare): x.frequent for x in names.variant_pairs(df).collect()}
    want = {}
    for d in range(6):
        mine = [x for x in rows if x[0] == d]
        n = {lemma: sum(x[5] == lemma for x in mine) for lemma in dict.fromkeys(x[5] for x in mine)}
        order = sorted(n, key=lambda lemma: -n[lemma])
        for i, rare in enumerate(order):
            for frequent in order[:i]:
                if n[frequent] > n[rare] and _levenshtein(rare, frequent) <= (1 if len(rare) <= 9 else 2):
                    want[d, rare] = frequent
                    break
    assert got == want and want


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_official(spark):
    names_ru = ["Верховный Суд Республики Казахстан", "Гражданский кодекс"]
    cases = {"Решил верховный суд республики Казахстан.": ["Верховный Суд Республики Казахстан"], "Верховного Суда Республики Казахстан": [], "Верховный Суд Реепублики Казахстан": ["Верховный Суд Республики Казахстан"], "Верховный Сид Республики Казахстан": [], "Граждaнский кодекс": [], "гражданский кодекс": ["Гражданский кодекс"]}
    df = spark.createDataFrame([(i, 0, t, "ru") for i, t in enumerate(cases)] + [(90, 0, None, "kk")], PARA)
    got = {}
    for r in names.official_issues(df, names_ru, []).collect():
        got.setdefault(r.doc_id, []).append(r.suggestions[0])
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


def test_near_repeats(spark):
    df = spark.createDataFrame([(1, 0, "Перевозчик принял груз. Затем перевозчик ушёл. Склад закрыт. Перевозчик вернулся.", "ru")], PARA)
    stop = spark.createDataFrame([("затем",)], "word string")
    assert [(r.start_pos, r.fragment) for r in names.near_repeats(df, stop).collect()] == [(30, "перевозчик")]


def test_spelling_policy(spark):
    ru = spell.Words("ru_spell", _forms(spark, "суд", "решил", "иск", "по", "делу", "правовой", "акт"), lexicon=_forms(spark, "медиация"), names=_forms(spark, "Ахметов"), other=_forms(spark, "сот"))
    kk = spell.Words("kk_spell", _forms(spark, "сот", "шешті"), other=_forms(spark, "суд"))
    text = "Сууд решил иск. Явился Ахметов, затем Бесков и Тесков, Тесков. ГПК по-делу сот «сот» медиация суд-иск 5-й web."
    df = spark.createDataFrame([(1, 0, text, "ru"), (2, 0, "Сот шешті суд «суд».", "kk"), (3, 0, None, "ru")], PARA)
    got = sorted((r.doc_id, text[r.start_pos : r.end_pos] if r.doc_id == 1 else r.start_pos, r.rule_id.split(":")[1], r.level) for r in spell.spelling_issues(df, ru, kk).collect())
    want = [(1, "Бесков", "name", "hint"), (1, "Сууд", "unknown", "error"), (1, "Явился", "unknown", "error"), (1, "затем", "unknown", "error"), (1, "и", "unknown", "error"), (1, "сот", "foreign", "hint"), (2, 0, "unknown", "error"), (2, 10, "foreign", "hint")]
    assert got == [w for w in want if w[1] != "и"]


def test_suggestions(spark):
    out = spell.suggestions(spark.createDataFrame([("сууд",), ("иск",), ("ъъъ",)], "word string"), _forms(spark, "суд", "сад", "иск", "искр"))
    assert {r.word: r.suggestions for r in out.collect()} == {"сууд": ["суд"], "иск": ["иск", "искр"]}


def test_external_checker(spark):
    assert external.packed([10, 10, 25, 5], 22) == [[0, 1], [2], [3]] and external.packed([]) == []
    df = spark.createDataFrame([(1, i, "x" * n, "ru") for i, n in enumerate((10, 10, 25, 5))], PARA)
    assert [r.batch for r in external.batch_numbers(df, 22).orderBy("para").collect()] == [0, 0, 1, 2]

    def checker(text):
        if "беда" in text:
            raise external.Unavailable("no")
        at = text.index("Сууд") if "Сууд" in text else 0
        return [{"offset": at, "length": 4, "message": " m ", "rule": "R", "category": "TYPOS", "replacements": list("абвгде")}, {"offset": len(text) - 1, "length": 5, "message": "", "rule": "over", "category": "ZZ", "replacements": []}]

    df = spark.createDataFrame([(1, 0, "Вот.", "ru"), (1, 1, "А Сууд тут.", "ru"), (2, 0, None, "ru")], PARA).coalesce(1)
    out = external.external_issues(df, checker).collect()
    assert [(r.para, r.start_pos, r.end_pos, r.category, r.level, r.suggestions) for r in out] == [(1, 2, 6, "spelling", "error", list("абвгд"))]
    lists = spell.Words("ru_spell", _forms(spark, "тут"))
    refined = external.refined_spelling(external.external_issues(df, checker), spell.word_tokens(df), lists).collect()
    assert [(r.level, r.suggestions) for r in refined] == [("hint", [])]
    assert external.external_issues(spark.createDataFrame([(1, 0, "беда", "ru")], PARA), checker).count() == 0


def test_pipeline(spark):
    text = 'Банк "Степь" подал иск - да.\nИстец  молчит молчит.'
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))] + [(2, 0, None), (3, 0, "")], "doc_id int, para int, text string")
    out = [(r.number, r.para, r.rule_id, r.fragment) for r in check(df).orderBy("number").collect()]
    assert out == [(1, 0, "typo.quotes", '"Степь"'), (2, 0, "typo.dash", " - "), (3, 1, "typo.double_space", "  "), (4, 1, "rep.double", "молчит молчит")]
    off = check(df, settings=issues.Settings(categories={"style": False}, disabled_rules=["typo.dash"]))
    assert [r.rule_id for r in off.orderBy("number").collect()] == ["typo.quotes", "typo.double_space"]
    assert check(df.limit(0)).count() == 0
    user = Resources(user_rules=[rules.pattern_rule("user.1", "any", "style", "hint", "m", r"\bБанк\b", None, ignore_case=True, engine="user")])
    assert "user.1" in {r.rule_id for r in check(df, user).collect()}


def test_pipeline_soglasno(spark):
    schema = "form string, lemma string, is_name boolean, genitive boolean, dative string"
    table = spark.createDataFrame([("договора", "договор", False, True, "договору"), ("договору", "договор", False, False, None), ("пальто", "пальто", False, True, None), ("акта", "акт", False, True, "акту"), ("акта", "акт", False, False, None)], schema)
    texts = spark.createDataFrame([(1, 0, "Согласно договора стороны платят."), (2, 0, "Согласно договору стороны платят."), (3, 0, "Платят согласно 2 пальто и согласно акта.")], "doc_id int, para int, text string")
    found = lambda m: [(r.doc_id, r.start_pos, r.suggestions) for r in check(texts, Resources(morphology=m)).where("rule_id = 'legal.soglasno'").orderBy("doc_id").collect()]
    assert found(table) == [(1, 9, ["договору"]), (3, 18, [])]
    assert found(table.drop("genitive", "dative")) == [] and found(None) == []


def test_unknown_words_carry_suggestions(spark):
    """Errors of the word lists have the near forms, hints for names and words of the other language have none."""
    texts = spark.createDataFrame([(1, 0, "Суд взыскл долг с Ахметова, ыыыыы.", "ru")], "doc_id int, para int, text string, lang string")
    forms = spark.createDataFrame([(w,) for w in ("суд", "Суд", "взыскал", "взыскали", "долг", "с")], "form string")
    found = spell.spelling_issues(texts, spell.Words("ru_spell", forms), spell.Words("kk_spell", forms))
    assert {r.rule_id: r.suggestions for r in found.where("start_pos < 20").collect()} == {"ru_spell:unknown": ["взыскал"], "ru_spell:name": []}
    assert [r.suggestions for r in found.where("start_pos > 20").collect()] == [[]]
    assert all(r.suggestions == [] for r in spell.spelling_issues(texts, spell.Words("ru_spell", forms), spell.Words("kk_spell", forms), suggest=0).collect())
