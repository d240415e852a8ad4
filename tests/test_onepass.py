"""The check in one pass equals the engines' own expressions, which serve it where lists are large."""

import dataclasses

from pyspark.sql import functions as F

from lexisteppe.operators import corpus, spell
from lexisteppe.operators.issues import Settings
from lexisteppe.plans.examples import EXAMPLES
from lexisteppe.plans.pipeline import Resources, check

ODD = [
    "éчто он что", "Суд  решил , что ст.5 т.е. А. Б.В. Иванов", "12. Суд пришёл. 3.\nИстец", "а\x1cб  \x1c  в , г", '«Иванов "Петров Сидоров» Иванова', "на на'на на", "İİ на НА", "Ахметов был. и Ахметова и Ахмедов и Ахметов, потом Ахметов",
    "🙂 - да  𐐀 , x", "в течении́ дня в течении 5 дней", "кө́шет 5 ба 5 баптың 12 ші ҚРның ҚРға", "Сот да, сен де келді. Ол да мен де. ІV VІ І Х", "слово " * 70 + ". Да?! «Нет.» (так) т.д. и т.п. Истец", "  \t", "", "что‍что что", "Сот және туралы бойынша суд решение Ержанның қызы",
    "1.5. Да. 2. Нет 3 . да", "_№5 №_5 №٣ ст.٣ ٢٠٢١г. 2021г.", "Сот-Сот сот-суда суд-ыыы", "Суд решения сотта және осы үшін", "Абдрахманова Абдрахмановой и Абдрахманова, Абдрахмамовой, Абдрахмаовой",
]


def _rows(df):
    return sorted(repr([r[c] for c in ("doc_id", "para", "start_pos", "end_pos", "category", "level", "rule_id", "engine", "message", "suggestions", "seq", "lang", "fragment", "number")]) for r in df.collect())


def test_one_pass_equals_the_engines(spark):
    """With most_bytes=0 no list is small, and every engine reads the written paragraphs."""
    lines = [(i, j, x) for i, (_, _, a, _) in enumerate(EXAMPLES) for j, x in enumerate([a, "Осы " + a, "Суд решения по делу. " + a])]
    texts = spark.createDataFrame([*lines, *[(1000 + i // 5, i % 5, x) for i, x in enumerate(ODD)], (2000, 0, None)], "doc_id int, para int, text string")
    table = lambda *words: spark.createDataFrame([(w,) for w in words], "form string")
    forms = table("суд", "решил", "Суд", "что", "решение", "решения", "дела", "иск", "сот", "және", "шешім", "туралы", "договор")
    ru = spell.Words("ru_spell", forms, table("ИСТЕЦ"), table("Иванов"), table("Ответчик"), other=table("сот", "осы", "дней"), foreign_message="f")
    lists = Resources(ru=ru, kk=dataclasses.replace(ru, engine="kk_spell", forms=table("сот", "осы", "үшін", "да", "талап"), names=None, other=None))
    quick, whole = check(texts, lists, Settings(sentence_words_limit=20)), check(texts, lists, Settings(sentence_words_limit=20), most_bytes=0)
    got, want = _rows(quick), _rows(whole)
    assert got == want
    assert all(rule in "".join(got) for rule in ("ru_spell:foreign", "ru_spell:name", "kk_spell:unknown", "names.variants"))


def test_texts_move_once(spark):
    """One exchange, by document, and one pass of Python: no engine finds its own tokens and no join brings the texts back."""
    plan = check(spark.createDataFrame([(1, 0, "Суд  решил.")], "doc_id int, para int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and "Join" not in plan


def test_documents_in_several_batches_and_without_ids(spark):
    lines = spark.createDataFrame([(i % 3 or None, i, "Вот молчит молчит, Ержанов ушёл, Ержанов тут, а Ержаноб - нет.") for i in range(300)], "doc_id int, para int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = check(lines).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"), F.max("number").alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.doc_id, r.rule_id): r.n for r in found if r.rule_id != "names.variants"} == {(d, rule): 100 for d in (None, 1, 2) for rule in ("rep.double", "typo.dash")}
    assert {r.doc_id for r in found if r.rule_id == "names.variants"} == {None, 1, 2} and max(r.last for r in found) == sum(r.n for r in found if r.doc_id == 1)


def test_mined_lists_equal_the_words_of_documents(spark):
    texts = ["Суд указал: Ахметов прав. Ахметов ушёл.\r\nАхметов иск-отзыв\rИск иск", "Вот Дом! Дом дом слово², Ⅷслово сло́во", "", None]
    docs = spark.createDataFrame([(i, texts[i % 4], f"{'аб'[i % 3 % 2]}п-1.docx" if i % 5 else None) for i in range(40)], "doc_id bigint, text string, filename string")
    acts = spark.createDataFrame([(1, 1, "Суд А"), (2, 1, "Суд Б"), (3, 2, None), (4, 6, "Суд В")], "act_id bigint, doc_id bigint, court string")
    for d in (docs, docs.union(docs.where("doc_id < 9"))):
        found = corpus.corpus_words(corpus.with_court(d, acts))
        want = [{r.word for r in x.collect()} for x in (corpus.lexicon_candidates(found, min_docs=3, min_courts=2), corpus.corpus_names(found))]
        assert [{r.form for r in x.collect()} for x in corpus.mined_lists(d, acts)] == want and all(want)
