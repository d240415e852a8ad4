import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisteppe.functions import fixed as X
from lexisteppe.functions.lang import with_languages
from lexisteppe.functions.match import expand, finditer
from lexisteppe.functions.segment import sentences, tokens, words

TOKEN = re.compile(rf"(?P<number>\d+(?:[.,]\d+)*(?:-(?:\d+|[{X.LETTERS}]+))*)|(?P<word>[{X.LETTERS}]+(?:[-'’][{X.LETTERS}]+)*)|(?P<space>\s+)|(?P<punct>[^\s{X.LETTERS}\d])")
ODD = ["", " ", "ст. 7-2 ГПК, 3 000 тенге", "5-ші", "🙂 да—нет", "é ü ß Nur-Sultan’s", "a  b\n\tc", "А. Б. Иванов пришёл. Да!", "Что? «Да». Нет.", "1. Иск\n2. Отзыв. Всё", "т.е. так… Вот", "x" * 3_000, "да " * 2_000, "₂² ½ №7"]


@pytest.fixture(scope="module")
def texts(spark):
    from lexisteppe.runtime import read

    real = [r.text for r in read(spark, "/root/testdata/sf0.001", "paras").select("text").distinct().collect() if r.text]
    return spark.createDataFrame([(t,) for t in [*ODD, *real]], "text string")


def _sentences(text, lang):
    """The rule spelled out: marks, what follows, what stands before a single stop."""
    short = {*X.ABBREVIATIONS_RU, *(X.ABBREVIATIONS_KK if lang == "kk" else ())}
    out, begin = [], len(text) - len(text.lstrip())
    for m in re.finditer(r'[.!?…]+[»")\]]*', text):
        rest = text[m.end() :]
        ends = not rest.strip()
        if not ends and rest[0].isspace():
            c = rest.lstrip()[0]
            ends = c.isupper() or c.isdigit() or c in '«"('
            if ends and text[m.start()] == ".":
                before = text[: m.start()]
                w = re.search(rf"[{X.LETTERS}][{X.LETTERS}.]*$", before)
                token = w.group().lower().rstrip(".") if w else ""
                ends = not (w and (token in short or len(token) == 1 and w.group()[0].isupper()) or re.search(r"(?:^|\n)\s*\d+$", before))
        if ends and m.end() >= begin:
            out.append((begin, m.end()))
            begin = len(text) - len(rest.lstrip())
    if text[begin:].strip():
        out.append((begin, len(text.rstrip())))
    return out


def test_tokens_words_sentences_against_plain_python(texts):
    t = F.col("text")
    rows = texts.select("text", tokens(t).alias("t"), words(t).alias("w"), sentences(t).alias("ru"), sentences(t, "kk").alias("kk")).collect()
    assert len(rows) > 200
    for r in rows:
        want = [(m.start(), m.end(), m.group(), m.lastgroup) for m in TOKEN.finditer(r.text)]
        assert [tuple(x) for x in r.t] == want and "".join(x[2] for x in want) == r.text
        assert list(r.w) == [x[2] for x in want if x[3] == "word"]
        assert [tuple(x) for x in r.ru] == _sentences(r.text, "ru") and [tuple(x) for x in r.kk] == _sentences(r.text, "kk")


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    r = df.select(tokens(F.col("text")).alias("t"), sentences(F.col("text")).alias("s"), finditer(F.col("text"), "a").alias("m")).first()
    assert r.t is None and r.s is None and r.m is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("аб 1-\n🙂", max_size=40), min_size=1, max_size=8))
def test_finditer_against_python(spark, strings):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(strings)], "i int, text string")
    for pattern in (r"(а+)(б)?", r"(?<=а) +(?=б)", r"\d"):
        groups = re.compile(pattern).groups
        for r in df.select("text", finditer(F.col("text"), pattern, groups).alias("m")).collect():
            assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m.group(), *[g or "" for g in m.groups()]) for m in re.finditer(pattern, r.text)]


def test_expand(spark):
    df = spark.createDataFrame([("а1",)], "text string")
    assert df.select(F.transform(finditer(F.col("text"), r"(а)(\d)", 2), lambda m: expand(r"<\2-\1>", m))[0].alias("x")).first().x == "<1-а>"


def test_languages_carry_forward(spark):
    ru, kk = "Суд не принял решение по иску", "Сот шешім шығарды және талап"
    texts = [ru, "", kk, "№ 7", f"{ru} {kk}", "42", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "№ 7")], "doc_id int, para int, text string")
    out = {(r.doc_id, r.para): r.lang for r in with_languages(df).collect()}
    assert [out[1, i] for i in range(7)] == ["ru", "ru", "kk", "kk", "mixed", "kk", "kk"] and out[2, 0] == "ru"
    assert {r.lang for r in with_languages(df, mode="kk").collect()} == {"kk"}
    known = spark.createDataFrame([("мой",), ("дом",), ("там",)], "form string")
    one = spark.createDataFrame([(1, 0, "мой дом там, Нұрлан")], "doc_id int, para int, text string")
    assert with_languages(one).first().lang == "kk" and with_languages(one, ru_known=known).first().lang == "ru"


def test_sentences_with_private_characters_and_long_numbers(spark):
    """No character is a marker, and a number that begins a line may have any length."""
    rows = [("Суд\ue000 решил. Иск\ue000.", [(0, 11), (12, 17)]), ("123456789012. Иск подан. Да", [(0, 24), (25, 27)]), ("Да.\n" + " " * 20 + "12. Иск", [(0, 3), (24, 31)]), ("12.", [(0, 3)]), ("Да. 5. Нет", [(0, 3), (4, 6), (7, 10)])]
    got = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(sentences(F.col("text")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in got] == [w for _, w in rows]
