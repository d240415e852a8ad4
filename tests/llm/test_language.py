import pytest

from lexisteppe.llm import language as L

RU = ["Суд указал, что стороны не согласовали порядок приёмки", "Истец направил договор займа", "Кто взял билет", "Возьмите чек и акт", "Мы ждём вас днём"]
KK = ["Сот мынаны көрсетті", "Борышкер төлем кестесін тапсырды", "Билетті кім алды", "Таңертең талонды көрсетіңіз", "Заңгерге барудан қорықпаңыз"]
EN = ["The court found that the notice had been served", "Take the pass and go in", "Who has the note", "Show us the bill"]
ZH = ["合同约定买方应提供付款凭证", "双方未就验收报告达成一致"]


@pytest.fixture(scope="module")
def coder():
    rows = [(". ".join(x[i:] + x[:i]) + ".", lang) for x, lang in ((RU, "ru"), (KK, "kk"), (EN, "en"), (ZH, "zh")) for i in range(5)]
    return L.train([*rows, (RU[0], "kk"), (KK[0], "ru")])


def test_codewords_differ_in_half_of_the_bits():
    code = L.codewords(5)
    assert code.shape == (5, 15)
    assert all((code[a] != code[b]).sum() == 8 for a in range(5) for b in range(a))


def test_judge(coder):
    texts = ["Истец направил договор.", "Борышкер кестесін тапсырды.", None, "", "42 — !", f"{RU[0]}. {KK[0]}.\n{KK[1]}.", "Who has the note?\n" + EN[0], ZH[0] + "。"]
    out = list(L.judge(coder, texts))
    assert [x and x[0] for x in out] == ["ru", "kk", None, None, None, "mixed", "en", "zh"]
    assert [(i, lang) for i, lang, _ in out[5][2]] == [(0, "mixed"), (1, "kk")]
    assert all(0 < x[1] <= 1 for x in out if x)


def test_names_do_not_count():
    assert L.evidence(["Отырысқа", "Иван", "келді"]) == ["Отырысқа", "келді"] and L.evidence(["ИВАН", "ПЕТРОВ"]) == ["ИВАН", "ПЕТРОВ"]


def test_table(spark, coder):
    rows = [(1, f"{RU[0]}. {KK[0]}.", None, "x"), (2, RU[1], "ru", "x"), (2, RU[1], "ru", "x"), (3, None, None, "x"), (4, "", "kk", "x"), (5, KK[1] * 3_000, "", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, confidence string")
    out = sorted((r.row_id, r.line_no, r.lang, r.stored) for r in L.languages(df, coder, "doc_id", True, stored="lang").collect())
    assert out == [(1, -1, "mixed", None), (1, 0, "mixed", None), (2, -1, "ru", "ru"), (2, -1, "ru", "ru"), (5, -1, "kk", "")] or [x[:3] for x in out] == [(1, -1, "mixed"), (1, 0, "mixed"), (2, -1, "ru"), (2, -1, "ru"), (5, -1, "kk")]
    assert L.languages(df.limit(0), coder, "doc_id", True).count() == 0
    assert L.languages(df, None, "doc_id", True).count() == 0
    assert L.train([]) is None and L.train([(RU[0], "ru")]).languages == ["ru"]
    assert L.labelled(df, "doc_id", 10) and L.labelled(df.limit(0), "doc_id", 10) == []


def test_held_out_accuracy(spark):
    """Trained on one half of the labelled test paragraphs, right on nearly all of the other, beside wrong labels."""
    from lexisteppe.runtime import read

    rows = [(r.text, r.lang) for r in read(spark, "/root/testdata/sf0.01", "para_contexts").where("lang in ('ru', 'kk') and text is not null").orderBy("para_id").collect()]
    coder = L.train(rows[::2])
    held = rows[1::2]
    out = list(L.judge(coder, [t for t, _ in held]))
    kept = [(x[0], lang) for x, (_, lang) in zip(out, held, strict=True) if x]
    assert sum(a == b for a, b in kept) / len(kept) > 0.95


def test_spans_inside_a_line(coder):
    """Pieces of one language together, with their places in the line; a sentence that nothing speaks for is flagged."""
    line = f"  {RU[0]}. {RU[1]}. {KK[0]}. Name <a@b.kz> {EN[0]}.\r"
    spans = L.line_spans(coder, line)
    assert [x[2] for x in spans] == ["ru", "kk", "en"] and spans[0][0] == 2
    assert line[spans[0][0] : spans[0][1]] == f"{RU[0]}. {RU[1]}." and line[spans[1][0] : spans[1][1]] == f"{KK[0]}." and line[spans[2][0] : spans[2][1]].startswith("Name <a@b.kz>")
    assert L.line_spans(coder, "12 — !") == [] and L.line_spans(coder, "") == []
    assert all(x[4] == (x[3] < L.AMBIGUOUS) for x in spans)


def test_doubtful_sentences_are_flagged():
    import numpy as np

    unsure = L.Coder(["kk", "ru", "zh"], np.zeros((L.BUCKETS, 3), np.float32), np.ones(3, np.float32))
    found = L.line_spans(unsure, "Первое слово здесь. Второе слово тут.")
    assert len(found) == 2 and all(x[4] for x in found)


def test_spans_of_tables(spark, coder):
    df = spark.createDataFrame([(1, f"{RU[0]}.\n\n{KK[0]}.", "x"), (2, None, "x"), (3, "", None), (4, "42", None)], "doc_id bigint, text string, lang string")
    rows = {tuple(r)[:5] for r in L.language_spans(df, coder, "doc_id").collect()}
    assert rows == {(1, 0, 0, len(RU[0]) + 1, "ru"), (1, 2, 0, len(KK[0]) + 1, "kk")}
    assert L.language_spans(df, None, "doc_id").count() == 0
