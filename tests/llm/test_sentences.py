import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisteppe.llm import sentences as S
from lexisteppe.llm.sentences import sentence_offsets, split_sentences, distinct_texts


@pytest.mark.parametrize(
    "parts",
    [
        ["Суд решил.", " ", "Иск подан."], ["Работы (см. л. д. 257) приняты.", " ", "Возьмите билет."], ["«Кто подписал акт? Я не помню», – ответил свидетель.", " ", "Срок истёк!"],
        ["Судья спросил: «Вы согласны?»", " ", "На вопрос суда он ответил."], ["16. Взыскать 284 тг. и пошлину.", " ", "17. Отдать чек."], ["Явились С. Г. Дорлусов и т.д.", " ", "Возьмите чек."],
        ["Сайт zan.example указан в п. 16.4 договора.", "По договору 5."], ["2013 ж. 5 қаңтардағы шешім күшінде.", " ", "Сот не шешті?!"], ["买方共支付58.5万元。", "法院认为“银行对账单”已经送达。"],
        ["Dr. L. Gerson and Mr. Dolan agreed at 5 p.m. sharp.", " ", "Why so late?!"], ["Дело по ул. Ивовой, д. 396.", " ", "Сумма 5 тенге."], ["Пишите просто.", "  ", "мы ждём вас утром."],
        ["Долг выплачен и.о. директора АО «Тас» полностью.", "\n", "Без точки"], ["См. прил. 20 к акту от 12.05.2023 г. о приёмке.", " ", "В 2022 г. договор расторгли…", " ", "Да."], ["دفع المدعي مبلغ 16.5 ألف؛ وأرفق قائمة!", " ", "لماذا؟"],
    ],
)
def test_cases(parts):
    text, want = "".join(parts), []
    at = 0
    for i, p in enumerate(parts):
        if p.strip():
            want.append((at, at + len(p)))
        at += len(p)
    assert [text[s:e] for s, e in sentence_offsets(text)] == [text[s:e] for s, e in want]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="Аб1 .!?…«»\"()\n。-", max_size=80))
def test_cover_everything_but_white_space(text):
    spans = sentence_offsets(text)
    covered = set()
    for s, e in spans:
        assert s < e and not text[s].isspace() and not text[e - 1].isspace() and "\n" not in text[s:e]
        assert not covered & set(range(s, e))
        covered |= set(range(s, e))
    assert all(c.isspace() for i, c in enumerate(text) if i not in covered)


def test_table(spark):
    rows = [(1, "Да. Нет.", 5), (1, "Да. Нет.", 5), (2, None, 1), (3, "", 1), (4, "42", 1), (5, "ст. " * 50_000, 1), (6, "🙂 Да. Нет.", 1)]
    df = spark.createDataFrame(rows, "para_id bigint, text string, start_pos int")
    out = [tuple(r) for r in split_sentences(distinct_texts(df)).orderBy("para_id", "start_pos").collect()]
    assert out == [(1, 0, 3), (1, 4, 8), (5, 0, 199_999), (6, 0, 5), (6, 6, 10)]
    assert split_sentences(df.limit(0)).count() == 0


def test_hostile_brackets_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        S.sentence_offsets("(" * n + "а" + "]" * n + ". Да.")
        return time.perf_counter() - began

    assert min(seconds(80_000) for _ in range(3)) < 16 * max(min(seconds(10_000) for _ in range(3)), 0.005)


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, "Суд решил. Иск подан."), (1, "Суд решил. Иск подан."), (2, None), (2, "Да."), (3, ""), (4, "12"), (None, "Да."), (5, "а. «б [в) г»! Да")], "para_id bigint, text string")
    once = df.distinct()
    got = sorted(map(tuple, S.distinct_sentences(df).collect()), key=repr)
    assert got == sorted(map(tuple, S.split_sentences(once).collect()), key=repr) and len([g for g in got if g[0] == 1]) == 2
    assert S.distinct_sentences(df.limit(0)).count() == 0
