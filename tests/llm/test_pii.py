import pytest

from lexisteppe.llm import pii as P

TEXT = """Дело № 6: истец – Тимур Сулнигбеков.
Телефон для извещений +7 (798) 124-87-43.
Проверены данные стороны: ИИН 741104706117, лист дела 13.
Почта для связи – sopnul.gil (at) yurist.test, ответ в течение 3 дней.
Проживает по адресу: г. Новолуговск, ул. Дорохвалова, д. 21, кв. 93.
БИН 850440146811, счёт KZ00TEST850440146811, сумма 7 390 700,90 тенге.
Партия 8 6055 47 47 принята на склад.
Код @1756 указан на складской бирке.
Компания «Гошанов Торг» спора не признала, сверка № 2172.
Личность установлена, паспорт серии N № 25636102.
Жеке басы анықталды, ДИННУЛИН Павел, паспорты N12500516.
Call Mr. Aleksandr Nadgudenov, +77941185328 after 8 hours."""
REDACTED = """Дело № 6: истец – [NAME].
Телефон для извещений [PHONE].
Проверены данные стороны: ИИН [ID_NUMBER], лист дела 13.
Почта для связи – [EMAIL], ответ в течение 3 дней.
Проживает по адресу: [ADDRESS].
БИН 850440146811, счёт KZ00TEST850440146811, сумма 7 390 700,90 тенге.
Партия 8 6055 47 47 принята на склад.
Код @1756 указан на складской бирке.
Компания «Гошанов Торг» спора не признала, сверка № 2172.
Личность установлена, паспорт серии [ID_NUMBER].
Жеке басы анықталды, [NAME], паспорты [ID_NUMBER].
Call Mr. [NAME], [PHONE] after 8 hours."""
WANT = {(0, "name"), (1, "phone"), (2, "id_number"), (3, "email"), (4, "address"), (9, "id_number"), (10, "name"), (10, "id_number"), (11, "name"), (11, "phone")}


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")


def test_found_and_redacted(spark):
    docs = _docs(spark, [TEXT] * 20 + [None, "", "слово " * 100_000, "\n\n"])
    found = P.spans(docs)
    rows = found.select("doc_id", "line_no", "kind").distinct().collect()
    assert {(r.line_no, r.kind) for r in rows if r.doc_id == 3} == WANT and len(rows) == 20 * len(WANT)
    out = {r.doc_id: r.text for r in P.redacted(docs).collect()}
    assert out[0] == REDACTED and len({out[i] for i in range(20)}) == 1
    assert out[20] is None and out[21] == "" and out[22] == "слово " * 100_000 and out[23] == "\n\n"


def test_empty(spark):
    docs = _docs(spark, [])
    assert P.spans(docs).count() == 0 and P.redacted(docs).count() == 0
    assert P.spans(_docs(spark, [None, "", "42"])).count() == 0


def test_estimate_learns_a_useless_labeler():
    """A labeler that votes at random gets no say; the other decides."""
    patterns = [("name", (a, b), (0, 0), 100) for a in (1, -1) for b in (1, -1)] + [("name", (1, 0), (0, 0), 300), ("name", (-1, 0), (0, 0), 300)]
    p = P.estimate(patterns)
    assert all((v > 0.5) == (k[1][0] > 0) for k, v in p.items())


@pytest.mark.parametrize("text", ["+7.795.734.11.45", "8 792 911 45 67", "356-62-34", "87985307597"])
def test_phone_shapes(text):
    found = [c for c in P.candidates(f"Извещён звонком на номер {text} (дом.), ответил") if c[2] == "phone"]
    assert len(found) == 1 and found[0][3][0] == 1


@pytest.mark.parametrize(
    ("line", "hidden"),
    [
        ("Проживает по адресу: г. Новолуговск, ул. Дорохвалова, д. 21, кв. 93; прежде г. Степногорск, ул. Аксуйская, д. 48, кв. 1506.", ["Дорохвалова", "Аксуйская", "1506"]),
        ("Проживает: ул. Дорохвалова, д. 21, " + "по словам соседей весьма давно, " * 4 + "зарегистрирован по ул. Аксуйская, д. 48.", ["Дорохвалова", "Аксуйская", "48"]),
        ("The Court found that the claimant, who appeared in person and gave evidence, resides in Akdolsk, 48 Abai Street, flat 7.", ["Abai", "flat 7"]),
        ("The court found that the claimant, who appeared in person and gave evidence, resides in Akdolsk, 48 Abai Street, flat 7.", ["Abai", "flat 7"]),
    ],
)
def test_several_addresses_in_a_line(spark, line, hidden):
    docs = _docs(spark, [TEXT + "\n" + line] * 20)
    found = P.spans(docs)
    assert found.where("line_no = 12 and kind = 'address' and doc_id = 3").count() >= 1
    out = P.redacted(docs).where("doc_id = 3").first().text.split("\n")[12]
    assert not [h for h in hidden if h in out], out


def test_overlapping_spans_leave_nothing_readable():
    assert P.replaced("ab cdefgh ij", [(3, 6, "address"), (5, 9, "phone"), (4, 5, "name")]) == "ab [ADDRESS] ij"
    assert P.replaced("ab cd", [(0, 2, "name"), (0, 1, "email")]) == "[NAME] cd" and P.replaced("ab", []) == "ab"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Проживает по адресу: г. Новолуговск, ул. Дорохвалова, д. 21, кв. 93; прежде г. Степногорск, ул. Аксуйская, д. 48, кв. 1506.\r", "Проживает по адресу: [ADDRESS]; прежде [ADDRESS].\r"),
        ("Проживает: ул. Дорохвалова 21-3, по словам соседей давно, зарегистрирован по мкр. Самал, 48.", "Проживает: [ADDRESS], по словам соседей давно, зарегистрирован по [ADDRESS]."),
        ("Повестка вручена: Назгилбаев В.И., Ақсеңгір, улица Мельничная, дом 14", "Повестка вручена: [NAME], [ADDRESS]"),
        ("Тұратын мекенжайы: Светлана Нолсегова, Сарыбидай қаласы, Қамысты көшесі, 172-үй, 68-пәтер.", "Тұратын мекенжайы: [NAME], [ADDRESS]."),
        ("Шақыру қағазы табысталды: Самал көшесіндегі 31-үй", "Шақыру қағазы табысталды: [ADDRESS]"), ("Вещи хранились по месту жительства: пр-т Ивовая, 69/19, второй подъезд.", "Вещи хранились по месту жительства: [ADDRESS], второй подъезд."),
        ("Served at G. Sigsimov, Flat 117, 125 Windy Hill Drive, Aqsenggir", "Served at [NAME], [ADDRESS]"), ("Lives at Vladimir Negnegenov, 15 Cranefield Avenue, flat 82.", "Lives at [NAME], [ADDRESS]."),
        ("Явились Иванов Иван Иванович, Петров Пётр Петрович и Сидорова Анна.", "Явились [NAME], [NAME] и [NAME]."), ("Иванова-Петрова Анна Сергеевна подала иск", "[NAME] подала иск"),
        ("Почта: " + "a" * 200 + "@" + "b" * 200 + ".kz, ответ", "Почта: [EMAIL], ответ"), ("писать на имя.отдел (собака) почта (точка) kz сегодня", "писать на [EMAIL] сегодня"),
    ],
)
def test_exact_spans(line, want):
    assert P.replaced(line, [c[:3] for c in P.candidates(line)]) == want


def test_no_span_ends_inside_a_word(spark):
    """Over all documents of the smallest data: no address, name or e-mail is cut, none takes a line's end, and what is not named stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found: dict = {}
    for r in P.spans(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.kind))
        text, s, e = texts[r.doc_id], r.start_pos, r.end_pos
        assert not {"\r", "\n"} & set(text[s:e]) and text[s:e] == text[s:e].strip()
        if r.kind in ("address", "name", "email"):
            assert not (text[s - 1 : s].isalnum() and text[s].isalnum()) and not (text[e - 1].isalnum() and text[e : e + 1].isalnum())
    for r in P.redacted(docs).collect():
        assert r.text == (texts[r.doc_id] and P.replaced(texts[r.doc_id], found.get(r.doc_id, [])))
    assert len(found) > 20


def test_the_court_behind_an_address_is_no_address():
    found = [c for c in P.candidates("Resides in Akdolsk, 48 Abai Street, and told the court so; before, 5 abbey close") if c[2] == "address"]
    assert [c[3][1] for c in found] == [1, -1, 1]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ИИН 741104706117 12.05.2024 выдан", {"741104706117"}), ("ИИН 741104706117 8 792 911 45 67, ответил", {"741104706117", "8 792 911 45 67"}), ("ИИН 741104706117 +7 (798) 124-87-43.", {"741104706117", "+7 (798) 124-87-43"}),
        ("тел. +7 795 734 11 45 8 792 911 45 67 741104706117", {"+7 795 734 11 45", "8 792 911 45 67", "741104706117"}), ("счёт 4400 4301 2345 6789", set()), ("тел. 87985307597", {"87985307597"}),
    ],
)
def test_numbers_side_by_side(text, want):
    assert {text[c[0] : c[1]] for c in P.candidates(text) if c[2] in ("phone", "id_number")} == want
