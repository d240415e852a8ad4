from lexisteppe.llm import names as N

ROWS = [(1, "person", "Техебкев Дмитрий Нурланович"), (2, "person", "Бақтожмов Иван Иванович"), (3, "organisation", "ТОО «Степномаш Транзит Авто»"), (4, "organisation", "АО «Тұлпарлы Фарм»"), (5, "organisation", "ТОО «Степномаш Фарм»")]
SHORT = [(1, "person", "Ким Мария Алексеевна"), (2, "person", "Орлов Павел Иванович"), (3, "organisation", "ТОО «Степномаш»"), (4, "person", "Ю Павел Олегович")]
MENTIONS = [
        ("явился Техебкев Дмитрий Нурланович, вопросов", set()), ("явился Дмитрий Нурланович Техебкев.", {1}), ("дал Техебкев Д.Н., расчёт", {1}), ("дал Д. Н. Техебкев, расчёт", {1}),
        ("сдал Дима Техебкев", {1}), ("сдал Техебкев, Дмитрий, опись", {1}), ("сдал Техеббкев Д.Н.", {1}), ("явился Техебкев Марат", set()), ("явился Техебкев Дмитрий Маратович", set()),
        ("ТЕХЕБКЕВ Дмитрий", {1}), ("Dmitriy Tekhebkev appeared", {1}), ("Бактожмов И.И.", {2}), ("Дмитрий Техекбева", {1}), ("Дмитрий Тукекбева", set()), ("Техекбева Д.Н.", set()), ("ТОО «Степномаш Транзит Авто» и", set()), ("ТОО \"Степномаш Транзит Авто\"", {3}),
        ("«Степномаш Транзит Авто» ТОО", {3}), ("АО «Степномаш-ТранзитАвто»", {3}), ("Stepnomash Tranzit Avto LLP", {3}), ("ТОО «СТА»", {3}), ("АО «Фарм Тұлпарлы»", {4}), ("ао «ТҰЛПАРЛЫ ФАРМ»", {4}),
        ("Товарищество с ограниченной ответственностью «Степномаш Фарм»", {5}), ("ТОО «Степномаш Жол»", set()), ("ТОО «Степомаш Фарм»", {5}), ("TOO «Степномаш Фарм»", {5}), ("", set()), ("Техебкев", set()),
]
SHORT_MENTIONS = [
        ("явился Мария Ким, вопросов", {1}), ("дал Ким М.А., расчёт", {1}), ("явилась Маша Ким", {1}), ("Кин Мария", {1}), ("Кин М.А.", set()), ("явилась Ким Мария Алексеевна", set()), ("Ким", set()),
        ("дал Орлов П.И.", {2}), ("дал Орллов П.И.", {2}), ("дал Оролв Павел", {2}), ("дал Оллово П.И.", set()), ("явился Павел Ю", {4}), ("явился П. Ю", set()), ("Ю П.", set()),
        ("газета «Степномаш» вышла", {3}), ("Степномаш ТОО", {3}), ("ТОО Степномаш обязано", {3}), ("ТОО «Степномаш» и", set()), ("ТОО «Степномаш Жол»", set()), ("ТОО Степномаш Жол", set()), ("Директор Степномаш Жол", set()),
        ("завод Степномаш стоит", set()), ("Степномаш аорта", set()), ("Stepnomash LLP", {3}),
]


def _registry(spark, rows):
    return spark.createDataFrame(rows, "entity_id bigint, kind string, name string")


def _scores(spark, rows, texts):
    """{row: {entity: score}} of texts numbered from 0."""
    table = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string")
    out: dict = {}
    for r in N.links(table, _registry(spark, rows), ["row_id"]).collect():
        out.setdefault(r.row_id, {})[r.entity_id] = r.score
    return out


def _check(spark, rows, cases):
    found = _scores(spark, rows, [t for t, _ in cases])
    wrong = [(t, want, found.get(i)) for i, (t, want) in enumerate(cases) if {e for e, score in found.get(i, {}).items() if score == 1} != want]
    assert not wrong, wrong


def test_mentions(spark):
    _check(spark, ROWS, MENTIONS)


def test_short_names(spark):
    _check(spark, SHORT, SHORT_MENTIONS)


def test_shared_rewritings_are_scored_by_their_rarity(spark):
    """Two entities far apart in the registry share a rewriting: whatever else is registered, it is worth a half."""
    rows = [*ROWS, (6, "person", "Техебкев Данияр Нурланович"), *[(100 + i, "organisation", f"ТОО «Завод {'абвгдежзик'[i]}{'лмнопрстуф'[i]}ртек»") for i in range(10)], (900, "person", "Бақтожмов Ильяс Ильич")]
    found = _scores(spark, rows, ["Техебкев Д.Н.", "Техебкев Данияр", "Бактожмов И.И.", "дал Бақтожмов Ильяс"])
    assert found == {0: {1: 0.5}, 1: {6: 1.0}, 2: {2: 0.5}, 3: {900: 1.0}}
    members = {(r.form, r.entity_id) for r in N.rewritings_of(_registry(spark, rows)).where("form = 'person бактожмов и и'").collect()}
    assert {i for _, i in members} == {2, 900}


def test_equal_names_and_repeated_rows(spark):
    """Two entities of one registered name: the name itself is no variant, a variant is worth a half; a repeated row counts once."""
    rows = [(1, "person", "Техебкев Дмитрий Нурланович"), (2, "person", "Техебкев Дмитрий Нурланович"), (3, "person", "Орлов Павел Иванович"), (3, "person", "Орлов Павел Иванович")]
    assert _scores(spark, rows, ["Техебкев Дмитрий Нурланович", "Техебкев Дмитрий", "дал Орлов П.И.", "дал Орлов Павел Иванович и Орлов П."]) == {1: {1: 0.5}, 2: {3: 1.0}, 3: {3: 1.0}}


def test_link(spark):
    texts = spark.createDataFrame([("d", 1, "Дима Техебкев", "x"), ("d", 1, "Дима Техебкев", "x"), ("d", 2, None, "x"), ("p", 3, "", "x"), ("p", 4, "ТОО «СТА»\n" + "x" * 100_000, None)], "tbl string, row_id bigint, text string, name string")
    registry = _registry(spark, [*ROWS, (7, None, None), (None, "person", "А Б")])
    want = {("d", 1, 1), ("p", 4, 3)}
    assert {tuple(r) for r in N.link(texts, registry, ["tbl", "row_id"]).collect()} == want
    assert N.link(texts, registry.limit(0), ["tbl", "row_id"]).count() == 0 and N.link(texts.limit(0), registry, ["tbl", "row_id"]).count() == 0


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    """The same links where nothing is small enough to be broadcast."""
    monkeypatch.setattr("lexisteppe.runtime.is_small", lambda *_: False)
    monkeypatch.setattr(N, "is_small", lambda *_: False)
    _check(spark, ROWS, MENTIONS)


def test_nearest_words_against_brute_force(spark):
    listed = ["Бекабжбаев", "Бекабжбеков", "Мукапчбаев", "Жопыхмев"]
    typed = ["Бекабжбаев", "Бекажбаев", "Бекбажбаев", "Жопхымев", "Жопыхммев", "Мукапчбавв", "Сулдашин", "Мукапчбаева"]
    words = spark.createDataFrame([(w.lower(),) for w in typed], "word string")
    registry = _registry(spark, [(i, "person", f"{w} Павел") for i, w in enumerate(listed)])
    got = {r.word: (r.canonical, r.missed) for r in N.meant_words(words, registry).where("role = 'surname'").collect()}
    for w in typed:
        near = sorted((N.slips(N.fold(w), N.fold(x)), N.fold(x)) for x in listed)
        want = (near[0][1], near[0][0]) if near[0][0] <= 2 and near[0][0] < near[1][0] else None
        assert got.get(w.lower()) == want


def test_disguised_characters(spark):
    _check(spark, ROWS, [("Тех\u200bебкев Дмитрий", {1}), ("Teхебкев Дмитрий Нурланович", {1}), ("и ТОО\u00a0«Степномаш Фарм»", {5}), ("Техебкев Дмитрий Нурланович", set())])
