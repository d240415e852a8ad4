import pytest
from pyspark.sql import functions as F

from lexisteppe.llm import canonical as C


def test_mapped():
    assert C.mapped("cчёт") == "счёт" and C.mapped("\uff12\uff10") == "20" and C.mapped("второи\u0306") == "второй"
    assert C.mapped("су\u200bд") == "суд" and C.mapped("и\u202fне") == "и не" and C.mapped("н\u03bfтариус") == "нотариус"
    assert C.mapped("XIV") == "XIV" and C.mapped("Wi-Fi") == "Wi-Fi" and C.mapped("zan.example") == "zan.example" and C.mapped("№½²…") == "№½²…"
    assert C.mapped("pаss") == "pass"


@pytest.fixture
def texts(spark):
    rows = [
        (1, "Ответчик ТОО «Тас» и ТОО «Дала»"), (2, "Ответчик TOO «Тас»"), (3, "cуд решил"), (4, "суд решил"), (5, "IT-компания и Wi-Fi, глава XIV"), (6, "№ 12 м² ½ …"), (7, None), (8, ""),
        (9, "合同，约定。“货物”"), (10, "по\u00a0делу"), (2, "Ответчик TOO «Тас»"), (11, "слово\tи\nещё"), (12, "دفع؛ المشتري"), (13, "я" * 100_000),
    ]
    return spark.createDataFrame([(i, t, "t") for i, t in rows], "row_id bigint, text string, token string")


def test_rows(texts):
    assert sorted(r.row_id for r in C.lookalike_rows(texts, ["row_id"]).collect()) == [2, 3, 10]


def test_one_form(texts):
    forms = {r.row_id: r.canonical for r in C.in_one_form(texts, ["row_id"]).collect()}
    assert forms[2] == "Ответчик ТОО «Тас»" and forms[3] == forms[4] == "суд решил" and forms[10] == "по делу" and forms[7] is None and forms[8] == "" and forms[11] == "слово\tи\nещё"


def test_canonical_member_may_be_in_no_text(spark):
    df = spark.createDataFrame([(1, "нeкий"), (2, "неки\u0306")], "row_id bigint, text string")
    assert {r.token: r.canonical for r in C.canonical_members(df).collect()}["нeкий"] == "некий"


def test_empty(spark):
    assert C.lookalike_rows(spark.createDataFrame([], "row_id bigint, text string"), ["row_id"]).count() == 0


def test_wider_look_alikes():
    assert C.mapped("\U0001d412\U0001d42e\U0001d41d") == "Sud" and C.mapped("\ufb01rm") == "firm" and C.mapped("c\u13e2ок") == "сРок" and C.mapped("\u13aa\u13ac") == "\u13aa\u13ac"
    assert C.mapped("суд\ufe0f") == C.mapped("су\x07д") == "суд" and C.mapped("\u212b") == "\u00c5"
    assert C.odd("су\u200bдебный") == 1 and C.odd("cуд\u200bья") == 2 and C.odd("второи\u0306") == 1 and C.odd("ﬁrm") == 1 and C.odd("№½²…，。") == 0


def test_whatever_is_mapped_is_suspect(spark):
    """The quick test in Java holds for every character that the mapping changes, beside Cyrillic and beside Latin letters."""
    chars = {*C.IGNORABLE, *C.FORMS, *C.UNCOMPOSED, *C.RARE, *map(chr, range(0x80, 0x3000)), *C.LATIN, *C.GREEK}
    tokens = [t for c in sorted(chars) for t in (f"а{c}", f"{c}x", f"д{c}м") if not c.isspace() and C.mapped(t) != t]
    missed = spark.createDataFrame([(t,) for t in tokens], "token string").where(~F.col("token").rlike(C.SUSPECT)).collect()
    assert len(tokens) > 3_000 and not missed


def test_classes_of_the_collation(spark):
    """Whatever the collation takes as equal has one canonical member, the one without odd characters."""
    rows = [(1, "суд"), (2, "су\x07д"), (3, "суд\ufe0f"), (4, "c\u0443д"), (5, "\u212bland"), (6, "\u00c5land"), (7, "Суд"), (8, "сүд")]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    assert {r.row_id: r.canonical for r in C.in_one_form(df, ["row_id"]).collect()} == {1: "суд", 2: "суд", 3: "суд", 4: "суд", 5: "\u00c5land", 6: "\u00c5land", 7: "Суд", 8: "сүд"}
    assert sorted(r.row_id for r in C.lookalike_rows(df, ["row_id"]).collect()) == [2, 3, 4, 5]


def test_repeated_keys_keep_their_own_texts(spark):
    df = spark.createDataFrame([(1, "cуд"), (1, "иcк"), (1, "иcк"), (None, "иcк"), (2, None)], "row_id bigint, text string")
    assert sorted(map(repr, C.in_one_form(df, ["row_id"]).collect())) == sorted(map(repr, spark.createDataFrame([(1, "суд"), (1, "иск"), (1, "иск"), (None, "иск"), (2, None)], "row_id bigint, canonical string").collect()))
