from lexisteppe.llm import reading as R

EASY = "Дом стоит. Идите в суд. Возьмите чек. "
MIDDLE = "Суд указал, что стороны не согласовали порядок приёмки товара. "
HARD = "Принимая во внимание, что срок исковой давности не пропущен и что перевозчик не подтвердил страховой полис по месту нахождения склада, коллегия приходит к выводу о том, что обязательство исполнено лишь частично. "


def _tables(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, grade string"),
        spark.createDataFrame(labels, "label_id bigint, doc_id bigint, rater string, grade int, text string"),
    )


def test_levels_follow_sentences(spark):
    docs = [(i, (EASY, MIDDLE, HARD)[i % 3] * 20, None) for i in range(30)] + [(100, "Коротко.", None), (101, None, None), (102, "", None), (103, "合同约定。" * 200, None)]
    labels = [(i, i, "a", (1, 3, 5)[i % 3], None) for i in range(12)] * 2 + [(50, 3, "b", None, None), (51, None, "b", 3, None)]
    found = {r.doc_id: r.level for r in R.levels(*_tables(spark, docs, labels)).collect()}
    assert found == {i: ("easy", "middle", "hard")[i % 3] for i in range(30)}


def test_default_weights_without_labels(spark):
    docs = [(0, EASY * 20, None), (1, HARD * 10, None)]
    found = {r.doc_id: r.level for r in R.levels(*_tables(spark, docs, [])).collect()}
    assert found == {0: "easy", 1: "hard"}


def test_empty(spark):
    assert R.levels(*_tables(spark, [], [])).count() == 0


def test_familiar_words_by_document_frequency(spark):
    docs, _ = _tables(spark, [(i, "Суд суд " + ("иск" if i < 2 else ""), None) for i in range(10)], [])
    assert R.familiar_words(docs, 0.5) == {"суд"} and R.familiar_words(docs, 0.2) == {"суд", "иск"}
