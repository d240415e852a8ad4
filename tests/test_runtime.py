import pytest
from pyspark.sql import functions as F

from lexisteppe import runtime as R
from lexisteppe.operators import corpus
from lexisteppe.runtime import sized_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_sized_join_is_the_same_beyond_its_bound(spark, how):
    left = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(60)] + [(1, 1)] * 5, "i int, k int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (None, "d"), (9, "e")], "k int, v string")
    if how == "left_semi":
        right = right.select("k")
    small, large = (sorted(map(repr, sized_join(left, right, ["k"], how, most_bytes=n).collect())) for n in (1 << 20, 0))
    assert small == large and small


def test_noise_report_ties_nulls_and_empty(spark):
    schema = "file_id bigint, engine string, rule_id string, fragment string"
    rows = [(1, "lt", "X", "б"), (2, "lt", "X", "а"), (2, "lt", "X", "а"), (3, "rules", "Y", None), (1, "lt", "X", "в"), (1, "lt", "X", "г")]
    files = spark.createDataFrame([(1,), (2,), (3,), (3,)], "file_id bigint")
    out = {r.rule: tuple(r) for r in corpus.noise_report(spark.createDataFrame(rows, schema), files).collect()}
    assert out == {"lt:X": ("lt:X", 5, 2, 0.666667, True, "а; б; в"), "rules:Y": ("rules:Y", 1, 1, 0.333333, False, "")}
    assert corpus.noise_report(spark.createDataFrame([], schema), files).count() == 0


def test_corpus_words_names_and_samples(spark):
    docs = spark.createDataFrame(
        [(i, "Суд указал Ахметов прав. Ахметов ушёл. иск-отзыв", f"{'аб'[i % 2]}п-1.docx" if i else None) for i in range(6)] + [(7, None, "x"), (8, "", "y")], "doc_id bigint, text string, filename string"
    )
    acts = spark.createDataFrame([(1, 1, "Суд А"), (2, 1, "Суд А"), (3, 2, None)], "act_id bigint, doc_id bigint, court string")
    with_court = corpus.with_court(docs, acts)
    assert {r.doc_id: r.court for r in with_court.collect()} == {0: None, 1: "Суд А", 2: "АП", 3: "БП", 4: "АП", 5: "БП", 7: "", 8: ""}
    found = corpus.corpus_words(with_court)
    assert {r.word for r in corpus.lexicon_candidates(found, min_docs=6, min_courts=3).collect()} == {"указал", "прав", "ушёл", "иск-отзыв"}
    assert {(r.word, r.docs) for r in corpus.corpus_names(found).collect()} == {("Ахметов", 6)}
    assert [tuple(r) for r in corpus.stop_words(found, 2).collect()] == [("ахметов", 12), ("иск-отзыв", 6)]
    forms = spark.createDataFrame([("иск",), ("отзыв",)], "form string")
    assert [r.word for r in corpus.known_by_parts(found, forms).collect()] == ["иск-отзыв"]
    sample = corpus.stratified_sample(docs, {"ru": 2, "kk": 2}, "s", 0, 100).collect()
    assert len(sample) == 2 and {r.lang for r in sample} == {"ru"}
    plan = corpus.stratified_sample(docs, {"ru": 2, "kk": 3}, "s", 0, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") or plan.count("WindowGroupLimit") == 2  # cut before the exchange


def test_no_session_setting_changes_and_batches_are_cut(spark):
    import pyarrow as pa

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def kernel(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["n"])

    sizes = [r.n for r in R.arrow_map(spark.range(0, 1003, 1, 1), kernel, "n int", 10).collect()]
    assert sum(sizes) == 1003 and max(sizes) == 10 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    """Off local masters an unset spark.checkpoint.dir is an error, never a folder of one machine."""

    class Named:
        def __init__(self, **kw):
            self.__dict__.update(kw)

    context = Named(master="spark://host:7077", _jsc=Named(sc=lambda: Named(getCheckpointDir=lambda: Named(isEmpty=lambda: True))), getConf=lambda: {}, setCheckpointDir=lambda _: pytest.fail("set"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        R.checkpointed(Named(sparkSession=Named(sparkContext=context)))


def test_small_is_measured_in_bytes(spark):
    long = spark.createDataFrame([("x" * 5_000,)] * 3, "t string")
    assert R.is_small(long, 20_000) and not R.is_small(long, 10_000) and R.is_small(long.limit(0), 0) and not R.is_small(spark.range(1_000), 10_000)


def test_spread_runs_no_job(spark):
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        out = R.spread(df)
        assert not tracker.getJobIdsForGroup("spread")
        assert out.count() == 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
