from collections import defaultdict

from lexisteppe.llm import boilerplate as B

LINE = "Подпишитесь на рассылку портала"
OTHER = "Копия верна, отдел архива суда"


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, items string, kind string")


def _acts(spark, rows):
    return spark.createDataFrame(rows, "act_id bigint, doc_id bigint, court string, groups string")


def test_threshold_case_and_signs(spark):
    rows = [(i, f"{'*** ' if i % 2 else ''}{LINE.upper() if i % 3 else LINE}!\nслово номер {i}", "a", None, None) for i in range(5)]
    rows += [(10 + i, f"{OTHER}", "b", None, None) for i in range(4)]
    found = {tuple(r) for r in B.repeated_lines(_docs(spark, rows), _acts(spark, [])).collect()}
    assert found == {(i, 0) for i in range(5)}


def test_share_counts_documents_without_text(spark):
    rows = [(i, LINE, "a", None, None) for i in range(5)] + [(100 + i, None, "a", None, None) for i in range(96)]
    assert B.repeated_lines(_docs(spark, rows), _acts(spark, [])).count() == 0
    assert B.repeated_lines(_docs(spark, rows[:-1]), _acts(spark, [])).count() == 5


def test_courts_differ_in_case_and_space_and_repeated_acts(spark):
    rows = [(i, OTHER, f"s{i}", None, None) for i in range(5)]
    acts = [(i, i, "Суд  Ақдол" if i % 2 else "суд ақдол ", None) for i in range(5)] * 2 + [(9, None, "x", None), (8, 3, None, None)]
    assert B.repeated_lines(_docs(spark, rows), _acts(spark, acts)).count() == 5


def test_edges(spark):
    assert B.repeated_lines(_docs(spark, []), _acts(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None), (None, LINE, None, None, None), (3, "\n\n", "a", None, None), (4, "ы" * 200_000, "a", None, None)]
    assert B.repeated_lines(_docs(spark, rows), _acts(spark, [])).count() == 0
    kept = {r.doc_id: r.text for r in B.without_lines(_docs(spark, rows), spark.createDataFrame([(3, 1)], "doc_id bigint, line_no int")).collect()}
    assert kept[1] is None and kept[2] == "" and kept[3] == "\n" and len(kept[4]) == 200_000


def test_sequences_against_brute_force(spark):
    a, b, c = (f"строка {x * 25}" for x in "абв")
    texts = ["\n".join(x) for x in ([a, b, c], [a, b], [b, a, c], [a, c, b], [a, b, a], [c])]
    rows = [(i, t, "s", None, None) for i, t in enumerate(texts)]
    found = B.frequent_sequences(_docs(spark, rows), _acts(spark, []), max_length=3, min_docs=2).collect()
    names = {}
    single = {r.pattern[0]: r.docs for r in found if len(r.pattern) == 1}
    assert sorted(single.values()) == [4, 5, 5]
    support = defaultdict(int)
    for t in texts:
        lines, subs = t.split("\n"), set()
        for mask in range(1, 1 << len(lines)):
            subs.add(tuple(x for i, x in enumerate(lines) if mask >> i & 1))
        for s in subs:
            if len(s) <= 3:
                support[s] += 1
    assert sorted(n for n in support.values() if n >= 2) == sorted(r.docs for r in found), names


def test_sequences_of_any_length(spark):
    notice = "\n".join(f"строка {x * 25}" for x in "абвгд")
    rows = [(i, f"слово {i}\n{notice}", "s", None, None) for i in range(5)]
    found = B.frequent_sequences(_docs(spark, rows), _acts(spark, [])).collect()
    assert sorted(len(r.pattern) for r in found) == [1] * 5 + [2] * 10 + [3] * 10 + [4] * 5 + [5] and {r.docs for r in found} == {5}
    assert max(len(r.pattern) for r in B.frequent_sequences(_docs(spark, rows), _acts(spark, []), max_length=2).collect()) == 2


def test_sequences_without_gaps_against_brute_force(spark):
    """Rows of frequent lines only, at most one gap between neighbours; copies weigh as much as they are."""
    a, b, c, d = (f"строка {x * 25}" for x in "абвг")
    texts = ["\n".join(x) for x in ([a, b, c, d], [a, b, c, d], [a, "иное", b, d], [b, c, a, b], [d, c, b, a], [c])]
    docs = _docs(spark, [(i, t, "s", None, None) for i, t in enumerate(texts)])
    for gap in (0, 1, None):
        support = defaultdict(int)
        for t in texts:
            lines = [x for x in t.split("\n") if len(x) > 20]
            subs = set()
            for mask in range(1, 1 << len(lines)):
                at = [i for i in range(len(lines)) if mask >> i & 1]
                if gap is None or all(y - x <= gap + 1 for x, y in zip(at, at[1:], strict=False)):
                    subs.add(tuple(lines[i] for i in at))
            for s in subs:
                support[s] += 1
        found = B.frequent_sequences(docs, _acts(spark, []), min_docs=2, max_gap=gap).collect()
        assert sorted((len(k), n) for k, n in support.items() if n >= 2) == sorted((len(r.pattern), r.docs) for r in found), gap


def test_a_long_notice_is_mined_without_its_subsets(spark):
    notice = "\n".join(f"строка {chr(0x430 + i) * 25}" for i in range(12))
    docs = _docs(spark, [(i, f"слово {i}\n{notice}\nконец {i}", "s", None, None) for i in range(5)])
    found = B.frequent_sequences(docs, _acts(spark, []), max_gap=0).collect()
    assert sorted(len(r.pattern) for r in found) == sorted(n for n in range(1, 13) for _ in range(13 - n))
    assert {tuple(r) for r in B.repeated_lines(docs, _acts(spark, [])).collect()} == {(i, n) for i in range(5) for n in range(1, 13)}
