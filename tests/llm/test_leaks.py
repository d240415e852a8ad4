import random

from lexisteppe.llm import leaks as L

WORDS = "ювелир аквалангист гобелен оленем шарманку поезд маяка фонтан мраморный накануне карнавала чертежи перепутал застраховал племянника сапожник витраж канделябр сургуч телескоп обсерватория медведь балалайка самовар виноград ледник".split()


def _item(seed, n=60):
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "у", "ом"]) for _ in range(n)]


def _found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    return {tuple(r) for r in L.leaks(d, i, **kw).collect()}


def test_whole_part_lossy_and_short(spark):
    a, b = _item(1), _item(2)
    lossy = [w for i, w in enumerate(a[10:46]) if i % 7 != 3]
    wrong = [w if i % 3 else "иное" for i, w in enumerate(b[5:45])]
    docs = [
        (1, "Суд указал. " + ", ".join(a).upper(), None), (2, "\n".join(a[20:38]), None), (3, " ".join(lossy), None), (4, " ".join(a[20:33]), None), (5, " ".join(wrong), None),
        (6, None, None), (7, "", None), (8, " ".join(b[:9] + ["суд"] * 30 + b[30:39]), None), (9, "слово " * 100_000 + " ".join(b), None), (2, "\n".join(a[20:38]), None),
    ]
    items = [(1, " ".join(a), None), (2, " ".join(b), None), (2, " ".join(b), None), (3, None, None), (4, "", None), (None, "x", None)]
    want = {(1, 1), (1, 2), (1, 3), (2, 9)}
    assert _found(spark, docs, items) == want
    assert _found(spark, [], items) == set() and _found(spark, docs, []) == set()


def test_tiles_against_brute_force():
    r = random.Random(5)
    for _ in range(200):
        a, b = [r.randrange(4) for _ in range(r.randrange(1, 25))], [r.randrange(4) for _ in range(r.randrange(1, 25))]
        tiles = L.tiles(a, b, least=2)
        assert all(a[d : d + k] == b[i : i + k] and k >= 2 for d, i, k in tiles)
        for side in (0, 1):
            marks = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(marks) == len(set(marks))
        longest = max((k for d in range(len(a)) for i in range(len(b)) for k in range(1, 1 + min(len(a) - d, len(b) - i)) if a[d : d + k] == b[i : i + k]), default=0)
        assert longest < 2 or max(t[2] for t in tiles) == longest


def _compared(doc, item, least=18, lost=1 / 6, threshold=0.5):
    size, _ = L.seed_rule(least, lost)
    known = L.Item(" ".join(item), size)
    return L.compared([known.numbers.get(w, 0) for w in doc], known, size, least, lost, threshold)


def test_every_passage_has_its_seeds_by_brute_force():
    """All ways of losing one word in six of 18 to 25 words leave as many seeds as the rule says, and some leave no more."""
    from itertools import combinations

    size, shared = L.seed_rule()
    fewest = 99
    for n in range(18, 26):
        for gone in combinations(range(n), n // 6):
            edges = [-1, *gone, n]
            fewest = min(fewest, sum(max(0, b - a - size) for a, b in zip(edges, edges[1:], strict=False)))
    assert (size, shared) == (4, 3) and fewest == shared


def test_planted_passages_are_found():
    """Words replaced or lost anywhere, one in six at most: always a passage; the same with two words more lost never."""
    r = random.Random(3)
    item = [f"слово{i}" for i in range(70)]
    for _ in range(400):
        n = r.randrange(18, 60)
        at = r.randrange(0, 70 - n)
        gone = set(r.sample(range(n), n // 6))
        replaced = r.random() < 0.5
        kept = [(f"иное{i}" if replaced else None) if i in gone else w for i, w in enumerate(item[at : at + n])]
        doc = ["до"] * 30 + [w for w in kept if w] + ["после"] * 30
        assert _compared(doc, item)[1], (n, sorted(gone), replaced)
    for n in (18, 19, 20):
        for gone in ({2, 5, 8}, {1, 7, 13}, {3, 4, 5}):
            assert _compared(["x", *(f"y{i}" if i in gone else w for i, w in enumerate(item[:n])), "z"], item)[1]
        assert not _compared(["x", *(f"y{i}" if i in {2, 5, 8, 11, 14} else w for i, w in enumerate(item[:n])), "z"], item)[1]
    assert not _compared(["x", *item[:14], "z"], item)[1]  # of 18 words four are lost


def test_coverage_of_reordered_passages(spark):
    item = _item(7, 60)
    other = _item(8, 60)
    tens = [w for k in range(50, -1, -10) for w in item[k : k + 10]]
    d = spark.createDataFrame([(1, " ".join(tens)), (2, " ".join(item)), (3, " ".join(item[:10])), (4, " ".join(other[:30])), (4, " ".join(other[:30]))], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id bigint, text string")
    rows = {(r.item_id, r.doc_id): (r.words, r.covered, r.coverage, r.passage) for r in L.coverage(d, i).collect()}
    assert rows == {(1, 1): (60, 60, 1.0, False), (1, 2): (60, 60, 1.0, True), (2, 4): (60, 30, 0.5, True)}


def test_scripts_without_spaces(spark):
    text = "甲公司于二零一九年三月向乙公司出售一批货物并约定在十日内付清全部价款"
    assert _found(spark, [(1, "法院认为：" + text[:25], None), (2, text[:13], None)], [(1, text, None)]) == {(1, 1)}


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("lexisteppe.runtime.is_small", lambda *_: False)
    a = _item(1)
    assert _found(spark, [(1, " ".join(a), None), (2, " ".join(a[20:38]), None), (3, "нет", None)], [(1, " ".join(a), None), (2, " ".join(_item(2)), None)]) == {(1, 1), (1, 2)}
