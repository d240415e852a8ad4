from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisteppe.llm import terms as T


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, term string")


def test_counts_and_marks(spark):
    texts = ["Суд суд, СУД! м² ½", "суд не иск", None, "", "42 — !", "中文字 mot", "иск", "x" * 50_000]
    found = {r.term: (r.n, r.docs, r.mark) for r in T.marked_terms(_docs(spark, texts)).collect()}
    assert found["суд"] == (4, 2, "common") and found["не"] == (1, 1, "rare") and found["м"] == (1, 1, "rare")
    assert found["иск"] == (2, 2, "common") and found["中文字"][2] == "rare" and "½" not in found and "x" * 50_000 in found


def test_empty(spark):
    assert T.marked_terms(_docs(spark, [])).count() == 0
    assert T.term_counts(_docs(spark, [None, ""])).count() == 0


def test_bursting_routes_against_a_counter(spark):
    texts = [" ".join("".join(chr(1072 + (i * j * k) % 7) for k in range(1, 1 + (i + j) % 9)) for j in range(1, 60)) for i in range(60)]
    found = {r.term: (r.n, r.docs) for r in T.term_counts(_docs(spark, texts).repartition(7), subtree=5).collect()}
    n, docs = Counter(), Counter()
    for t in texts:
        words = regex.findall(r"\p{L}+", t.lower())
        n.update(words)
        docs.update(set(words))
    assert found == {w: (n[w], docs[w]) for w in n}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("абв", min_size=1, max_size=12), max_size=200))
def test_trie_keeps_every_count(words):
    trie = T.BurstTrie(most=4)
    for w in words:
        trie.add(w, 1, 1)
    held = {term: c[0] for _, leaf in trie.leaves() for term, c in leaf.items()}
    assert held == Counter(words)
    assert all(term.startswith(prefix) for prefix, leaf in trie.leaves() for term in leaf)


def test_groups_stay_small_however_long_the_common_prefix(spark):
    """Terms that share forty letters are split where they part; only a single term may be more than a group holds."""
    terms = ["ы" * 40 + chr(0x430 + i % 30) + chr(0x430 + i // 30) for i in range(200)] + ["ы" * 40] + ["суд"] * 50 + ["с", "сы", "б"]
    routed = T.routed(spark.createDataFrame([(t,) for t in terms], "term string"), 8)
    groups = {}
    for r in routed.collect():
        assert r.term.startswith(r.prefix)
        groups.setdefault(r.prefix, []).append(r.term)
    assert all(len(g) <= 8 or len(set(g)) == 1 for g in groups.values()) and sum(map(len, groups.values())) == len(terms)
    assert all(len({p for p, g in groups.items() if t in g}) == 1 for t in terms)
    assert T.routed(spark.createDataFrame([], "term string"), 8).count() == 0
