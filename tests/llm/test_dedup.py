from collections import Counter

import numpy as np
import pytest
from brute import components, cut_repeats, words

from panelspark.llm import ngram_join, substring_dedup
from panelspark.llm.components import components as connect
from panelspark.llm.scratch import Scratch


def test_cuts_equal_brute_force_on_edge_rows(edge):
    got = substring_dedup.remove_repeats(edge, window=13, carry=("n_words", "source"), made="m_").collect()
    want = cut_repeats([(r.doc_id, r.text) for r in edge.collect()], 13)
    assert Counter((r.doc_id, r.m_n_words, r.m_n_removed, " ".join(words(r.text))) for r in got) == Counter(want)
    assert {r.n_words for r in got} == {"x", None}
    # A null text stays null, an untouched one stays as it is.
    assert [r.text for r in got if r.doc_id == 4] == [None]
    assert [r.text for r in got if r.doc_id == 5] == [" \t\n\r "]


@pytest.mark.parametrize("window", [2, 13])
def test_cuts_equal_brute_force_on_documents(documents, window):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = substring_dedup.remove_repeats(documents, window=window).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, " ".join(words(r.text))) for r in got) == Counter(cut_repeats(rows, window))


def test_cuts_of_an_empty_table(nothing):
    assert substring_dedup.remove_repeats(nothing).collect() == []


def test_many_flushes_and_parts_give_the_same(documents, monkeypatch):
    want = Counter(map(tuple, substring_dedup.remove_repeats(documents).collect()))
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 1 << 15)
    assert Counter(map(tuple, substring_dedup.remove_repeats(documents).collect())) == want


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_components_equal_brute_force(documents, size, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = ngram_join.similar_classes(documents, size=size, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, size, percent)


def test_components_of_edge_rows(edge):
    got = ngram_join.similar_classes(edge, size=4, percent=85).collect()
    want = components([(r.doc_id, r.text) for r in edge.collect()], 4, 85)
    assert len(got) == edge.count()
    assert all(r.component_id == want.get(r.doc_id) for r in got)
    assert {r.n_shingles for r in got if r.doc_id in (3, 4, 5, 12)} == {0}


def test_components_of_an_empty_table(nothing):
    assert ngram_join.similar_classes(nothing).collect() == []


def test_a_list_of_unlinked_documents_is_searched_whole(spark):
    """Documents that share their rarest shingle but little else, and two among them that are linked."""
    rng = np.random.default_rng(3)
    text = [" ".join(["a", "b", "c", *(f"x{rng.integers(40)}" for _ in range(12))]) for _ in range(60)]
    text[50] = text[20] + " tail"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    for size, percent in ((2, 70), (1, 50)):
        got = {r.doc_id: r.component_id for r in ngram_join.similar_classes(docs, size=size, percent=percent).collect()}
        assert got == components(list(enumerate(text)), size, percent)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 3)], "a long, b long")
    got = {r.id: r.comp for r in connect(links, Scratch(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_long_lists_are_probed_until_the_overlap_is_settled(percent):
    rng = np.random.default_rng(percent)
    seen = set()
    for _ in range(300):
        lists = rng.permutation(400)[: rng.integers(1, 300)].astype(np.uint64)
        keep = rng.random(len(lists)) < rng.choice([0.2, 0.7, 0.9, 1.0])
        other = np.union1d(lists[keep], rng.integers(400, 460, rng.integers(1, 40)).astype(np.uint64))
        for needed in (1, keep.sum(), keep.sum() + 1, max(1, percent * len(lists) // 100)):
            short = int(rng.integers(0, len(lists) + 1))
            got = ngram_join._reaches(lists, short, other, int(needed))
            assert got == (keep.sum() >= needed)
            seen.add(got)
    assert seen == {True, False}


def test_short_lists_leave_out_no_link(spark):
    """Sets of unequal size, links at the limit, rows of one id and very frequent shingles."""
    rng = np.random.default_rng(8)
    base = [f"w{n}" for n in rng.integers(0, 30, 200)]
    rows = []
    for i in range(90):
        w = base[: rng.integers(20, 200)].copy()
        for k in rng.integers(0, len(w), rng.integers(0, 8)):
            w[k] = f"z{rng.integers(12)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((1, 80), (3, 70), (4, 85)):
        got = {r.doc_id: r.component_id for r in ngram_join.similar_classes(docs, size=size, percent=percent).collect()}
        assert got == components(rows, size, percent)
