import random
from collections import Counter, defaultdict

import duckdb
import pytest
from brute import best_fit, words
from pyspark.sql import functions as F

from panelspark.llm import mixing, packing, quality_rules


def test_rules_on_edge_rows(edge):
    got = {r.doc_id: r for r in quality_rules.judge(edge).collect() if r.doc_id is not None}
    for i in (3, 4, 5, 12):
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed, got[i].kept) == (0, 0, True, False)
    assert got[10].n_words == 60_000 and got[10].n_repeat_words == 60_000
    assert got[8].n_symbols == 6
    assert got[6].n_words == 1 and got[1].token == "x"


def test_repeated_words_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.measure(docs).collect():
        w = words(texts[r.doc_id])
        keys = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(keys)
        covered = {k + j for k, key in enumerate(keys) if seen[key] > 1 for j in range(5)}
        assert r.n_repeat_words == len(covered)


def test_rules_of_an_empty_table(nothing):
    assert quality_rules.judge(nothing).collect() == []


def test_mix_meets_targets_and_limits(documents):
    rows = mixing.mix(documents).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    by_id = {r.doc_id: r.source for r in documents.collect()}
    for r in rows:
        taken[by_id[r.doc_id]] += r.taken
        target[by_id[r.doc_id]] = r.target
    total = sum(r.size for r in rows)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 0.03 * goal + 64
    assert Counter(map(str, rows)) == Counter(map(str, mixing.mix(documents.repartition(7)).collect()))


def test_sainte_lague_equals_highest_quotients(spark):
    rng = random.Random(4)
    for votes in ([5, 3, 1, 0], [rng.randrange(1, 10_000) for _ in range(60)], [1, 1, 1], [0, 0]):
        for seats in (0, 1, 7, 500):
            quotients = sorted(
                (-v / (2 * k - 1), i, k) for i, v in enumerate(votes) if v for k in range(1, seats + 1)
            )
            want = Counter(i for _, i, _ in quotients[:seats])
            df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i long, v long, s long")
            got = {r.i: r.out for r in mixing.apportion(df, "v", "s", [], ["i"], "out").collect()}
            assert got == {i: want[i] for i in range(len(votes))}


def test_mix_of_edge_rows_and_of_nothing(edge, nothing):
    rows = mixing.mix(edge, carry=("size", "source"), made="m_").collect()
    assert len(rows) == edge.count()
    assert all(r.m_taken == 0 for r in rows if r.m_size == 0)
    assert mixing.mix(nothing).collect() == []


def test_mixed_documents_hold_the_words_taken(documents):
    want = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    got = Counter()
    for r in mixing.mixed_documents(documents).collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert {i: n for i, n in want.items() if n} == dict(got)


def test_best_fit_equals_a_search_of_every_bin():
    rng = random.Random(2)
    for per_source in (1, 2):
        pieces = sorted(
            ((rng.randrange(1, 101), rng.randrange(4), rng.randrange(30)) for _ in range(400)), reverse=True
        )
        got = packing.best_fit(*map(list, zip(*pieces)), 100, per_source)
        want = best_fit(pieces, 100, per_source)
        # Equally tight bins are interchangeable: the same rooms are left over.
        assert len(set(got)) == len(set(want))
        room = lambda bins: sorted(sum(p[0] for p, b in zip(pieces, bins) if b == n) for n in set(bins))
        assert room(got) == room(want)


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_bins_hold_their_rules(table, request):
    docs = request.getfixturevalue(table)
    rows = packing.pack(docs, F.xxhash64("text"), capacity=500, shard_rows=64).collect()
    total, sizes = Counter(), Counter()
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.size
        if r.bin_id is None:
            assert r.size == 0
        else:
            bins[r.bin_id].append(r)
            sizes[r.bin_id] += r.size
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(words(r.text))
    assert +total == +want
    assert all(size <= 500 for size in sizes.values())
    assert all(r.bin_size == sizes[r.bin_id] for own in bins.values() for r in own)
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.collect()}
    for own in bins.values():
        assert len({texts[r.doc_id] for r in own}) == len(own)
        assert max(Counter(sources[r.doc_id] for r in own).values()) <= packing.PER_SOURCE


def test_packing_nothing(nothing):
    assert packing.pack(nothing, F.col("doc_id")).collect() == []


def test_bins_of_long_texts_keep_their_own_ids(spark):
    text = " ".join(["w"] * 100)  # 50 bins
    docs = spark.createDataFrame([(i, text, f"s{i}") for i in range(600)], "doc_id long, text string, source string")
    rows = packing.pack(docs, F.col("doc_id"), capacity=2, shard_rows=256).collect()
    assert len(rows) == 30_000
    # Full pieces: every one has its bin.
    assert len({r.bin_id for r in rows}) == len(rows)
    assert all(r.size == r.bin_size == 2 for r in rows)


@pytest.mark.parametrize("size", [5, 7, 10, 20, 23])
def test_mix_meets_targets_of_small_sources(spark, size):
    rows = [(f"{s}{i}", s, " ".join(["w"] * size)) for s in "abc" for i in range(300)]
    rows += [("long", "d", " ".join(["w"] * 9000)), ("one", "e", " ".join(["w"] * size)), *[(f"n{i}", "f", "") for i in range(40)]]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id string, source string, text string"), carry=("source",)).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
        assert r.taken == r.passes * r.size + sum(b["to"] - b["from"] for b in r.blocks)
    assert len(out) == len(rows)
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 0.03 * goal + mixing.BLOCK


def _thin_and_thick(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    rows = [(i, "thin", text(7)) for i in range(300)] + [(300 + i, "thick", text(400)) for i in range(300)]
    rows += [(1000 + i, f"s{i % 9}", text(rng.randrange(60))) for i in range(90)]
    return rows + [(2000, None, text(50)), (2001, "none", ""), (2002, "none", None), (2003, "one", "word"), (2004, "long", text(40_000))]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_of_thin_and_mixed_sources_equals_the_sql(spark, seed):
    rows = _thin_and_thick(seed)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 3), r.taken) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle()})").fetchall()
    assert got == sorted((i, n, s, round(t, 3), k) for i, n, s, t, k in want)


def test_rows_without_an_id_are_spread_by_their_text(spark):
    docs = spark.createDataFrame([(None, "a", f"w{i} " * 40) for i in range(3000)], "doc_id long, source string, text string")
    names = docs.select((mixing._number(mixing._name("doc_id", "text"), 1) % 10).alias("cell")).groupBy("cell").count().collect()
    assert len(names) == 10 and max(r["count"] for r in names) < 450
    assert sum(r.taken for r in mixing.mix(docs).collect()) == 120_000
