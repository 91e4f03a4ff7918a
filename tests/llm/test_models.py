import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import jaccard, lower, words
from pyspark.sql import functions as F

from panelspark.llm import fingerprints, labelled, language_id, lm_scoring, quality_mil, toxicity
from panelspark.llm.attention import WINDOW, Attention, windows_of


def held_out(i, mod=4, rest=2):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == rest


def test_quality_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 1, 2])
    model = quality_mil.train(sizes, rng.normal(size=(7, quality_mil.FEATURES)), np.array([0.0, 1, 0, 1]), epochs=1)
    x, first = rng.normal(size=(7, quality_mil.FEATURES)), np.array([0, 3, 4, 7])
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in model.gradient(x, first, y).items():
        flat = model.p[name].reshape(-1) if model.p[name].ndim else None
        if flat is None:
            continue
        at = int(np.argmax(np.abs(g).reshape(-1)))
        keep = flat[at]
        flat[at] = keep + 1e-5
        up = loss()
        flat[at] = keep - 1e-5
        down = loss()
        flat[at] = keep
        assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-5


def test_quality_and_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    quality = {r.doc_id: r for r in quality_mil.score(docs, quality_mil.fit(docs, labels)).collect()}
    assert len(quality) == docs.count()
    own = [i for i in truth if held_out(i)]
    assert all(quality[i].held_out for i in own)
    assert np.mean([quality[i].predicted == truth[i].quality for i in own]) >= 0.95
    toxic = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([toxic[i].predicted == truth[i].toxic for i in own]) >= 0.9
    assert np.mean([toxic[i].predicted for i in own if truth[i].toxic == 0]) <= 0.05


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_a_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    some = {r.lang: r.text for r in docs.where("n_chars BETWEEN 3000 AND 6000 AND text NOT LIKE '%|%'").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, some["de"] + " " + some["de"] + " " + some["es"])], "doc_id long, text string")
    row = language_id.predict(mixed, model).first()
    assert row.lang_pred == "de" and row.score < 0.95


def test_models_on_edge_rows(edge, edge_labels):
    n = edge.count()
    for made in (
        quality_mil.score(edge, quality_mil.fit(edge, edge_labels)), toxicity.score(edge, toxicity.fit(edge, edge_labels)),
    ):
        rows = made.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == held_out(r.doc_id) for r in rows)
        # Empty and null texts score alike.
        assert len({r.score for r in rows if r.doc_id in (3, 4, 12)}) == 1
    rows = language_id.predict(edge, language_id.fit(edge)).collect()
    assert len(rows) == n
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 8, 12)} == {"und"}
    kept = toxicity.without_toxic(edge, toxicity.fit(edge, edge_labels))
    assert kept.columns == edge.columns


def test_models_on_an_empty_table(nothing, edge_labels):
    assert quality_mil.score(nothing, quality_mil.fit(nothing, edge_labels)).collect() == []
    assert toxicity.score(nothing, toxicity.fit(nothing, edge_labels.limit(0))).collect() == []
    assert language_id.predict(nothing, language_id.fit(nothing)).collect() == []
    assert lm_scoring.score_texts(nothing).collect() == []
    assert fingerprints.compare_edited(nothing).collect() == []


def test_fitting_rows_are_one_per_id(spark):
    """An id that a third of all rows carry brings one text; what is held out or has no label brings none."""
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rest = spark.range(40_000).select((F.col("id") + 2).alias("doc_id"), F.lit("other").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)] + [(1, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = labelled.fitting_rows(many.unionByName(rest), labels, "toxic", rows=100).collect()
    assert len(got) == 100 == len({r.id for r in got})
    every = labelled.fitting_rows(many.unionByName(rest), labels, "toxic").collect()
    assert len(every) == sum(not held_out(i) for i in range(1, 400) if i != 7) and {r.text for r in every} == {"text 0", "other"}


def test_word_lists_as_by_counting(spark, documents, labels):
    """Counts of word beginnings in toxic and clean rows, and the lists that they make."""
    sample = labelled.fitting_rows(documents, labels, "toxic").withColumn("half", F.pmod("id", F.lit(2)).cast("int"))
    rows = [(r.text, r.label, r.half) for r in sample.collect()]
    marks = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
    found = toxicity.learn_lists(sample)
    for lists, halves in zip(found, ((0, 1), (0,))):
        some = [r for r in rows if r[2] in halves]
        toxic, clean = (sum(r[1] == y for r in some) for y in (1, 0))
        for kind, (codes, odds) in zip(toxicity.KINDS, lists):
            counts = [Counter() for _ in range(4)]
            for text, label, _ in some:
                own = Counter()
                for w in words(text):
                    b = lower(w).encode()
                    for _ in range(4):
                        b = b[:-1] if b and chr(b[-1]) in marks and b[-1] < 128 else b
                        b = b[1:] if b and chr(b[0]) in marks and b[0] < 128 else b
                    if len(b) >= max(kind, 2):
                        own[b[:kind] if kind else b] += 1
                for b, n in own.items():
                    counts[0 if label else 1][b] += 1
                    if n >= toxicity.DENSITIES[0] * len(words(text)):
                        counts[2 if label else 3][b] += 1
            each = [b for b in counts[0] if counts[0][b] >= toxicity.LEAST_DOCS]
            keep, want = toxicity._kept(np.array([[c[b] for c in counts] for b in each], float).reshape(-1, 4), toxic, clean)
            assert len(codes) == keep.sum() and np.allclose(np.sort(odds), np.sort(want[keep]))


def test_label_model_finds_accuracies_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(40_000) < 0.2, 1, -1)
    right = [0.9, 0.8, 0.75, 0.85, 0.7, 0.8]
    v = np.stack([np.where(rng.random(len(y)) < r, y, -y) for r in right], 1)
    v = np.c_[v, np.where(rng.random(len(y)) < 0.97, v[:, 1], -v[:, 1])]  # a copy of the second
    one = np.c_[np.ones(len(y)), v]
    model = toxicity.fit_label_model(one.T @ one, 0.2)
    assert (1, 6) in model.correlated
    assert np.argmax(model.accuracy) in (0, 3)
    assert np.mean((model.bias + v @ model.weight > 0) == (y > 0)) > 0.93


def test_base_scores_equal_word_counts(documents, edge):
    for table in (documents, edge):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        tokens = [(i, [*words(lower(t)), None]) for i, t in rows]
        c = Counter(x for i, w in tokens if not held_out(i, 10, 0) for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted(
            (i is None, i or 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3))
            for i, w in tokens
        )
        got = lm_scoring.score_texts(table).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_every_subword_is_scored_once():
    counts = np.array([1, 0, 32, 33, 56, 57, 200, 0, 5])
    place, scored, first = windows_of(counts)
    assert sorted(place[scored]) == list(range(counts.sum()))
    assert place.shape[1] == WINDOW and first.sum() == (counts > 0).sum()


def test_attention_is_causal_sums_to_one_and_learns():
    rng = np.random.default_rng(0)
    size = 200
    counts = rng.integers(1, 50, size).astype(float)
    cls = np.arange(size) % 128
    model = Attention.start(cls, counts, np.ones((128, 128)))
    ids = rng.integers(0, size, (3, WINDOW))
    tables = model.tables()
    total = np.zeros(ids.shape)
    for t in range(size):
        total += np.exp(model.log_probs(ids, np.full_like(ids, t), tables))
    assert np.allclose(total, 1, atol=1e-3)
    later = ids.copy()
    later[:, 20:] = rng.integers(0, size, (3, WINDOW - 20))
    a, b = model.log_probs(ids, ids, tables), model.log_probs(later, ids, tables)
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5)
    # Gradient against differences, then training on a pattern.
    live = np.ones(ids.shape, bool)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    targets = rng.integers(0, size, ids.shape)

    def loss():
        return -(model.log_probs(ids, targets, model.tables()) - model.inside[targets]).mean()

    for name, g in model.step(ids, targets, live).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = model.p[name][at]
        model.p[name][at] = keep + 1e-4
        up = loss()
        model.p[name][at] = keep - 1e-4
        down = loss()
        model.p[name][at] = keep
        assert abs((up - down) / 2e-4 - g[at]) < 2e-3 * max(1, abs(g[at])), name
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    x = (np.arange(WINDOW) + rng.integers(0, 50, 256)[:, None]) % 50
    before = model.log_probs(x, (x + 1) % 50, model.tables()).mean()
    for _ in range(5):
        model.train(x, (x + 1) % 50, np.ones(x.shape, bool))
    assert model.log_probs(x, (x + 1) % 50, model.tables()).mean() > before + 1


@pytest.mark.parametrize("table", ["edge", "documents"])
def test_fingerprints(table, request):
    docs = request.getfixturevalue(table)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None), key=lambda r: -r[0])
    got = fingerprints.compare_edited(docs).collect()
    assert len(got) == docs.count()
    ids = [i for i, _ in rows]
    off = []
    for at, (i, text) in enumerate(rows):
        if ids.count(i) > 1 or (table == "edge" and (at == len(rows) - 1 or ids.count(rows[at + 1][0]) > 1)):
            continue
        nxt = rows[(at + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        row = next(r for r in got if r.doc_id == i)
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [row.near_edited - jaccard(text, edited), row.near_next - jaccard(text, nxt)]
    assert abs(np.mean(off)) < 0.06
    same = {}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        if r.doc_id is not None:
            assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_sample_collision_rate_is_generalised_jaccard(spark):
    """Over many samples, on texts with unequal weights."""
    a, b = "x x x x y y z w", "x x y y y y z v v"
    hits, total = 0, 0
    pairs = [(f"{s}", " ".join(f"{w}{s}" for w in t.split())) for s in range(60) for t in (a, b)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(pairs)], "i long, text string")
    sig = {r.i: r.fingerprint for r in fingerprints.signatures(df, ["i"], "text").collect()}
    for s in range(60):
        one, two = sig[2 * s], sig[2 * s + 1]
        hits += sum(one[k : k + 8] == two[k : k + 8] for k in range(0, len(one), 8))
        total += fingerprints.SAMPLES
    assert abs(hits / total - jaccard(a, b)) < 0.04


def test_scored_subwords_see_half_a_window_before_them():
    counts = np.array([1, 31, 32, 33, 48, 49, 500, 0, 77])
    place, scored, first = windows_of(counts)
    assert all(np.flatnonzero(own)[0] >= WINDOW // 2 for own in scored[~first])
    # Scoring the last places alone gives what whole windows give.
    rng = np.random.default_rng(3)
    model = Attention.start(np.arange(200) % 128, rng.integers(1, 50, 200).astype(float), np.ones((128, 128)))
    targets = rng.integers(0, 200, counts.sum())
    begin = (np.cumsum(counts) - counts)[counts > 0]
    lm_start, lm_scoring.START = lm_scoring.START, 7
    try:
        got = lm_scoring.spelled_log_probs(model, model.tables(), targets, counts, batch=4)
    finally:
        lm_scoring.START = lm_start
    inputs = np.r_[0, targets[:-1]]
    inputs[begin] = 7
    whole = model.log_probs(inputs[place], targets[place], model.tables())
    want = np.zeros(len(targets))
    want[place[scored]] = whole[scored]
    assert np.allclose(got, want / np.log(10), atol=1e-5)


def test_training_covers_every_text(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 900, size)) for size in (3000, 40, 1, 700)] + ["", None, "Über  straße\tx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    model = lm_scoring.train(docs, 20_000, lm_scoring.Scratch(spark, "lm"))
    counts = np.zeros(lm_scoring.IDS + 2)
    for text in texts:
        ids, _ = lm_scoring.subwords(words(lower(text)), lm_scoring.TOKENIZER)
        np.add.at(counts, np.r_[ids, lm_scoring.END], 1)
    share = (counts + 0.1) / np.bincount(model.cls, weights=counts + 0.1)[model.cls]
    assert np.allclose(np.exp(model.inside), share, rtol=1e-4)


@pytest.mark.parametrize("before", [[], [3, 120, 11]])
def test_words_that_may_come_next_sum_to_one(monkeypatch, before):
    """All words of one or two subwords, the end, and the mass of longer words."""
    rng = np.random.default_rng(6)
    model = Attention.start(np.arange(200) % 128, rng.integers(1, 50, 200).astype(float), rng.integers(0, 9, (128, 128)))
    monkeypatch.setattr(lm_scoring, "START", 7)
    end, begins = 79, np.arange(200) < 80  # 80 and above go on with a word
    found = [[b] for b in range(end)] + [[b, c] for b in range(end) for c in range(80, 200)]
    texts = [before + w + [end] for w in found] + [before + [end]]
    counts = np.array([len(t) for t in texts])
    spelled, opens = lm_scoring.spelled_log_probs(
        model, model.tables(), np.concatenate(texts), counts, group=model.shares(begins)
    )
    at = np.cumsum(counts) - counts + len(before)
    first = np.sort(np.r_[at, at[:-1] + [len(w) for w in found]])
    if before:
        first = np.sort(np.r_[first, at - 3, at - 1])  # the words before: 3 120, 11
    flat = np.concatenate(texts)
    word = lm_scoring.word_log_probs(spelled, opens, first, flat[first] == end)
    own = word[np.isin(first, at)]
    total = (10.0**own).sum()
    # Words of more subwords: two begin like these, and the next subword goes on.
    long = at[:-1][[len(w) == 2 for w in found]]
    rest = (10.0 ** (spelled[long] - opens[long] + spelled[long + 1]) * (1 - 10.0 ** opens[long + 2])).sum()
    assert total < 1 and abs(total + rest - 1) < 1e-3
