"""Toxicity by weak supervision.

Many voters, word lists learned from labelled rows and patterns of writing, each
vote toxic, clean or nothing on every document. A generative label model learns how
good they are from their agreement over all documents: votes share one hidden
label, so their covariances are products of their accuracies, except between
voters that are correlated beyond it, which the fit finds and sets apart. The
posterior labels it gives train a linear classifier, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.labelled import FIT_ROWS, fitting_rows
from panelspark.llm.scratch import crc_mod
from panelspark.llm.words import BASE, LOWER, Words, chunks, mix, powers

# Word beginnings by length in bytes; 0 is the whole word.
KINDS = (0, 4, 5, 6, 7, 8, 9)
# A word beginning enters a list when its association with the label (G squared) and
# its odds ratio reach these, in so many toxic documents.
LEAST_G, LEAST_ODDS, LEAST_DOCS = 30.0, 3.0, 4
# Shares of a text's words that a list must reach to vote toxic.
DENSITIES = (0.004, 0.008, 0.012)

_ALL = (1 << 64) - 1
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True


def beginnings(words: Words, kinds: tuple[int, ...] = KINDS) -> np.ndarray:
    """Hash of each word's beginning for each of ``kinds`` (rows); 0 where too short.

    A-Z are lower-cased and punctuation around the word is left out.
    """
    start, end = words.start.copy(), words.end.copy()
    if not len(start):
        return np.zeros((len(kinds), 0), np.uint64)
    for _ in range(4):
        end -= (end > start) & _TAIL[words.data[np.maximum(end - 1, 0)]]
        start += (start < end) & _TAIL[words.data[np.minimum(start, len(words.data) - 1)]]
    up, down = powers(len(words.data))
    code = mix(np.arange(1, 257, dtype=np.uint64))[LOWER]
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(code[words.data] * up[: len(words.data)], out=sums[1:])
    size = end - start
    out = np.zeros((len(kinds), len(start)), np.uint64)
    for row, length in enumerate(kinds):
        stop = end if length == 0 else np.minimum(start + length, end)
        code_ = mix((sums[stop] - sums[start]) * down[np.minimum(start, len(words.data) - 1)] + np.uint64((length * 7 + 3) * int(BASE) & _ALL))
        out[row] = np.where((size >= max(length, 2)) & (code_ != 0), code_, 0)
    return out


def _share(words: Words, which: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(which[words.data], out=total[1:])
    return np.diff(total[words.text])


def _association(a: np.ndarray, b: np.ndarray, toxic: float, clean: float) -> tuple[np.ndarray, np.ndarray]:
    """G squared and log odds ratio of being in a of the toxic and b of the clean rows."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    share = (a + b) / max(1.0, toxic + clean)
    g = 2 * (
        part(a, toxic * share) + part(b, clean * share)
        + part(toxic - a, toxic * (1 - share)) + part(clean - b, clean * (1 - share))
    )
    odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
    return g, odds


def _kept(count: np.ndarray, toxic: float, clean: float) -> tuple[np.ndarray, np.ndarray]:
    """Which entries enter a list, and their log odds.

    ``count`` has for each the toxic and clean rows that have it at all, and those
    where it makes ``DENSITIES[0]`` of the words; either may associate it with the label.
    """
    keep, best = np.zeros(len(count), bool), np.zeros(len(count))
    for a, b in (count[:, 0:2].T, count[:, 2:4].T):
        g, odds = _association(a, b, toxic, clean)
        keep |= (g >= LEAST_G) & (odds >= np.log(LEAST_ODDS)) & (a >= LEAST_DOCS)
        best = np.maximum(best, odds)
    return keep, best


def _entries(words: Words, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, beginning) of one kind: text, hash and whether it is dense there."""
    owner, row = words.owner(), beginnings(words, (kind,))[0]
    seen = np.flatnonzero(row)
    order = seen[np.lexsort((row[seen], owner[seen]))]
    text, code = owner[order], row[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else order
    count = np.diff(np.r_[first, len(code)])
    return text[first], code[first], count >= DENSITIES[0] * words.counts[text[first]]


def _of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of toxic rows -> (kind, hash, rows that have it)."""
    for batch in batches:
        for words in chunks(batch.column(0)):
            for kind in KINDS:
                code, n = np.unique(_entries(words, kind)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), kind, np.int32)), pa.array(code.view(np.int64)), pa.array(n)], names=["kind", "code", "n"]
                )


def _counted(candidates: list[np.ndarray]):
    """Rows (text, label, half) -> per candidate its counts, of all rows and of half 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(each), 8), np.int64) for each in candidates]
        for batch in batches:
            clean, half = batch.column(1).to_numpy() == 0, batch.column(2).to_numpy()
            for words in chunks(batch.column(0)):
                for kind, each, total in zip(KINDS, candidates, totals):
                    if not len(each):
                        continue
                    text, code, dense = _entries(words, kind)
                    at = np.minimum(np.searchsorted(each, code), len(each) - 1)
                    own = each[at] == code
                    text, at, dense = text[own] + words.row, at[own], dense[own]
                    for first, use in ((0, np.ones(len(at), bool)), (4, half[text] == 0)):
                        for column, some in ((0, use), (2, use & dense)):
                            place = at[some] * 8 + first + column + clean[text[some]]
                            total += np.bincount(place, minlength=total.size).reshape(total.shape)
        for k, total in enumerate(totals):
            used = np.flatnonzero(total.any(1))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * 8), pa.array(total[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used), cells], names=["k", "at", "n"])

    return run


def learn_lists(sample: DataFrame) -> tuple[list, list]:
    """For each of ``KINDS`` the sorted hashes and log odds of its list, from all rows and from half 0.

    ``sample`` has text, label and half. Only what occurs in ``LEAST_DOCS`` toxic rows
    can enter a list; only these hashes and their counts leave the tasks.
    """
    toxic = sample.where("label = 1").select("text").mapInArrow(_of_toxic, "kind int, code long, n long")
    often = toxic.groupBy("kind", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS).toArrow()
    kind, code = often.column("kind").to_numpy(), often.column("code").to_numpy().view(np.uint64)
    candidates = [np.sort(code[kind == k]) for k in KINDS]
    counts = [np.zeros((len(each), 8), np.int64) for each in candidates]
    cells = sample.select("text", "label", "half").mapInArrow(_counted(candidates), "k int, at long, n array<bigint>")
    summed = cells.groupBy("k", "at").agg(*[F.sum(F.col("n")[c]).alias(f"n{c}") for c in range(8)]).toArrow()
    for k in range(len(KINDS)):
        own = summed.filter(pc.equal(summed.column("k"), k))
        counts[k][own.column("at").to_numpy()] = np.stack([own.column(f"n{c}").to_numpy() for c in range(8)], 1)
    rows = sample.agg(*[F.count(F.when((F.col("label") == y) & (F.col("half") <= h), 1)) for h in (1, 0) for y in (1, 0)]).first()
    out = []
    for first in (0, 4):
        lists = []
        for each, count in zip(candidates, counts):
            keep, odds = _kept(count[:, first : first + 4].astype(float), float(rows[first // 2]), float(rows[first // 2 + 1]))
            lists.append((each[keep], odds[keep]))
        out.append(lists)
    return out[0], out[1]


def features(words: Words, lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row per text: for each list its share of words, of odds and of distinct entries; then patterns."""
    n = np.maximum(words.counts, 1)
    owner = words.owner()
    columns = []
    for row, (each, odds) in zip(beginnings(words), lists):
        if not len(each):
            columns += [np.zeros(words.texts)] * 3
            continue
        at = np.minimum(np.searchsorted(each, row), len(each) - 1)
        hit = np.flatnonzero(each[at] == row)
        text = owner[hit]
        columns.append(np.bincount(text, minlength=words.texts) / n)
        columns.append(np.bincount(text, weights=odds[at[hit]], minlength=words.texts) / n)
        pairs = np.unique(text * len(each) + at[hit])
        columns.append(np.bincount(pairs // len(each), minlength=words.texts))
    letters = np.maximum(_share(words, _LETTER), 1)
    columns += [
        _share(words, _CAPITAL) / letters, _share(words, _SYMBOL) / n, _share(words, _BANG) / n,
        np.log1p(words.counts),
    ]
    return np.stack(columns, 1).astype(np.float64)


def votes(x: np.ndarray) -> np.ndarray:
    """Votes in -1 (clean), 0, 1 (toxic), one column per voter."""
    out = []
    for k in range(len(KINDS)):
        share, odds, distinct = x[:, 3 * k], x[:, 3 * k + 1], x[:, 3 * k + 2]
        for least in DENSITIES:
            out.append(np.where(share >= least, 1, np.where(share == 0, -1, 0)))
        out.append(np.where(odds >= 0.03, 1, -1))
        out.append(np.where((distinct >= 2) & (share >= 0.006), 1, -1))
    capital, symbol, bang, _ = x[:, -4:].T
    out += [np.where(capital > 0.3, 1, 0), np.where(symbol > 0.2, 1, 0), np.where(bang > 0.5, 1, 0)]
    return np.stack(out, 1).astype(np.float64)


def _moments(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for words in chunks(batch.column(0)):
                v = votes(features(words, lists))
                v = np.c_[np.ones(len(v)), v]
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "s"])

    return run


@dataclass
class LabelModel:
    """Posterior log odds of the label as ``bias + votes @ weight``."""

    weight: np.ndarray
    bias: float
    accuracy: np.ndarray
    correlated: list[tuple[int, int]]


def _triplets(r: np.ndarray) -> np.ndarray:
    """Loading of each voter: its correlations with two others over theirs with each other.

    The median over all pairs of others stands firm while most are not correlated
    beyond the label.
    """
    n = len(r)
    if n < 3:
        return np.sqrt(np.clip(np.abs(r - np.eye(n)).max(1, initial=0.25), 0.01, 0.96))
    out = np.zeros(n)
    for i in range(n):
        j, k = np.triu_indices(n, 1)
        keep = (j != i) & (k != i) & (np.abs(r[j, k]) > 0.01)
        ratio = r[i, j[keep]] * r[i, k[keep]] / r[j[keep], k[keep]]
        out[i] = np.sqrt(np.clip(np.median(ratio), 0, 0.96)) if len(ratio) else 0.0
    # Most voters are better than chance; the rest agree with them less than not at all.
    return out * np.where(r @ out - out < 0, -1, 1)


def fit_label_model(moments: np.ndarray, prior: float) -> LabelModel:
    """Accuracies and correlations from vote counts over all documents.

    ``moments`` is the matrix of vote products, with a constant one first. Given the
    hidden label, covariances between voters are products of loadings; the loadings
    are fitted to the pairs that are not correlated, and pairs whose covariance they
    leave unexplained join the correlated ones until none is new. The posterior uses
    the covariance within a label, correlations included.
    """
    total = moments[0, 0]
    mean = moments[0, 1:] / total
    cov = moments[1:, 1:] / total - np.outer(mean, mean)
    live = np.flatnonzero(np.diag(cov) > 1e-6)
    weight, accuracy, correlated = np.zeros(len(mean)), np.zeros(len(mean)), []
    if not len(live):
        return LabelModel(weight, float(np.log(prior / (1 - prior))), accuracy, correlated)
    c = cov[np.ix_(live, live)]
    scale = np.sqrt(np.diag(c))
    r = c / np.outer(scale, scale)
    use = ~np.eye(len(live), dtype=bool)
    load = _triplets(r)
    for _ in range(20):
        rest = np.abs(r - np.outer(load, load)) * use
        # Most pairs are explained; those far beyond the usual rest are correlated.
        new = rest > max(0.1, 4 * np.median(rest[use]) if use.any() else 1.0)
        if (use & ~new).sum() >= 3 * len(live):
            use &= ~new
        for _ in range(50):
            # Least squares for one loading given the others, damped.
            down = np.maximum((use * load**2).sum(1), 1e-6)
            load = 0.5 * load + 0.5 * np.clip((use * r * load).sum(1) / down, -0.98, 0.98)
        if not new.any():
            break
    spread = np.sqrt(prior * (1 - prior))
    delta = load * scale / spread  # difference of a voter's mean between the labels
    within = c - np.outer(load * scale, load * scale)
    within += np.diag(0.05 * np.diag(c) + 1e-4)
    values, vectors = np.linalg.eigh(within)
    within = (vectors * np.maximum(values, 0.05 * values.max())) @ vectors.T
    own = np.linalg.solve(within, delta)
    toxic, clean = mean[live] + (1 - prior) * delta, mean[live] - prior * delta
    bias = float(np.log(prior / (1 - prior)) - own @ (toxic + clean) / 2)
    weight[live] = own
    accuracy[live] = np.clip(0.5 + delta / 4, 0, 1)
    pairs = np.argwhere(np.triu(~use, 1))
    return LabelModel(weight, bias, accuracy, [(int(live[i]), int(live[j])) for i, j in pairs])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _squash(x: np.ndarray) -> np.ndarray:
    """Features of the classifier: shares grow to a limit, counts by their logarithm."""
    out = []
    for k in range(len(KINDS)):
        share, odds, distinct = x[:, 3 * k], x[:, 3 * k + 1], x[:, 3 * k + 2]
        out += [np.minimum(share / 0.02, 2), np.minimum(odds / 0.08, 2), np.log1p(distinct)]
        out += [(share > least).astype(float) for least in DENSITIES]
    return np.stack([*out, *x[:, -4:].T], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 60) -> np.ndarray:
    """Weights with the bias last, by Newton steps on the weighted, penalised likelihood of soft labels."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (y - p)) - keep * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Toxicity:
    lists: list[tuple[np.ndarray, np.ndarray]]
    label_model: LabelModel
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, words: Words) -> np.ndarray:
        x = (_squash(features(words, self.lists)) - self.mean) / self.scale
        return _sigmoid(self.slope * (x @ self.weight[:-1] + self.weight[-1]) + self.shift)


def _features(*lists):
    """Rows (id, label, half, text) with the text's features by each of the lists in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for found in lists:
                x = [features(words, found) for words in chunks(batch.column(3))]
                x = np.concatenate(x) if x else np.zeros((0, 3 * len(KINDS) + 4))
                edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                columns.append(pa.ListArray.from_arrays(edges, pa.array(x.reshape(-1))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["id", "label", "half", "x", "half_x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Fit on at most ``rows`` labelled rows; voters are judged on all documents."""
    sample = fitting_rows(docs, labels, "toxic", rows, id_col, text_col)
    sample = sample.withColumn("half", F.pmod("id", F.lit(2)).cast("int"))
    lists, half_lists = learn_lists(sample)
    found = sample.select("id", "label", "half", "text").mapInArrow(
        _features(lists, half_lists), "id long, label int, half int, x array<double>, half_x array<double>"
    ).toArrow().sort_by("id")
    y = found.column("label").to_numpy().astype(np.float64)
    size = 3 * len(KINDS) + 4
    x, half_x = (found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, size) for c in ("x", "half_x"))
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    summed = (
        docs.select(text_col).mapInArrow(_moments(lists), "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    )
    size = votes(np.zeros((1, 3 * len(KINDS) + 4))).shape[1] + 1
    moments = np.zeros(size * size)
    for row in summed:  # one number per pair of voters
        moments[row["at"]] = row["s"]
    moments = moments.reshape(size, size)
    moments[0, 0] = max(moments[0, 0], 1.0)
    model = fit_label_model(moments, prior)
    z = _squash(x)
    mean = z.mean(0) if len(z) else np.zeros(z.shape[1])
    scale = z.std(0) + 1e-3 if len(z) else np.ones(z.shape[1])
    z = (z - mean) / scale
    soft = _sigmoid(model.bias + votes(x) @ model.weight)
    weight = _logistic(z, soft, np.ones(len(z)), ridge=1.0)
    # The score is scaled on rows that made none of the lists they are read with: half 1,
    # with lists from half 0. This is where labels enter besides the lists.
    check = found.column("half").to_numpy() == 1
    margin = (_squash(half_x) - mean) / scale @ weight[:-1] + weight[-1]
    slope, shift = 1.0, 0.0
    if len(y) and 0 < y[check].sum() < check.sum():
        slope, shift = _logistic(margin[check, None], y[check], np.ones(check.sum()), ridge=0.01)
    return Toxicity(lists, model, mean, scale, weight, float(slope), float(shift))


def _score(model: Toxicity):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(words) for words in chunks(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(found))], schema=schema
                )

    return run


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` (score of 0.3 or more) of every row.

    A null text scores as an empty one. Null and repeated ids keep their rows. Labels,
    language, source and id are no input of a score; extra columns are not read.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "id long, score double")
    return out.select(
        F.col("id").alias(id_col), (crc_mod("id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def _keep(model: Toxicity, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(w) for w in chunks(batch.column(batch.schema.get_field_index(text_col)))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < 0.3))

    return run


def without_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """Rows whose score is below 0.3, all columns as they are."""
    return docs.mapInArrow(_keep(model, text_col), docs.schema)
