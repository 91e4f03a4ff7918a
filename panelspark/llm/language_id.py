"""Language identification by multilingual mixture inference.

A text is a mixture of languages. Each language is a distribution over byte trigrams,
counted in Spark over all training rows. For every text expectation-maximisation
estimates the languages' proportions, and the set of languages grows by the next
largest one as long as the likelihood gains more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.scratch import crc_mod, ship
from panelspark.llm.words import LOWER, Words, chunks, mix

BUCKETS = 1 << 14  # trigrams share buckets by a hash
SMOOTH = 0.5
STEPS = 8  # of expectation-maximisation, for each set of languages
PENALTY = 3.0  # times the logarithm of the number of trigrams, for one language more

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_BLANK = LOWER.copy()
_BLANK[[9, 10, 11, 12, 13]] = 32


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each text's trigrams that have a letter, sorted.

    Texts begin and end with a blank; A-Z and the capitals of Latin-1 are lower-cased.
    """
    data = np.insert(_BLANK[words.data], words.text, 32)
    edge = words.text + np.arange(len(words.text))  # where the blanks went in
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data = data + (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)).astype(np.uint8) * np.uint8(32)
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    wide = data.astype(np.int64)
    gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    letter = _LETTER[data]
    keep = letter[:-2] | letter[1:-1] | letter[2:]
    keep[edge[1:-1] - 1] = False  # a text's blank in the middle
    at = np.flatnonzero(keep)
    text = np.searchsorted(edge, at, "right") - 1
    bucket = (mix(gram[at].astype(np.uint64)) >> np.uint64(64 - 14)).astype(np.int64)
    key, count = np.unique(text * BUCKETS + bucket, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for words in chunks(batch.column(0)):
            own = langs[words.row : words.row + words.texts]
            text, bucket, count = trigrams(words)
            for lang in set(own):
                use = (own == lang)[text]
                total[lang] = total.get(lang, 0) + np.bincount(bucket[use], weights=count[use], minlength=BUCKETS)
    if total:
        yield _rows(total)


def _rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    blobs = [pa.compress(np.asarray(v, np.int64).tobytes(), codec="zstd", asbytes=True) for v in total.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(blobs, pa.binary())], names=["lang", "counts"])


def _open(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=BUCKETS * 8, codec="zstd", asbytes=True), np.int64)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[lang] = total.get(lang, 0) + _open(blob)
    if total:
        yield _rows(total)


@dataclass
class Model:
    """``likelihood[bucket, k]`` of language ``langs[k]``."""

    langs: list[str]
    likelihood: np.ndarray

    def infer(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Largest language of each text and its proportion in the selected set."""
        texts, k = words.texts, len(self.langs)
        best, share = np.zeros(texts, np.int64), np.zeros(texts)
        if not k:
            return best, share
        text, bucket, count = trigrams(words)
        like = self.likelihood[bucket]
        n = np.bincount(text, weights=count, minlength=texts)
        share[:] = 1 / k
        everyone = np.full((texts, k), 1 / k, np.float32)
        full, _ = self._mixture(text, count, like, n, everyone)
        rank = np.argsort(-full, axis=1, kind="stable")
        score = np.full(texts, -np.inf)
        chosen = np.zeros((texts, k), np.float32)
        active = n > 0
        for size in range(1, k + 1):
            if not active.any():
                break
            start = np.zeros((texts, k), np.float32)
            np.put_along_axis(start, rank[:, :size], 1 / size, axis=1)
            use = active[text]
            got, loglik = self._mixture(text[use], count[use], like[use], n, start, STEPS if size > 1 else 0)
            value = loglik - PENALTY * (size - 1) * np.log(np.maximum(n, 1))
            active &= value > score
            score[active] = value[active]
            chosen[active] = got[active]
        known = n > 0
        best[known] = np.argmax(chosen[known], axis=1)
        share[known] = chosen[known, best[known]]
        return best, np.clip(share, 0, 1)

    @staticmethod
    def _mixture(text, count, like, n, start, steps: int = STEPS):
        """Proportions after expectation-maximisation, and the log likelihood with them."""
        share = start
        lead = np.flatnonzero(np.diff(text, prepend=-1))
        own = text[lead]
        total = np.maximum(n[own], 1)[:, None]
        for _ in range(steps):
            part = like * share[text]
            part *= (count / np.maximum(part.sum(1), 1e-30))[:, None].astype(np.float32)
            share = share.copy()
            share[own] = np.add.reduceat(part, lead, axis=0) / total
        found = np.log(np.maximum((like * share[text]).sum(1), 1e-30)) * count
        out = np.zeros(len(n))
        out[own] = np.add.reduceat(found, lead) if len(lead) else 0
        return share, out


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trigram counts of every language, over all rows outside the held-out quarter.

    Rows with a null language are left out. What reaches the driver is ``BUCKETS``
    numbers per language.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & (crc_mod(id_col, 4) != 2)).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counted = rows.mapInArrow(_count, "lang string, counts binary")
    found = {}
    for row in counted.repartition("lang").mapInArrow(_sum, "lang string, counts binary").collect():
        found[row["lang"]] = _open(bytes(row["counts"]))
    langs = sorted(found)
    table = np.stack([found[x] for x in langs], 1) if langs else np.zeros((BUCKETS, 0))
    likelihood = (table + SMOOTH) / (table.sum(0) + SMOOTH * BUCKETS)
    return Model(langs, likelihood.astype(np.float32))


def _predict(model: Model):
    schema = pa.schema([("id", pa.int64()), ("letter", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    names = np.array([*model.langs, "und"], object)
    # Wide arrays hold a number per trigram and language.
    limit = max(1 << 16, (1 << 22) // max(4, len(model.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(1), limit):
                best, share = model.infer(words)
                best = best if model.langs else np.full(words.texts, -1)
                rows = slice(words.row, words.row + words.texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[rows].cast(pa.int64()), batch.column(2)[rows],
                        pa.array(names[best], pa.string()), pa.array(share),
                    ],
                    schema=schema,
                )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, and
    where nothing was learned. Ties go to the first language by name. A text whose
    letters no language knows gets a language with an even score. Null and repeated
    ids keep their rows; extra columns are not read.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letter.alias("letter")).mapInArrow(
        _predict(model), "id long, letter boolean, lang_pred string, score double"
    )
    return out.select(
        F.col("id").alias(id_col), (crc_mod("id", 4) == 2).alias("held_out"),
        F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"),
    )
