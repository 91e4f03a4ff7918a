"""Substring deduplication: repeated windows of words are cut from later documents.

Every run of ``window`` words of every text gets a Rabin-Karp hash. Hashes meet by
range in Spark, where a window's occurrences are counted and its smallest document
is kept; all other occurrences merge into maximal intervals of words to remove.

A row per window would shuffle four to five times the input. The windows therefore
travel as packed blocks: each task sorts its windows by hash, settles those that
repeat within it (only the smallest document's goes on, so a passage held by a
third of all rows sends one entry per task) and ships one compressed block per
hash range, some nine bytes per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.packed import expand, range_edges, small, squeeze
from panelspark.llm.scratch import Scratch, parts_for, text_bytes
from panelspark.llm.words import chunks, windows

# Text of one hash range, and of one group of documents in the last step.
PART_BYTES = 12 << 20
GROUP_BYTES = 6 << 20
# Windows a task holds before it sorts and ships them.
HELD = 1 << 21
_LAST = np.iinfo(np.int64).max


def _by_hash(hash_: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and for each entry in that order whether a smaller document has it."""
    order = np.argsort(hash_, kind="stable")
    sorted_ = hash_[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    doc = doc[order]
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(doc)]))
    return order, doc > least


_BLOCK = pa.schema(
    [("part", pa.int64()), ("kind", pa.int32())]
    + [(n, pa.binary()) for n in ("hash", "code", "at", "ids", "keys")]
)
_CUTS = pa.schema([("grp", pa.int64())] + [(n, pa.binary()) for n in ("keys", "sizes", "starts")])
_CUTS_SQL = "grp long, keys binary, sizes binary, starts binary"


def _cut_rows(key: np.ndarray, at: np.ndarray, groups: int) -> pa.RecordBatch:
    """One row per group of documents: where their removable windows begin.

    ``keys`` and ``sizes`` name the documents and how many starts each has;
    ``starts`` holds gaps between them, runs of one that compression folds.
    """
    order = np.lexsort((at, key, key % groups))
    key, at = key[order], at[order].astype(np.uint32)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    gaps = np.diff(at, prepend=np.uint32(0))
    gaps[first] = at[first]
    own, sizes = key[first], np.diff(np.r_[first, len(key)]).astype(np.uint32)
    grp = own % groups
    turn = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
    ends, stops = np.r_[turn[1:], len(own)], np.r_[first[turn[1:]], len(key)]
    rows = [
        (int(grp[a]), own[a:b].tobytes(), sizes[a:b].tobytes(), gaps[first[a] : c].tobytes())
        for a, b, c in zip(turn, ends, stops)
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _CUTS)], schema=_CUTS)


def _ship(size: int, parts: int, id_: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        docs = count = 0

        def flush():
            hash_ = np.concatenate([h for h, _, _ in held])
            code = np.concatenate([c for _, c, _ in held])
            at = np.concatenate([a for _, _, a in held])
            all_ids, all_keys = np.concatenate(ids), np.concatenate(keys)
            order, settled = _by_hash(hash_, all_ids[code])
            hash_, code, at = hash_[order], code[order], at[order]
            open_ = np.flatnonzero(~settled)
            bounds = np.r_[np.searchsorted(hash_[open_], range_edges(parts)), len(open_)]
            rows = []
            for p in range(parts):
                take = open_[bounds[p] : bounds[p + 1]]
                if len(take):
                    used, local = np.unique(code[take], return_inverse=True)
                    rows.append(
                        (p, 0, squeeze(np.diff(hash_[take], prepend=np.uint64(0))), squeeze(small(local)),
                         squeeze(small(at[take])), squeeze(all_ids[used]), squeeze(all_keys[used]))
                    )
            gone = np.flatnonzero(settled)
            if len(gone):
                gone = gone[np.lexsort((at[gone], code[gone]))]
                used, local = np.unique(code[gone], return_inverse=True)
                # Already decided: it only passes through, with any range.
                rows.append(
                    (int(all_keys[used[0]] % parts), 1, b"", squeeze(small(local)),
                     squeeze(small(at[gone])), b"", squeeze(all_keys[used]))
                )
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), _BLOCK)], schema=_BLOCK
            )

        for batch in batches:
            id_col = batch.column(batch.schema.get_field_index(id_)).cast(pa.int64()).fill_null(_LAST)
            key_col = batch.column(batch.schema.get_field_index("__key"))
            id_np, key_np = id_col.to_numpy(zero_copy_only=False), key_col.to_numpy(zero_copy_only=False)
            for words in chunks(batch.column(batch.schema.get_field_index(text))):
                hash_, first = windows(words, words.hashes(), size)
                if len(hash_):
                    owner = words.owner()[first]
                    held.append((hash_, (owner + docs).astype(np.uint32), first - words.first[owner]))
                    ids.append(id_np[words.row : words.row + words.texts].astype(np.int64))
                    keys.append(key_np[words.row : words.row + words.texts].astype(np.int64))
                    docs += words.texts
                    count += len(hash_)
                if count >= HELD:
                    yield flush()
                    held, ids, keys, docs, count = [], [], [], 0, 0
        if count:
            yield flush()

    return run


def _meet(groups: int):
    def run(block: pa.Table) -> pa.Table:
        hashes, docs, keys, ats, gone = [], [], [], [], []
        for kind, hash_, code, at, ids, key in zip(*(block.column(n).to_pylist() for n in ("kind", "hash", "code", "at", "ids", "keys"))):
            code, at, key = expand(code, np.int64), expand(at, np.int64), expand(key, np.int64)
            if kind:
                gone.append((key[code], at))
                continue
            hashes.append(np.cumsum(expand(hash_, np.uint64), dtype=np.uint64))
            docs.append(expand(ids, np.int64)[code])
            keys.append(key[code])
            ats.append(at)
        if hashes:
            order, repeated = _by_hash(np.concatenate(hashes), np.concatenate(docs))
            take = order[repeated]
            gone.append((np.concatenate(keys)[take], np.concatenate(ats)[take]))
        if not sum(len(k) for k, _ in gone):
            return _CUTS.empty_table()
        batch = _cut_rows(np.concatenate([k for k, _ in gone]), np.concatenate([a for _, a in gone]), groups)
        return pa.Table.from_batches([batch])

    return run


def _cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window that begins at one of ``starts``."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, total), -1)
    return np.cumsum(step[:-1]) > 0


def _without(words, d: int, removed: np.ndarray) -> str:
    """Text d less its removed words, each with the space that follows it."""
    first, last = words.first[d], words.first[d + 1]
    turn = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
    kept, at = [], words.text[d]
    for a, b in zip(turn[::2], turn[1::2]):
        kept.append(words.data[at : words.start[first + a]])
        at = words.start[first + b] if first + b < last else words.text[d + 1]
    kept.append(words.data[at : words.text[d + 1]])
    return b"".join(x.tobytes() for x in kept).decode("utf-8")


def _remove(size: int, text: str, made: str, out: pa.Schema):
    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        found: dict[int, list[np.ndarray]] = {}
        for keys, sizes, starts in zip(*(cuts.column(n).to_pylist() for n in ("keys", "sizes", "starts"))):
            ends = np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)[:-1]
            for key, gaps in zip(np.frombuffer(keys, np.int64), np.split(np.frombuffer(starts, np.uint32), ends)):
                found.setdefault(int(key), []).append(np.cumsum(gaps, dtype=np.int64))
        if not docs.num_rows:
            return out.empty_table()
        texts = docs.column(text).combine_chunks()
        keys = docs.column("__key").to_pylist()
        total = np.zeros(len(keys), np.int64)
        removed = np.zeros(len(keys), np.int64)
        changed: dict[int, str] = {}
        for words in chunks(texts):
            total[words.row : words.row + words.texts] = words.counts
            for d in range(words.texts):
                row = words.row + d
                if keys[row] in found:
                    gone = _cover(np.concatenate(found[keys[row]]), size, int(words.counts[d]))
                    removed[row] = gone.sum()
                    changed[row] = _without(words, d, gone)
        if changed:
            kept = texts.to_pylist()
            for row, value in changed.items():
                kept[row] = value
            texts = pa.array(kept, pa.string())
        new = {text: texts, f"{made}n_words": pa.array(total), f"{made}n_removed": pa.array(removed)}
        return pa.table([new[f.name] if f.name in new else docs.column(f.name) for f in out], schema=out)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
    carry: tuple[str, ...] = (), made: str = "",
) -> DataFrame:
    """Cut every word covered by a ``window``-word run that starts in a smaller id too.

    Returns ``id_col``, the ``carry`` columns, the text less its removed words
    (white space between kept words stays), ``n_words`` and ``n_removed``. Windows
    are judged on the input, not on what is left. ``made`` is put before the names of
    the two counts, should carried ones clash.

    A null text stays null with no words; texts shorter than the window keep
    everything. A null id comes after every other. Rows that share an id never cut
    each other; identical rows are cut alike. Extra columns are not read unless
    carried. Equal 64-bit hashes count as equal windows: with n windows in the
    table a given one is misjudged with probability n / 2^64.
    """
    spark = docs.sparkSession
    base = docs.select(id_col, text_col, *[c for c in carry if c not in (id_col, text_col)])
    size = text_bytes(base, text_col)
    parts, groups = parts_for(size, PART_BYTES), parts_for(size, GROUP_BYTES)
    # A row is known by its id and text, so that repeated ids stay apart.
    key = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))
    keyed = base.withColumn("__key", key)
    scratch = Scratch(spark, "repeats")
    blocks = keyed.select(id_col, text_col, "__key").mapInArrow(
        _ship(window, parts, id_col, text_col),
        "part long, kind int, hash binary, code binary, at binary, ids binary, keys binary",
    )
    cuts = blocks.groupBy("part").applyInArrow(_meet(groups), _CUTS_SQL)
    cuts = scratch.write(cuts, "cuts")
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = base.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = pa.schema(
        [f for f in to_arrow_schema(kept)] + [pa.field(f"{made}{n}", pa.int64()) for n in ("n_words", "n_removed")]
    )
    return (
        keyed.withColumn("__grp", F.col("__key") % groups)
        .groupBy("__grp")
        .cogroup(cuts.groupBy("grp"))
        .applyInArrow(_remove(window, text_col, made, out), f"{fields}, `{made}n_words` long, `{made}n_removed` long")
    )
