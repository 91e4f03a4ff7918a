"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents with n and m distinct shingles reach ``percent`` of their union only
if they share T = ceil(percent * (n + m) / (100 + percent)) of them. DivideSkip sorts
a document's inverted lists by length and sets L long ones aside: whatever reaches T
occurrences must occur T - L times or more in the short ones. L is as large as that
allows for any partner, ceil(percent * n / 100) - 1: merging a list moves its
postings through the cluster, while probing one costs a binary search. Short lists
are merged first (in Spark: a join on the shingle), which finds the pairs. A
document's lists travel as one packed row, in order of length; for each pair the
short ones are counted, pairs below T - L go, and the long ones are probed, shortest
first, until T is reached or out of reach. Whether a list holds a document is looked
up from the document's side, by binary search for the shingle in its sorted lists:
the same entry of the same inverted index, without the list in one place.

List lengths are exact: groups of documents ask for the number of documents of each
of their shingles, packed by range of hashes, and the ranges answer. The rarest
shingles of most documents are theirs alone, so that few lists are left to search.

A group of copies would bring all its pairs into its lists. Classes of equal sets
are therefore joined by one member, and each list is searched from a few leaders at
a time: documents already in one component need no test, so a list of g copies
costs g tests. Lists leave once their members are one component or all have led.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.llm.packed import expand, range_edges, small, squeeze
from panelspark.llm.scratch import Scratch, parts_for, text_bytes
from panelspark.llm.words import LOWER, Words, chunks, mix, windows

# Text of a group of documents, and of a range of hashes.
GROUP_BYTES, PART_BYTES = 4 << 20, 8 << 20
# Leaders that search a list in one round: few in the first rounds, which join what
# is linked, more in the later ones, which have only the rest of the lists to search.
MAIN_ROUNDS, MAIN_LEADERS, LEADERS = 2, 2, 256


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (text number, hash), in that order.

    A text with fewer words than ``size`` has one shingle, all its words.
    """
    hashes = words.hashes(LOWER)
    code, at = windows(words, hashes, size)
    owner = words.owner()
    text, found = [owner[at]], [code]
    for short in range(1, size):
        code, at = windows(words, hashes, short)
        keep = words.counts[owner[at]] == short
        text.append(owner[at[keep]])
        found.append(mix(code[keep] + np.uint64(short)))
    text, found = np.concatenate(text), np.concatenate(found)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return text[new], found[new]


# --- lengths of the inverted lists ---------------------------------------------------

_ASK = pa.schema([("part", pa.int64()), ("grp", pa.int64()), ("hash", pa.binary()), ("docs", pa.binary())])
_TELL = pa.schema([("grp", pa.int64()), ("part", pa.int64()), ("docs", pa.binary())])


def _ask(size: int, parts: int):
    """Per group of documents and range of hashes: its shingles, and how many documents have each."""

    def run(docs: pa.Table) -> pa.Table:
        found = [shingle_sets(words, size)[1] for words in chunks(docs.column("text"))]
        each, count = np.unique(np.concatenate(found), return_counts=True)
        if not len(each):
            return _ASK.empty_table()
        bounds = np.r_[np.searchsorted(each, range_edges(parts)), len(each)]
        grp = docs.column("grp")[0].as_py()
        rows = [
            (p, grp, squeeze(np.diff(each[a:b], prepend=np.uint64(0))), squeeze(small(count[a:b])))
            for p, (a, b) in enumerate(zip(bounds, bounds[1:]))
            if b > a
        ]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), _ASK)], schema=_ASK)

    return run


def _tell(asked: pa.Table) -> pa.Table:
    """For every group its shingles' numbers of documents in the whole corpus."""
    hashes = [np.cumsum(expand(x, np.uint64), dtype=np.uint64) for x in asked.column("hash").to_pylist()]
    docs = np.concatenate([expand(x, np.int64) for x in asked.column("docs").to_pylist()])
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=docs).astype(np.int64)[inverse]
    part = asked.column("part")[0].as_py()
    ends = np.cumsum([len(h) for h in hashes])
    rows = [
        (grp, part, squeeze(small(total[end - len(h) : end])))
        for grp, h, end in zip(asked.column("grp").to_pylist(), hashes, ends)
    ]
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), _TELL)], schema=_TELL)


# --- sets, their classes and lists -----------------------------------------------------


def _needed(n, percent: int):
    """Least overlap of a set of n with any set that it is linked with."""
    return -(-percent * n // 100)


_SETS = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("short", "place")] + [("lists", pa.binary())]
)
_SETS_SQL = "id long, n long, sig1 long, sig2 long, short array<bigint>, place array<bigint>, lists binary"


def _sets(size: int, percent: int):
    """A row per document: size and signature of its set, its short lists, their places
    among all its lists, shortest first, and the shingles of all its lists in that order.

    Lists of one document are left out: nobody else is found there. Documents without a
    short list meet nobody and need no lists at all.
    """

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SETS.empty_table()
        parts = [(words, *shingle_sets(words, size)) for words in chunks(docs.column("text"))]
        each, inverse = np.unique(np.concatenate([code for _, _, code in parts]), return_inverse=True)
        told = told.sort_by("part")
        length = np.concatenate([expand(x, np.int64) for x in told.column("docs").to_pylist()] or [np.zeros(0, np.int64)])
        length, at, made = length[inverse], 0, []
        for words, owner, code in parts:
            own = length[at : at + len(code)]
            at += len(code)
            n = np.bincount(owner, minlength=words.texts)
            first = np.r_[0, np.cumsum(n)]
            sums = np.zeros((2, len(code) + 1), np.uint64)
            np.cumsum(mix(code + np.uint64(1)), out=sums[0, 1:])
            np.cumsum(mix(code ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
            sig = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
            order = np.lexsort((code, own, owner))
            place = np.arange(len(code)) - first[owner]
            rank = np.empty(len(code), np.int64)
            rank[order] = place
            shared = own[order] > 1
            take = order[(place < (n - _needed(n, percent) + 1)[owner]) & shared]
            short = np.bincount(owner[take], minlength=words.texts)
            offsets = np.r_[0, np.cumsum(short)].astype(np.int32)
            every = order[shared & (short > 0)[owner]]
            edges = np.r_[0, 8 * np.cumsum(np.bincount(owner[every], minlength=words.texts))].astype(np.int32)
            buffers = [None, pa.py_buffer(edges), pa.py_buffer(code[every].tobytes())]
            lists = pa.Array.from_buffers(pa.binary(), words.texts, buffers)
            cells = [(offsets, code[take].view(np.int64)), (offsets, rank[take])]
            made.append(
                [pa.array(n), pa.array(sig[0]), pa.array(sig[1]), *[pa.ListArray.from_arrays(pa.array(o), pa.array(v)) for o, v in cells], lists]
            )
        return pa.table([docs.column("id"), *[pa.chunked_array(c) for c in zip(*made)]], schema=_SETS)

    return run


# --- long lists ------------------------------------------------------------------------


def _occurs(lists: np.ndarray, other: np.ndarray) -> int:
    """In how many of ``lists`` the document with the sorted shingles ``other`` stands."""
    at = np.searchsorted(other, lists)
    return int((other[np.minimum(at, len(other) - 1)] == lists).sum())


def _reaches(lists: np.ndarray, short: int, other: np.ndarray, needed: int) -> bool:
    """Whether ``other`` occurs ``needed`` times in ``lists``, the first ``short`` of them short."""
    got, at, step = _occurs(lists[:short], other), short, 32
    # The first turn asks for T - L occurrences in the short lists.
    while got < needed <= got + len(lists) - at:
        got += _occurs(lists[at : at + step], other)
        at, step = min(at + step, len(lists)), 2 * step
    return got >= needed


def _probe(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column
            n = [cells(c).to_numpy(zero_copy_only=False) for c in (2, 3)]
            needed = -(-percent * (n[0] + n[1]) // (100 + percent))
            short, keep = cells(4).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, bool)
            for row, (one, two) in enumerate(zip(cells(5), cells(6))):
                lists = np.frombuffer(one.as_buffer(), np.uint64)
                other = np.sort(np.frombuffer(two.as_buffer(), np.uint64))
                keep[row] = _reaches(lists, int(short[row]), other, int(needed[row]))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([cells(0).filter(keep), cells(1).filter(keep)], schema=schema)

    return run


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles`` and ``component_id``.

    Documents are linked when 100 * |intersection| >= percent * |union| of their
    distinct ``size``-word shingles (A-Z lower-cased). ``component_id`` is the smallest
    id reached by links, the document itself included. A null or blank text has no
    shingles and no links; shorter texts have one shingle, the whole sequence. Rows
    of one id count as one document that has all their links; a null id is linked
    with nothing and keeps a null component. Extra columns are not read. Shingles are
    compared by a 64-bit hash.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = text_bytes(base, "text")
    groups, parts = parts_for(total, GROUP_BYTES), parts_for(total, PART_BYTES)
    grouped = base.withColumn("grp", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    asked = grouped.select("grp", "text").groupBy("grp").applyInArrow(_ask(size, parts), "part long, grp long, hash binary, docs binary")
    told = scratch.write(asked.groupBy("part").applyInArrow(_tell, "grp long, part long, docs binary"), "told")
    made = grouped.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_sets(size, percent), _SETS_SQL)
    made = scratch.write(made, "sets")
    scratch.drop("told")
    # One member stands for all documents with the same set.
    known = made.where(F.col("id").isNotNull() & (F.col("n") > 0))
    equal = scratch.write(
        known.groupBy("sig1", "sig2", "n")
        .agg(F.min("id").alias("rep"), F.max("id").alias("m"))
        .where("rep <> m")
        .drop("m"),
        "equal",
    )
    rows = scratch.write(
        known.join(equal, ["sig1", "sig2", "n"], "left").select(
            "id", "n", F.coalesce("rep", "id").alias("rep"), F.arrays_zip("short", "place").alias("short")
        ),
        "rows",
    )
    copies = rows.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    postings = rows.where("id = rep").select(F.explode("short").alias("x"), "id", "n")
    # What follows a list's place is all a document can share with one it meets there first.
    postings = postings.select(
        F.col("x.short").alias("token"), "id", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("x.place")).cast("int").alias("m")
    )
    lists = postings.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    members = scratch.write(postings.join(lists.select("token"), "token").withColumn("comp", F.col("id")), "members-0")
    packed = made.where(F.size("short") > 0).select("id", "n", F.size("short").alias("short"), "lists")
    packed = scratch.write(packed.join(members.select("id").distinct(), "id", "left_semi"), "packed")
    links = tested = None
    turn = 0
    while not members.isEmpty():
        # Leaders of a list: first some of its largest component, whom most others are
        # linked with; then the others.
        turn += 1
        main = F.lit(0) if turn <= MAIN_ROUNDS else F.when(F.col("comp") == F.col("main"), 1).otherwise(0)
        if turn > 1:
            members = members.join(_largest(members), "token")
        order = Window.partitionBy("token").orderBy(main, "id") if turn > 1 else Window.partitionBy("token").orderBy("id")
        leaders = scratch.write(
            members.withColumn("__r", F.row_number().over(order))
            .where(F.col("__r") <= (MAIN_LEADERS if turn <= MAIN_ROUNDS else LEADERS))
            .select("token", F.col("id").alias("lead"), F.col("n").alias("lead_n"), F.col("m").alias("lead_m"), F.col("comp").alias("lead_comp")),
            f"leaders-{turn}",
        )
        near = (
            members.join(leaders, "token")
            .where("id <> lead AND comp <> lead_comp")
            .where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
            # A pair is found at the first list it shares; there its overlap has room.
            .where((100 + percent) * F.least("m", "lead_m") >= percent * (F.col("n") + F.col("lead_n")))
            .select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
            .distinct()
        )
        if tested is not None:
            near = near.join(tested, ["a", "b"], "left_anti")
        near = scratch.write(near, f"pairs-{turn}")
        tested = near if tested is None else tested.union(near)
        found = (
            near.join(packed.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "short", F.col("lists").alias("lists_a")), "a")
            .join(packed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("lists").alias("lists_b")), "b")
            .select("a", "b", "n_a", "n_b", "short", "lists_a", "lists_b")
            .mapInArrow(_probe(percent), "a long, b long")
        )
        found = scratch.write(found, f"links-{turn}")
        links = found if links is None else links.union(found)
        members = members.select("token", "id", "n", "m", "comp").join(
            leaders.select("token", F.col("lead").alias("id")), ["token", "id"], "left_anti"
        )
        if not found.isEmpty():
            comps = components(links, scratch, f"labels-{turn}").withColumnRenamed("comp", "new")
            members = members.join(comps, "id", "left").withColumn("comp", F.coalesce("new", "id")).drop("new")
        # Lists whose members are one component are done.
        mixed = members.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
        members = scratch.write(members.join(mixed.select("token"), "token").select("token", "id", "n", "m", "comp"), f"members-{turn}")
        scratch.drop(f"members-{turn - 1}", f"leaders-{turn}")
    linked = copies if links is None else links.union(copies)
    comps = components(linked, scratch, "final")
    return made.select("id", "n").join(comps, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")
    )


def _largest(members: DataFrame) -> DataFrame:
    """(token, main): each list's component with the most members."""
    sizes = members.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("token").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
