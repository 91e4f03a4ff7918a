"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Every place of a word begins a suffix of its piece of text, cut at the longest phrase's
words. A task sorts the pointers to the suffixes of its texts by three-way partitions,
one word deeper in each equal partition, so that equal suffixes become one entry with
their number. Entries are routed by their leading word, and where that word or its
pair with the next is hot in the whole corpus, by the leading two or three words, so
that no group is larger than its share of the text. Each group sorts its entries once
more: the size of an equal partition is the count of its phrase, and a partition that
is too small is abandoned, as no longer phrase in it can be frequent.

Entries travel as blocks, a dictionary of words and columns of word numbers. Blocks are
split level by level, ``FAN`` ways each, so that their number grows with the text and
their size stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.packed import expand, small, squeeze
from panelspark.llm.scratch import Scratch, parts_for
from panelspark.llm.words import BASE, LOWER, Words, mix

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
# Text of a block before it is sorted, and of a group of entries that is counted at once.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 8 << 20
# Ways in which one level splits a range of leading words.
FAN = 256
# Phrases that begin a larger share of the corpus' entries than this are routed one word deeper.
HOT = 1 / 1024
# Partitions of fewer pointers are sorted together, some many at a time.
SMALL, TOGETHER = 256, 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True


# --- sorting ------------------------------------------------------------------------------


def equal_partitions(keys: list[np.ndarray], weight: np.ndarray, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth the (pointer, weight) of every equal partition of at least ``least``.

    ``keys[d]`` holds the key of each row at depth d; pointers are row numbers, and
    a partition is named by one of its pointers. Pointers are split into less, equal and
    greater by a middle key; the equal ones go on at the next depth. Small partitions
    are set aside and finished together by one sort over all their depths.
    """
    depths = len(keys)
    found: list[list] = [[] for _ in range(depths)]
    aside, held = [], 0
    stack = [(np.arange(len(weight)), 0)]
    while stack:
        at, depth = stack.pop()
        if not len(at) or weight[at].sum() < least:
            continue  # no part of it can be large enough
        if len(at) <= SMALL:
            aside.append((at, depth))
            held += len(at)
            if held >= TOGETHER:
                _finish(aside, keys, weight, least, found)
                aside, held = [], 0
            continue
        key = keys[depth][at]
        some = key[:: 1 + len(key) // 64]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        less, equal = key < pivot, key == pivot
        stack.append((at[less], depth))
        stack.append((at[~(less | equal)], depth))
        at = at[equal]
        total = weight[at].sum()
        if total >= least:
            found[depth].append((at[:1], np.array([total])))
            if depth + 1 < depths:
                stack.append((at, depth + 1))
    _finish(aside, keys, weight, least, found)
    none = np.zeros(0, np.int64)
    return [
        (np.concatenate([p for p, _ in f] or [none]), np.concatenate([w for _, w in f] or [none]).astype(np.int64)) for f in found
    ]


def _finish(aside: list, keys: list[np.ndarray], weight: np.ndarray, least: int, found: list[list]) -> None:
    if not aside:
        return
    at = np.concatenate([a for a, _ in aside])
    depth = np.repeat([d for _, d in aside], [len(a) for a, _ in aside])
    part = np.repeat(np.arange(len(aside)), [len(a) for a, _ in aside])
    # A partition's keys above its depth are equal, so that sorting by all keys is right.
    order = np.lexsort((*[k[at] for k in reversed(keys)], part))
    at, depth, part = at[order], depth[order], part[order]
    new = np.ones(len(at), bool)
    new[1:] = part[1:] != part[:-1]
    for d, key in enumerate(keys):
        own = key[at]
        new[1:] |= own[1:] != own[:-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(weight[at], first)
        keep = (total >= least) & (depth[first] <= d)
        found[d].append((at[first[keep]], total[keep]))


# --- blocks of entries --------------------------------------------------------------------


@dataclass
class Block:
    """Distinct suffixes with their numbers.

    ``keys`` has the language's number, then word numbers from 1 on, 0 behind the
    end of a piece. ``level`` is how many leading words route an entry.
    """

    langs: list[str]
    words: pa.Array
    keys: list[np.ndarray]
    count: np.ndarray
    level: np.ndarray

    def take(self, at: np.ndarray) -> Block:
        return Block(self.langs, self.words, [k[at] for k in self.keys], self.count[at], self.level[at])


_BLOCK = pa.schema(
    [(c, pa.int64()) for c in ("part", "grp", "bytes", "entries")] + [("langs", pa.list_(pa.string())), ("words", pa.binary())]
    + [("keys", pa.list_(pa.binary())), ("count", pa.binary()), ("level", pa.binary())]
    + [("hot", pa.list_(pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])))]
)
_BLOCK_SQL = (
    "part long, grp long, bytes long, entries long, langs array<string>, words binary, keys array<binary>, count binary, level binary, "
    "hot array<struct<lang:string,phrase:string,n:long>>"
)


def _pack(block: Block, part: int, grp: int, size: int, hot: list) -> tuple:
    """A block as a row, with the words that occur in it only."""
    used = np.zeros(len(block.words) + 1, bool)
    for key in block.keys[1:]:
        used[key] = True
    used[0] = True
    place = np.cumsum(used) - 1
    langs, lang = np.unique(block.keys[0], return_inverse=True)
    words = " ".join(block.words.take(pa.array(np.flatnonzero(used)[1:] - 1)).to_pylist()).encode()
    text = np.int64(len(words)).tobytes() + pa.compress(words, codec="zstd", asbytes=True)
    keys = [squeeze(small(lang)), *[squeeze(small(place[key])) for key in block.keys[1:]]]
    return (
        part, grp, size, len(block.count), [block.langs[i] for i in langs], text, keys, squeeze(small(block.count)),
        squeeze(block.level), hot,
    )


def _spell(blob: bytes) -> list[str]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    return raw.decode().split(" ")


def _unpack(rows: pa.Table) -> Block:
    """All blocks of a table as one, their numbers brought to one dictionary."""
    lists = [pa.array(_spell(b), pa.large_string()) for b in rows.column("words").to_pylist()]
    dictionary = pa.chunked_array(lists).combine_chunks().dictionary_encode()
    number = np.r_[0, dictionary.indices.to_numpy().astype(np.int64) + 1]
    langs: dict[str, int] = {}
    keys, count, level, at = [], [], [], 0
    for own, row, n, deep, words in zip(
        rows.column("langs").to_pylist(), rows.column("keys").to_pylist(), rows.column("count").to_pylist(),
        rows.column("level").to_pylist(), lists,
    ):
        codes = np.array([langs.setdefault(x, len(langs)) for x in own], np.int64)
        place = np.r_[0, number[1 + at : 1 + at + len(words)]]
        keys.append([codes[expand(row[0], np.int64)], *[place[expand(k, np.int64)] for k in row[1:]]])
        count.append(expand(n, np.int64))
        level.append(expand(deep, np.uint8))
        at += len(words)
    return Block(
        list(langs), dictionary.dictionary, [np.concatenate(k) for k in zip(*keys)], np.concatenate(count), np.concatenate(level)
    )


def _merge(block: Block) -> Block:
    """Equal entries as one."""
    at, total = equal_partitions(block.keys, block.count)[-1]
    out = block.take(at)
    out.count = total
    return out


def suffixes(texts: pa.Array, langs: pa.Array, longest: int) -> Block:
    """The suffixes of some texts (no nulls), each with the number 1."""
    texts = texts.cast(pa.large_string())
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(values, np.uint8)[ends[0] : ends[-1]]] if values is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    between = _BREAK[data]
    inside = ~(between | _SPACE[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    shown = np.r_[False, inside, False]
    start = np.flatnonzero(shown[1:] & (edge | ~shown[:-1]))
    stop = np.flatnonzero(shown[:-1] & (edge | ~shown[1:]))
    if not len(start):
        return Block([], pa.array([], pa.large_string()), [np.zeros(0, np.int64)] * (longest + 1), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    # Word bytes end to end are an Arrow string array, which numbers its distinct words.
    named = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(np.r_[0, np.cumsum(stop - start)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))
    ).dictionary_encode()
    code = named.indices.to_numpy().astype(np.int32) + 1
    text = np.searchsorted(ends, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(between), start)
    keys = [code]
    for d in range(1, longest):
        deeper = np.zeros(len(code), np.int32)
        same = (text[d:] == text[:-d]) & (piece[d:] == piece[:-d])
        deeper[: len(code) - d][same] = code[d:][same]
        keys.append(deeper)
    own = langs.dictionary_encode()
    lang = own.indices.to_numpy().astype(np.int32)[text]
    return Block(own.dictionary.to_pylist(), named.dictionary, [lang, *keys], np.ones(len(code), np.int64), np.zeros(len(code), np.uint8))


def _hot_leads(block: Block, share: float) -> list[tuple[str, str, int]]:
    """Leading words and pairs that begin more than a share of the block's entries."""
    out, least = [], share * len(block.count)
    found = equal_partitions(block.keys[:-1], np.ones(len(block.count), np.int64), max(1, int(least)))
    for depth, (at, total) in enumerate(found[1:], 1):
        for i, n in zip(at[total > least], total[total > least]):
            codes = [int(k[i]) for k in block.keys[1 : depth + 1]]
            if codes[-1]:
                out.append((block.langs[block.keys[0][i]], " ".join(block.words[c - 1].as_py() for c in codes), int(n)))
    return out


def _blocks(longest: int, share: float, block_bytes: int):
    """Documents (text, lang) -> one row per block of sorted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            some = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = _merge(suffixes(some.column(0), some.column(1), longest))
            if not len(block.count):
                return
            row = _pack(block, 0, 0, size, [dict(zip(("lang", "phrase", "n"), x)) for x in _hot_leads(block, share)])
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _BLOCK.types)], schema=_BLOCK)

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(batch):
                room = np.searchsorted(np.cumsum(sizes[at:]), max(1, block_bytes - size), "left") + 1
                some = batch.slice(at, int(room))
                held.append(some)
                size += int(sizes[at : at + len(some)].sum())
                at += len(some)
                if size >= block_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


# --- routing ------------------------------------------------------------------------------

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string, for routing only."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    strings = strings.cast(pa.large_string())
    _, offsets, values = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    return Words(data, ends[[0, -1]], ends[:-1], ends[1:], np.array([0, len(strings)]), 0).hashes()


def _routes(block: Block, hot: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """How many leading words route each entry, and their hash."""
    lang = {x: i for i, x in enumerate(block.langs)}
    level = np.ones(len(block.count), np.uint8)
    phrases = [(lang[a], p.split(" ")) for a, p in hot if a in lang]
    each = sorted({w for _, p in phrases for w in p})
    found = pc.index_in(pa.array(each, block.words.type), block.words).to_pylist()
    code = {w: c + 1 for w, c in zip(each, found) if c is not None}
    at, wide = np.arange(len(level)), len(block.words) + 1
    lead = block.keys[0].astype(np.int64)
    for depth in range(1, len(block.keys) - 1):
        # A lead as one number; a hot lead's own leads are hot, so that few rows are left to look at.
        own = []
        for a, p in phrases:
            if len(p) == depth and all(w in code for w in p):
                for w in p:
                    a = a * wide + code[w]
                own.append(a)
        lead = lead * wide + block.keys[depth][at]
        keep = np.isin(lead, np.array(own, np.int64))
        at, lead = at[keep], lead[keep]
        level[at] = depth + 1
    names = _hashes(pa.array([x.encode() for x in block.langs], pa.large_binary()).cast(pa.large_string()))
    spelled = np.r_[np.uint64(1), _hashes(block.words)]
    with np.errstate(over="ignore"):
        route = names[block.keys[0]] * _SPREAD if len(names) else np.zeros(len(level), np.uint64)
        for depth, key in enumerate(block.keys[1:], 1):
            deeper = mix(route * BASE + spelled[key])
            route = np.where(level >= depth, deeper, route)
    return level, mix(route)


def _part_of(route: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges each hash is in."""
    return ((route >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _split(block: Block, route: np.ndarray, parts: int, grp: int, size: int) -> list[tuple]:
    """A row per range of routes that the block has entries in."""
    part = _part_of(route, parts)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
    return [
        _pack(block.take(order[a:b]), int(part[order[a]]), grp, max(1, size * int(b - a) // len(order)), None)
        for a, b in zip(edge, edge[1:])
    ]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(_BLOCK), _BLOCK.types)], schema=_BLOCK)


def _dealt(hot: list[tuple[str, str]], parts: int, groups: int):
    """Blocks of a task -> blocks per range of leading words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = pa.Table.from_batches([batch.slice(at, 1)])
                block = _unpack(one)
                block.level, route = _routes(block, hot)
                grp = TaskContext.get().partitionId() % groups
                yield from _table(_split(block, route, parts, grp, one.column("bytes")[0].as_py())).to_batches()

    return run


def _dealt_again(hot: list[tuple[str, str]], parts: int, groups: int):
    """Blocks of one range -> merged blocks per finer range."""

    def run(rows: pa.Table) -> pa.Table:
        block = _merge(_unpack(rows))
        block.level, route = _routes(block, hot)
        grp = TaskContext.get().partitionId() % groups
        return _table(_split(block, route, parts, grp, sum(rows.column("bytes").to_pylist())))

    return run


_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def _counted(longest: int, least: int):
    """Entries of one range -> counts of its phrases, of its hot leads in part, and of all words per language."""

    def run(rows: pa.Table) -> pa.Table:
        block = _unpack(rows)
        out = []
        for level in np.unique(block.level):
            own = block.take(np.flatnonzero(block.level == level))
            # Leads shorter than the route are counted in other ranges, too: none is too small there.
            whole = equal_partitions(own.keys, own.count, least)
            every = equal_partitions(own.keys[: int(level)], own.count, 1)
            for depth in range(longest + 1):
                at, total = every[depth] if depth < level else whole[depth]
                codes = [k[at] for k in own.keys[1 : depth + 1]]
                if depth:
                    keep = np.flatnonzero(codes[-1])
                    at, total, codes = at[keep], total[keep], [c[keep] for c in codes]
                spelled = [own.words.take(pa.array(c - 1)) for c in codes]
                phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())) if depth else pa.array([""] * len(at), pa.large_string())
                lang = pa.array(own.langs, pa.string()).take(pa.array(own.keys[0][at]))
                out.append(pa.table([lang, phrase.cast(pa.string()), pa.array(np.full(len(at), depth, np.int32)), pa.array(total)], schema=_COUNT))
        return pa.concat_tables(out)

    return run


def phrase_counts(
    docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, fan: int = FAN, hot_share: float = HOT,
) -> DataFrame:
    """Rows (lang, phrase, words, n) of phrases found ``least`` times or more; 0 words: all of a language's."""
    rows = docs.select(
        F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    blocks = scratch.write(rows.mapInArrow(_blocks(longest, hot_share / 2, block_bytes), _BLOCK_SQL), "blocks")
    size, entries = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    # Blocks name the leads of more than half the share of their own entries, so that a
    # lead of the whole share is named for half of it at least. The list has 2 / share
    # leads of each length at most, whatever the corpus.
    named = blocks.select(F.explode("hot").alias("h")).groupBy("h.lang", "h.phrase").agg(F.sum("h.n").alias("n"))
    hot = [(r["lang"], r["phrase"]) for r in named.where(F.col("n") >= entries * hot_share / 2).collect()]
    parts = parts_for(size, group_bytes)
    # Ranges of the levels: fan, fan * fan ... and all parts at last.
    levels = [parts]
    while levels[0] > fan:
        levels.insert(0, -(-levels[0] // fan))
    dealt = blocks
    for k, now in enumerate(levels):
        # Blocks of one range go to so many groups that each has its share of the text.
        groups = 1 if now == parts else max(1, -(-size // (now * group_bytes * 2)))
        if k == 0:
            dealt = blocks.mapInArrow(_dealt(hot, now, groups), _BLOCK_SQL)
        else:
            dealt = scratch.write(
                dealt.groupBy("part", "grp").applyInArrow(_dealt_again(hot, now, groups), _BLOCK_SQL), f"level-{k}"
            )
    found = dealt.groupBy("part").applyInArrow(_counted(longest, least), "lang string, phrase string, words int, n long")
    total = found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return scratch.write(total.where((F.col("words") == 0) | (F.col("n") >= least)), "counts")



# --- phrases ------------------------------------------------------------------------------


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP,
    lang_col: str = "lang", text_col: str = "text", **sizes,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces, pieces at
    blanks and tabs into words. Phrases of 2 to ``longest`` words found a >= ``least`` times
    are candidates. Their score is floor(1000000 * a * a / (l * r)) for the counts l and r of
    the two parts of the cut that scores least (ties: the first such cut). A candidate
    goes if a longer one holds its words in a row and is found in ``covered`` percent or
    more of its places. Each language has its first ``top`` by score, a (both descending)
    and phrase (by bytes). All counts cover whole texts of all rows: repeated rows
    and ids count each, extra columns are not read. A null language is ``und``, a null
    text empty; no words give no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, scratch, longest, least, lang_col, text_col, **sizes)
    words, m = F.split("phrase", " "), F.col("words")
    candidates = counts.where(m > 1)
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    # Parts of a frequent phrase are as frequent, so that all are among the counts.
    parts = counts.where(m > 0)
    scored = (
        cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        .withColumn("score", F.expr("CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    )
    inside = candidates.where(m > 2).select(
        "lang", "n", words.alias("w"), m.alias("m"), F.explode(F.sequence(F.lit(2), m - 1)).alias("size")
    )
    inside = inside.select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
    longer = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where(m == 0).select("lang", F.col("n").alias("n_words"))
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        F.col("n_words").alias("n"), F.col("cut.score").alias("score"),
    )


def oracle(longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> str:
    """The same in SQL over the table ``documents``."""
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS p, {k} AS m FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i "
        f"FROM pieces WHERE len(ws) >= {k}) x"
        for k in range(1, longest + 1)
    )
    cuts = " UNION ALL ".join(
        f"SELECT lang, p, n, {k} AS k, array_to_string(w[1:{k}], ' ') AS f, array_to_string(w[{k + 1}:], ' ') AS s FROM c WHERE m > {k}"
        for k in range(1, longest)
    )
    inside = " UNION ALL ".join(
        f"SELECT lang, n, array_to_string(w[{i}:{i + k - 1}], ' ') AS p FROM c WHERE m >= {max(k + 1, i + k - 1)}"
        for k in range(2, longest)
        for i in range(1, longest - k + 2)
    )
    return f"""
WITH lines AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
pieces AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM lines),
f AS MATERIALIZED (SELECT lang, p, m, count(*) AS n FROM ({grams}) g GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(p, ' ') AS w FROM f WHERE m > 1 AND n >= {least}),
cut AS (SELECT x.lang, x.p, x.n AS a, k, l.n AS l, r.n AS r,
               CAST(1000000::HUGEINT * x.n * x.n // (l.n::HUGEINT * r.n) AS BIGINT) AS score
        FROM ({cuts}) x JOIN f l ON l.lang = x.lang AND l.p = x.f JOIN f r ON r.lang = x.lang AND r.p = x.s),
best AS (SELECT lang, p, a, unnest(arg_min({{'l': l, 'r': r, 'score': score}}, (score, k))) FROM cut GROUP BY lang, p, a),
longer AS (SELECT lang, p, max(n) AS n FROM ({inside}) i GROUP BY lang, p),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank
           FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.p = b.p WHERE coalesce(100 * o.n < {covered} * a, TRUE))
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, p AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, score
FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= {top}"""
