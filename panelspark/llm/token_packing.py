"""Bounded-space online packing of token ids into training sequences.

Every partition reads its documents once and keeps a fixed number of open windows. A
document, cut where it exceeds a window, goes to the open window that it fills best.
When none has room and no further window may be opened, the fullest is emitted,
topped up with the head of the document where that leaves no crumbs. What is open at
the end of a partition is merged: groups of partitions pack their leftover pieces in
the same way, groups of groups the next time, until one group is left, which fills
its last sequences up. Texts never travel, and only leftovers are shuffled.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from panelspark.llm.scratch import Scratch, ship
from panelspark.llm.words import LOWER

CAPACITY = 4096  # ids, a power of two
OPEN = 32  # windows open at once in a partition
LEAST = 16  # a piece cut to top a window up, and what remains of it, has at least so many ids
END = 2  # id behind every document
FAN = 16  # partitions whose leftovers are merged by one task
# A tokenizer file larger than this is not sent to the tasks.
TOKENIZER_BYTES = 64 << 20
# Documents tokenized at a time, parts of words spelled at a time, bytes of parts that a worker remembers.
DOCS, TOGETHER, KEPT_BYTES = 1024, 4096, 8 << 20

# Parts of a sequence id: level of merging, partition or group, running number.
_LEVEL, _PART = 1 << 58, 1 << 34


# --- tokens -----------------------------------------------------------------------------


# Fixed value: how the tokenizer's file spells bytes.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# Kinds of bytes in plain text: letters are a-z and the two-byte ones from U+00C0 to U+023F.
_SPACE, _LETTER, _DIGIT, _SIGN, _WORD = range(5)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x80:0xC0] = _LETTER
_KIND[0xC3:0xC9] = _LETTER
# Words with these are no plain text, or are cut by their apostrophe.
_ODD = np.zeros(256, bool)
_ODD[0xC9:] = True
_ODD[[0xC0, 0xC1, 0xC2, ord("'")]] = True


def cut(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (behind) of each part of the texts ``edges[d]:edges[d + 1]``.

    A part is what the tokenizer spells on its own: letters, a digit, a run of signs.
    A word that is not plain is one part, which the tokenizer may cut further.
    """
    kind = _KIND[data]
    odd = _ODD[data]
    # A sign among the letters (two), and a capital that becomes two code points.
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    odd[:-1] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)
    text = np.zeros(len(data) + 1, bool)
    text[edges] = True
    inside = np.r_[False, kind != _SPACE, False]
    first = np.flatnonzero(inside[1:] & (text | ~inside[:-1]))
    behind = np.flatnonzero(inside[:-1] & (text | ~inside[1:]))
    for at in np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1):
        kind[first[at] : behind[at]] = _WORD
    shown = np.r_[np.uint8(_SPACE), kind, np.uint8(_SPACE)]
    edge = text | (shown[1:] != shown[:-1]) | (shown[1:] == _DIGIT)
    start = np.flatnonzero(edge & (shown[1:] != _SPACE))
    end = np.flatnonzero(edge & (shown[:-1] != _SPACE))
    return start, end


class _Ids(dict):
    """Ids of parts as little-endian 32-bit bytes, for one tokenizer file.

    Letters are spelled many at a time, without the tokenizer's steps that change
    nothing in them; the last token of a part is marked as the end of a word.
    """

    def __init__(self, blob: str):
        self.held = 0
        self.tokenizer = Tokenizer.from_str(blob)
        bare = json.loads(blob)
        bare |= {"normalizer": None, "added_tokens": []}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _BYTES]}
        self.letters = Tokenizer.from_str(json.dumps(bare))
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> None:
        plain = [p for p in parts if _KIND[p[0]] == _LETTER and LETTERS.fullmatch(p)]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            text = b" ".join(some).decode().lower()
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edge = np.flatnonzero(self.ends[ids]) + 1
            if len(edge) != len(some):
                raise ValueError("this tokenizer does not mark the ends of words")
            raw, edge = ids.tobytes(), (4 * edge).tolist()
            self.update((w, raw[a:b]) for w, a, b in zip(some, [0, *edge], edge))
        others = [p for p in parts if p not in self]
        self.update(zip(others, self.whole([p.decode("utf-8", "replace") for p in others])))
        self.held += sum(map(len, parts))

    def forget(self) -> None:
        """Keep what is remembered within bounds."""
        if self.held > KEPT_BYTES:
            self.clear()
            self.held = 0


LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+")


@lru_cache(maxsize=1)
def _ids(blob: str) -> _Ids:
    return _Ids(blob)


def tokenize(texts: pa.Array, blob: str) -> Iterator[bytes]:
    """Ids of each text as bytes, without an end; a null text is empty."""
    known = _ids(blob)
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, values = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(values, np.uint8)[edges[0] : edges[-1]]] if values is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    # A text that may hold the name of a special token goes through the tokenizer as it is.
    named = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    named = np.unique(np.searchsorted(edges, named, "right") - 1)
    for at in named:
        data[edges[at] : edges[at + 1]] = 0x20
    apart = dict(zip(named.tolist(), known.whole([texts[int(at)].as_py().decode("utf-8", "replace") for at in named])))
    start, end = cut(data, edges)
    # Part bytes end to end are an Arrow array, which numbers the distinct parts.
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[_KIND[data] != _SPACE]))]
    ).dictionary_encode()
    each = parts.dictionary.to_pylist()
    known.learn([p for p in each if p not in known])
    spelled = [known[p] for p in each]
    known.forget()
    size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
    ids = np.frombuffer(b"".join(spelled), "<u4")
    first = np.cumsum(size) - size
    code = parts.indices.to_numpy()
    count = size[code]
    behind = np.cumsum(count)
    total = int(behind[-1]) if len(behind) else 0
    out = ids[np.repeat(first[code] - (behind - count), count) + np.arange(total)].tobytes()
    ends = 4 * np.r_[0, behind][np.searchsorted(start, edges)]
    for at, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        yield apart[at] if at in apart else out[a:b]


# --- windows ----------------------------------------------------------------------------


class Packer:
    """Open windows of one partition; pieces are (id, start, ids as bytes, ids of the document).

    ``done`` holds (piece, sequence number, offset) of emitted sequences.
    """

    def __init__(self, capacity: int = CAPACITY, open_windows: int = OPEN, least: int = LEAST):
        self.capacity, self.open_windows, self.least = capacity, open_windows, least
        self.windows: dict[int, list] = {}
        self.order: list[tuple[int, int]] = []  # (room, window), ascending
        self.done: list[tuple] = []
        self.opened = self.emitted = 0

    def add(self, piece: tuple) -> None:
        key, start, ids, total = piece
        size = len(ids) // 4
        while size >= self.capacity:
            self._emit([(key, start, ids[: 4 * self.capacity], total)])
            start, ids, size = start + self.capacity, ids[4 * self.capacity :], size - self.capacity
        while size:
            at = bisect_left(self.order, (size, -1))
            if at < len(self.order):
                room, window = self.order.pop(at)
            elif len(self.order) < self.open_windows:
                room, window = self.capacity, self.opened
                self.windows[window] = []
                self.opened += 1
            else:
                room, window = self.order.pop(0)
                head = min(room, size - self.least)
                if head >= self.least:
                    self.windows[window].append((key, start, ids[: 4 * head], total))
                    start, ids, size = start + head, ids[4 * head :], size - head
                self._emit(self.windows.pop(window))
                continue
            self.windows[window].append((key, start, ids, total))
            if room > size:
                insort(self.order, (room - size, window))
            else:
                self._emit(self.windows.pop(window))
            return

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((piece, self.emitted, offset))
            offset += len(piece[2]) // 4
        self.emitted += 1

    def left(self) -> list[tuple]:
        """(piece, window, place) of the windows that are open."""
        return [(piece, window, at) for _, window in self.order for at, piece in enumerate(self.windows[window])]

    def finish(self) -> None:
        """Fill sequences with all that is left, the last ones as powers of two, so that nothing is padded."""
        pieces = [piece for piece, _, _ in self.left()]
        rest = sum(len(p[2]) // 4 for p in pieces)
        self.windows, self.order = {}, []
        at = 0
        while rest:
            room = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1)
            rest -= room
            taken = []
            while room:
                key, start, ids, total = pieces[at]
                part = ids[: 4 * room]
                taken.append((key, start, part, total))
                room -= len(part) // 4
                if len(part) < len(ids):
                    pieces[at] = (key, start + len(part) // 4, ids[len(part) :], total)
                else:
                    at += 1
            self._emit(taken)


def _schema(kind: T.DataType) -> T.StructType:
    fields = [("id", kind), ("start", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]
    fields += [("part", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _rows(packer: Packer, level: int, part: int, schema: pa.Schema, last: bool) -> pa.Table:
    """What the packer has emitted since the last call and, at the end, what is left."""
    if packer.emitted >= _PART or part >= _LEVEL // _PART:
        raise ValueError("more sequences or partitions than sequence ids are made for")
    base = level * _LEVEL + part * _PART
    rows = [(*piece, part, base + n, offset) for piece, n, offset in packer.done]
    if last:
        rows += [(*piece, part, None, window) for piece, window, _ in packer.left()]
    packer.done = []
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(schema), schema.types)], schema=schema)


def _online(tokenizer, settings: tuple, end: int, schema: pa.Schema):
    stop = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part = Packer(*settings), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), DOCS):
                some = batch.slice(at, DOCS)
                for key, ids in zip(some.column(0).to_pylist(), tokenize(some.column(1), tokenizer.value)):
                    ids += stop
                    packer.add((key, 0, ids, len(ids) // 4))
                yield from _rows(packer, 0, part, schema, False).to_batches()
        yield from _rows(packer, 0, part, schema, True).to_batches()

    return run


def _merged(settings: tuple, level: int, last: bool, schema: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        packer, part = Packer(*settings), key[0].as_py()
        pieces = sorted(
            zip(*[rows.column(c).to_pylist() for c in ("part", "offset", "id", "start", "ids", "doc_tokens")]),
            key=lambda r: (-len(r[4]), r[0], r[1], r[3], r[2] is None, r[2] or 0, r[4]),
        )
        for _, _, key_, start, ids, total in pieces:  # largest first
            packer.add((key_, start, ids, total))
        if last:
            packer.finish()
        return _rows(packer, level, part, schema, True)

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    open_windows: int = OPEN, least: int = LEAST, end: int = END, fan: int = FAN,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids, a power of two.

    ``id_col``, ``start`` (ids of the document before the piece), ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` (ids before the piece
    in its sequence). A document is the ids that the ``tokenizers`` file gives its text,
    without special tokens around it, then ``end``; a null or empty text is the end
    alone. A sequence is full, or less than 2 * ``least`` short of it, or, for the very
    last ones, as long as a smaller power of two. Null and repeated ids and equal rows
    keep their pieces; extra columns are not read; no rows give no sequences. Windows
    take documents in the order of the input's partitions, so sequences depend on
    how the input is split, pieces of one run fit together.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as file:
        blob = file.read(TOKENIZER_BYTES + 1)
    if len(blob) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is too large to be sent to the tasks")
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    schema = _schema(docs.schema[id_col].dataType)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    settings = (capacity, open_windows, least)
    scratch = Scratch(spark, "token-packing")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = _online(spark.sparkContext.broadcast(blob), settings, end, arrow)
    placed = scratch.write(rows.mapInArrow(run, schema), "level-0")
    out = placed.where("sequence_id IS NOT NULL")
    level, last = 0, False
    while not last:
        left = placed.where("sequence_id IS NULL")
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break
        level, last = level + 1, parts < fan
        groups = left.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group")
        placed = scratch.write(groups.applyInArrow(_merged(settings, level, last, arrow), schema), f"level-{level}")
        out = out.unionByName(placed.where("sequence_id IS NOT NULL"))
    return out.drop("part").withColumnRenamed("id", id_col)
