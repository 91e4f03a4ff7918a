"""Running combinations along an order, as a tree.

A running sum, or a running product of matrices, over any number of rows in order:
rows are packed into ranges, ranges into ranges of ranges, and so on. Going up, each
range is combined to one value; coming down, each range gets what lies before it. No
task sees more than one range of some level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ranges of one level that make a range of the next.
FAN = 4096


def levels_of(rows: DataFrame, at: str, fan: int | None = None) -> int:
    """Levels above the first that bring the places in ``at`` down to one range."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    fan, levels = fan or FAN, 0
    while low is not None and high // fan != low // fan:
        low, high, levels = low // fan, high // fan, levels + 1
    return levels


def identity(op: str, size: int) -> np.ndarray:
    return np.zeros(size) if op == "sum" else np.eye(size)


def _matrices(column, op: str, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, size) if op == "sum" else flat.reshape(-1, size, size)


def _join(op: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if op == "sum" else a @ b


def _lists(cells: list) -> pa.Array:
    flat = [np.asarray(c, float).reshape(-1) for c in cells]
    edges = np.r_[0, np.cumsum([len(c) for c in flat])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(flat) if flat else np.zeros(0)))


def _each(batch: pa.RecordBatch, op: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    """(places, values) of every packed range."""
    for i in range(len(batch)):
        rows = batch.column("rows")[i].values
        yield rows.field("at"), _matrices(rows.field("v"), op, size)


def _combined(op: str, size: int, keep: int):
    """Packed ranges -> one value each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, values in _each(batch, op, size):
                total = identity(op, size)
                for value in values:
                    total = _join(op, total, value)
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], _lists(out)], names=[*batch.schema.names[:keep], "v"])

    return run


def _spread(op: str, size: int, keep: int):
    """Packed ranges with what lies before them -> every row with what lies before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, times = [], [], []
            for i, (places, values) in enumerate(_each(batch, op, size)):
                carried = batch.column("before")[i].values
                total = identity(op, size) if carried is None else _matrices_of(carried, op, size)
                for value in values:
                    out.append(total)
                    total = _join(op, total, value)
                at.append(places)
                times.append(len(values))
            row = pa.array(np.repeat(np.arange(len(batch)), times))
            group = [batch.column(k).take(row) for k in range(keep)]
            places = pa.concat_arrays(at) if at else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*group, places, _lists(out)], names=[*batch.schema.names[:keep], "at", "before"])

    return run


def _matrices_of(values: pa.Array, op: str, size: int) -> np.ndarray:
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    return flat if op == "sum" else flat.reshape(size, size)


def before_each(rows: DataFrame, group: Sequence[str], op: str, size: int, levels: int, fan: int | None = None) -> DataFrame:
    """Rows (``group``, ``at``, ``before``) from rows (``group``, ``at``, ``v``).

    ``at`` is a whole number, once per group; ``v`` an array of ``size`` numbers to add up
    (``op`` "sum") or a matrix of ``size`` rows, row by row, to multiply from the right
    ("product"). ``before`` combines all rows of the group with a smaller ``at``. Sums are
    exact up to 2^53. ``levels`` says how often ranges of ``fan`` places are packed again;
    after the last level a group is one range.
    """
    group, fan = list(group), fan or FAN
    up = F.floor(F.col("at") / fan) if levels else F.lit(0)
    packed = rows.groupBy(*group, up.cast("long").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("rows"))
    own = T.StructType([packed.schema[c] for c in group])
    doubles = T.ArrayType(T.DoubleType())
    if levels:
        schema = T.StructType([*own, T.StructField("at", T.LongType()), T.StructField("v", doubles)])
        ups = packed.select(*group, F.col("_up").alias("at"), "rows").mapInArrow(_combined(op, size, len(group) + 1), schema)
        carried = before_each(ups, group, op, size, levels - 1, fan).withColumnRenamed("at", "_up")
        packed = packed.join(carried, [*group, "_up"])
    else:
        packed = packed.withColumn("before", F.lit(None).cast(doubles))
    schema = T.StructType([*own, T.StructField("at", T.LongType()), T.StructField("before", doubles)])
    return packed.select(*group, "rows", "before").mapInArrow(_spread(op, size, len(group)), schema)
