"""Multi-state occupancy from counting-process intervals.

Input rows are intervals (days0, days] with the state they start in (``state0``)
and the state they end in (``state``, or ``censor`` when the end is not an
observed state). Intervals are counted into one row per distinct time before
anything ordered happens. Times are packed into ranges of ``SPAN`` units; sums before
a range and products of transition matrices over it are carried along the ranges by a
tree (``scan``), so that no task sees more than one range of times or of ranges,
whatever the clock, and all ranges are followed side by side.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.functions.dates import plus_days
from panelspark.operators import scan
from panelspark.session import ship
from panelspark.sources.stages import Stages

STATES = (1, 2, 3)

# Units of time in one range: some 250 rows where the clock is days.
SPAN = 256


def usable_intervals(df: DataFrame, states: Sequence = STATES) -> DataFrame:
    """Intervals of positive length with a known end that start in one of ``states``."""
    return df.filter(
        (F.col("days0") < F.col("days"))
        & F.col("state0").isin(*states)
        & F.col("state").isNotNull()
    )


def _counts(df: DataFrame, states: Sequence, censor, by: Sequence[str]) -> DataFrame:
    """One row per time: changes ``d_i`` of the numbers at risk, moves ``e_i_j``, ends."""
    by = list(by)
    starts = F.struct(F.col("days0").alias("time"), F.lit(1).alias("step"))
    ends = F.struct(F.col("days").alias("time"), F.lit(-1).alias("step"))
    points = usable_intervals(df, states).select(
        *by, "state0", "state", F.inline(F.array(starts, ends))
    )
    is_end = F.col("step") == -1
    seen = is_end & (F.col("state") != censor)

    def tally(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    counts = points.groupBy(*by, "time").agg(
        tally(is_end).alias("n_end"),
        tally(seen).alias("n_seen"),
        *[F.sum(F.when(F.col("state0") == i, F.col("step")).otherwise(0)).alias(f"d_{i}") for i in states],
        *[
            tally(seen & (F.col("state0") == i) & (F.col("state") == j)).alias(f"e_{i}_{j}")
            for i in states
            for j in states
            if i != j
        ],
    )
    return counts


def _ranges(df: DataFrame, states: Sequence, censor, by: Sequence[str], span: float) -> tuple[DataFrame, int]:
    """One row per range of times: its rows in order, and ``before``, how many came into each state earlier.

    ``rows`` holds time, n_end, n_seen, the changes ``d`` of the numbers at risk and the moves
    ``e``, from each state to each other. Also the levels of a tree over the ranges.
    """
    ship(df.sparkSession)
    group = _group(by)
    pairs = [(i, j) for i in states for j in states if i != j]
    counts = _counts(df, states, censor, by).withColumns({"_all": F.lit(0), "at": F.floor(F.col("time") / span).cast("long")})
    row = F.struct(
        "time", "n_end", "n_seen", F.array(*[F.col(f"d_{i}").cast("double") for i in states]).alias("d"),
        F.array(*[F.col(f"e_{i}_{j}").cast("double") for i, j in pairs]).alias("e"),
    )
    sums = [F.sum(F.col(f"d_{i}").cast("double")) for i in states]
    packed = counts.groupBy(*group, "at").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.array(*sums).alias("v"))
    # Read several times from here on, and small beside the intervals: a row per time at most.
    packed = Stages(df.sparkSession, name="ranges").write(packed, "ranges")
    levels = scan.levels_of(packed, "at")
    before = scan.before_each(packed.select(*group, "at", "v"), group, "sum", len(states), levels)
    return packed.drop("v").join(before, [*group, "at"]), levels


def _numbers(batch: pa.RecordBatch, i: int, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: its rows, those with an end, numbers at risk and hazards (rows of a matrix per time)."""
    rows = batch.column("rows")[i].values
    d = rows.field("d").flatten().to_numpy().reshape(-1, size)
    e = np.zeros((len(rows), size, size))
    e[:, ~np.eye(size, dtype=bool)] = rows.field("e").flatten().to_numpy().reshape(len(rows), size * (size - 1))
    risk = batch.column("before")[i].values.to_numpy() + d.cumsum(0) - d
    hazard = np.divide(e, risk[:, :, None], out=np.zeros_like(e), where=risk[:, :, None] > 0)
    ends = np.flatnonzero(rows.field("n_end").to_numpy() > 0)
    return rows, ends, risk, e, hazard


def _steps(hazard: np.ndarray) -> np.ndarray:
    """One matrix per time: what moves, and what stays."""
    out = hazard.copy()
    k = range(hazard.shape[1])
    out[:, k, k] = 1 - hazard.sum(2)
    return out


def _begins(rows: pa.Array, e: np.ndarray, start_at: str) -> np.ndarray:
    return rows.field("n_seen").to_numpy() > 0 if start_at == "first_event" else e.sum((1, 2)) > 0


def _products(size: int, start_at: str, keep: int):
    """Ranges -> the product of their matrices, the shares where the curve may begin, and those at the last end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            products, begun, last = [], [], []
            for i in range(len(batch)):
                rows, ends, risk, e, hazard = _numbers(batch, i, size)
                total = np.eye(size)
                for step in _steps(hazard):
                    total = total @ step
                products.append(total.reshape(-1).tolist())
                shares = risk / np.maximum(risk.sum(1, keepdims=True), 1)
                first = np.flatnonzero(_begins(rows, e, start_at))
                begun.append(shares[first[0]].tolist() if len(first) else None)
                last.append(shares[ends[-1]].tolist() if len(ends) else None)
            lists = [pa.array(c, pa.list_(pa.float64())) for c in (products, begun, last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *lists], names=[*batch.schema.names[:keep], "v", "begun", "last"])

    return run


def _followed(size: int, start_at: str, keep: int, curve: bool):
    """Ranges -> one row per end time: numbers at risk and moves; with ``curve`` hazards and the shares after it."""
    names = ["n_end", "n_seen", "n", "e", *(["h", "p", "begins"] if curve else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, ends, risk, e, hazard = _numbers(batch, i, size)
                at = pa.array(ends)
                columns = [rows.field(c).take(at) for c in ("n_end", "n_seen")] + [_lists(risk[ends]), _lists(e[ends])]
                if curve:
                    ahead = batch.column("ahead")[i].values
                    p = batch.column("start")[i].values.to_numpy()
                    p = p @ (np.eye(size) if ahead is None else ahead.to_numpy().reshape(size, size))
                    path = np.zeros((len(rows), size))
                    for t, step in enumerate(_steps(hazard)):
                        path[t] = p = p @ step
                    columns += [_lists(hazard[ends]), _lists(path[ends]), pa.array(_begins(rows, e, start_at)[ends])]
                group = [batch.column(k).take(pa.array(np.full(len(ends), i))) for k in range(keep)]
                yield pa.RecordBatch.from_arrays(
                    [*group, rows.field("time").take(at), *columns], names=[*batch.schema.names[:keep], "time", *names]
                )

    return run


def _lists(values: np.ndarray) -> pa.Array:
    width = int(np.prod(values.shape[1:]))
    edges = pa.array(np.arange(len(values) + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(values).reshape(-1)))


def _times(ranges: DataFrame, group: list[str], size: int, start_at: str, curve: bool) -> DataFrame:
    time = ranges.schema["rows"].dataType.elementType["time"].dataType
    doubles = T.ArrayType(T.DoubleType())
    fields = [("time", time), ("n_end", T.LongType()), ("n_seen", T.LongType()), ("n", doubles), ("e", doubles)]
    if curve:
        fields += [("h", doubles), ("p", doubles), ("begins", T.BooleanType())]
    schema = T.StructType([*[ranges.schema[c] for c in group], *[T.StructField(n, t) for n, t in fields]])
    return ranges.mapInArrow(_followed(size, start_at, len(group), curve), schema)


def time_table(
    df: DataFrame, states: Sequence = STATES, censor=0, by: Sequence[str] = (), span: float = SPAN
) -> DataFrame:
    """One row per time: risk set and transition counts.

    Columns: ``n_i`` at risk in state i just before the time, ``e_i_j`` moves
    from i to j at it, ``n_end`` intervals ending there and ``n_seen`` of them
    not censored. One aggregate over the intervals, combined before its shuffle.
    """
    states, group = list(states), _group(by)
    ranges, _ = _ranges(df, states, censor, by, span)
    table = _times(ranges.select(*group, "rows", "before"), group, len(states), "first_event", False)
    size = len(states)
    return table.select(
        *by, "time", "n_end", "n_seen", *[F.col("n")[i].cast("long").alias(f"n_{s}") for i, s in enumerate(states)],
        *[F.col("e")[i * size + j].cast("long").alias(f"e_{a}_{b}") for i, a in enumerate(states) for j, b in enumerate(states) if i != j],
    )


def _group(by: Sequence[str]) -> list[str]:
    """Grouping columns; ``_all`` is the same in every row."""
    return list(by) or ["_all"]


def _stack(columns: Sequence[Column]) -> Column:
    return F.inline(F.array(*columns))


def risk_sets(df: DataFrame, states: Sequence = STATES, censor=0, by: Sequence[str] = ()) -> DataFrame:
    """Number at risk per end time and state."""
    table = time_table(df, states, censor, by)
    rows = [F.struct(F.lit(i).alias("state"), F.col(f"n_{i}").alias("n_risk")) for i in states]
    return table.select(*by, "time", _stack(rows))


def transition_counts(df: DataFrame, censor=0, states: Sequence = STATES, by: Sequence[str] = ()) -> DataFrame:
    """Number of moves per time, from-state and to-state."""
    moved = (F.col("state") != F.col("state0")) & (F.col("state") != censor)
    return (
        usable_intervals(df, states)
        .filter(moved)
        .groupBy(*by, F.col("days").alias("time"), "state0", "state")
        .agg(F.count("*").alias("n"))
    )


def paths(df: DataFrame, states: Sequence, censor=0, by: Sequence[str] = (), start_at: str = "first_event", span: float = SPAN) -> DataFrame:
    """Per end time the numbers at risk ``n``, moves ``e`` and hazards ``h`` (matrices row by row), and shares ``p`` after it.

    ``begins`` marks times at which the curve may begin.
    """
    if start_at not in ("first_event", "first_transition"):
        raise ValueError(f"unknown start_at {start_at!r}")
    group, size = _group(by), len(states)
    ranges, levels = _ranges(df, states, censor, by, span)
    doubles = T.ArrayType(T.DoubleType())
    own = [ranges.schema[c] for c in (*group, "at")]
    made = T.StructType([*own, *[T.StructField(c, doubles) for c in ("v", "begun", "last")]])
    products = ranges.select(*group, "at", "rows", "before").mapInArrow(_products(size, start_at, len(group) + 1), made)
    ahead = scan.before_each(products.select(*group, "at", "v"), group, "product", size, levels).withColumnRenamed("before", "ahead")
    # The risk set at the first time where the curve begins; if nothing ever happens, at the last.
    starts = products.groupBy(*group).agg(
        F.coalesce(
            F.min_by("begun", F.when(F.col("begun").isNotNull(), F.col("at"))), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("at")))
        ).alias("start")
    )
    packed = ranges.join(ahead, [*group, "at"]).join(starts, group).select(*group, "rows", "before", "ahead", "start")
    return _times(packed, group, size, start_at, True)


def state_occupancy(
    df: DataFrame,
    states: Sequence = STATES,
    censor=0,
    origin: dt.date | None = None,
    by: Sequence[str] = (),
    start_at: str = "first_event",
    decimals: int | None = None,
    span: float = SPAN,
) -> DataFrame:
    """Aalen-Johansen share of persons in each state over time.

    Rows (time, state, n_risk, n_event, estimate) for every end time; ``n_event``
    counts moves into the state. The curve starts from the shares among persons
    at risk at the first event: the first end that is not censored, or with
    ``start_at="first_transition"`` the first change of state. ``origin`` adds
    ``date``, the calendar day of a day count. ``span`` is the time that is
    folded at once.
    """
    by, states = list(by), list(states)
    curve, size = paths(df, states, censor, by, start_at, span), len(states)
    into = [sum((F.col("e")[i * size + j] for i in range(size) if i != j), F.lit(0.0)).cast("long") for j in range(size)]
    out = curve.select(
        *by,
        "time",
        _stack(
            [
                F.struct(
                    F.lit(i).alias("state"),
                    F.col("n")[k].cast("long").alias("n_risk"),
                    into[k].alias("n_event"),
                    (F.col("p")[k] if decimals is None else F.round(F.col("p")[k], decimals)).alias("estimate"),
                )
                for k, i in enumerate(states)
            ]
        ),
    )
    if origin is not None:
        out = out.withColumn("date", plus_days(F.lit(origin), F.col("time")))
    return out


def occupancy_wide(
    df: DataFrame,
    states: Sequence = STATES,
    censor=0,
    origin: dt.date | None = None,
    by: Sequence[str] = (),
    start_at: str = "first_event",
    span: float = SPAN,
) -> DataFrame:
    """The curve with one row per time, as ``curve_wide`` has it, straight from the fold."""
    by, states = list(by), list(states)
    curve = paths(df, states, censor, by, start_at, span)
    time = F.col("time") if origin is None else plus_days(F.lit(origin), F.col("time")).alias("date")
    return _with_totals(curve.select(*by, time, *[F.col("p")[k].alias(f"risk{i}") for k, i in enumerate(states)]), states)


def _with_totals(wide: DataFrame, states: Sequence) -> DataFrame:
    standard = list(states) == list(STATES)
    names = ["no_multi", "multi", "death"] if standard else [f"upto{i}" for i in states]
    return wide.withColumns(
        {
            name: reduce(lambda a, b: a + b, [F.col(f"risk{i}") for i in states[: k + 1]])
            for k, name in enumerate(names)
        }
    )


def curve_wide(curve: DataFrame, states: Sequence = STATES, time: str = "time") -> DataFrame:
    """One row per time: ``risk{state}`` and their running totals for stacking.

    The totals of states 1, 2, 3 are ``no_multi``, ``multi``, ``death``; for other
    states they are named after the last state they hold, ``upto{state}``.
    """
    wide = curve.groupBy(time).pivot("state", list(states)).agg(F.first("estimate"))
    wide = wide.withColumnsRenamed({str(i): f"risk{i}" for i in states})
    return _with_totals(wide, states)
