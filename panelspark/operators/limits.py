"""Standard errors and confidence limits of the occupancy curve.

The variance is that of the infinitesimal jackknife: the curve's derivative in the
weight of each person, squared and added up over persons. At each time a person's
derivative moves on by the curve's transition matrix, and a person at risk adds what
its own weight changes in that matrix. So persons are independent given the curve:
groups of them fold side by side through the times, block of times after block of
times, and return one sum of squares per time and state. A block of times is what every
task needs to know at once, and its size is bounded; between blocks the persons'
derivatives are kept in a table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.dates import plus_days
from panelspark.operators import survival
from panelspark.session import ship
from panelspark.sources.stages import Stages

# Persons of a group, folded by one task; times of a block, sent to every task.
PERSONS = 8192
TIMES = 20_000


@dataclass
class _Block:
    """Times of a block: numbers at risk, hazards and the shares just before each."""

    time: np.ndarray
    risk: np.ndarray  # (times, states)
    step: np.ndarray  # (times, states, states): rows of hazards, minus their sum on the diagonal
    before: np.ndarray  # (times, states)


def _block(rows: pa.Table, states: int, start: np.ndarray) -> tuple[_Block, np.ndarray]:
    """The block and the shares after its last time."""
    rows = rows.sort_by("time")
    flat = lambda name, *shape: rows.column(name).combine_chunks().flatten().to_numpy().astype(float).reshape(-1, *shape)
    step, after = flat("h", states, states), flat("p", states)
    step[:, range(states), range(states)] = -step.sum(2)
    before = np.r_[start[None], after[:-1]]
    return _Block(rows.column("time").to_numpy(), flat("n", states), step, before), after[-1]


def _fold(block: _Block, first, start: np.ndarray, at_start: float, opening: bool):
    """Intervals of a group, and what is known of its persons -> sums of squares per time, and the persons again.

    ``first`` is the time whose risk set of ``at_start`` intervals makes the ``start``
    shares; they are part of the derivative from the ``opening`` block on.
    """
    k = len(start)
    scale = np.divide(block.before, block.risk, out=np.zeros_like(block.before), where=block.risk > 0)
    # What a person at risk in state a adds: the expected moves, with a minus.
    drift = -scale[:, :, None] * block.step
    matrix = np.eye(k) + block.step

    def run(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
        ids = pa.chunked_array([rows.column("id").combine_chunks(), known.column("id").combine_chunks()]).combine_chunks()
        names = ids.dictionary_encode(null_encoding="encode")
        place = names.indices.to_numpy()
        who, kept = place[: len(rows)], place[len(rows) :]
        begins, ends = rows.column("days0").to_numpy(), rows.column("days").to_numpy()
        state, into = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        u = np.zeros((len(names.dictionary), k))
        if len(kept):
            u[kept] = known.column("u").combine_chunks().flatten().to_numpy().reshape(-1, k)
        if opening:
            at = np.flatnonzero((begins < first) & (ends >= first))
            np.add.at(u, (who[at], state[at]), 1 / at_start)
            np.subtract.at(u, who[at], start / at_start)
        # An interval is at risk from the first time after its begin to its end.
        low, high = np.searchsorted(block.time, begins, "right"), np.searchsorted(block.time, ends, "right")
        risk = np.zeros_like(u)
        at = np.flatnonzero((low == 0) & (high > 0))
        np.add.at(risk, (who[at], state[at]), 1.0)
        enters = [[] for _ in range(len(block.time) + 1)]
        leaves = [[] for _ in range(len(block.time) + 1)]
        for i in np.flatnonzero((low > 0) & (low < high)):
            enters[low[i]].append(i)
        for i in np.flatnonzero((high > 0) & (low < high)):
            leaves[high[i]].append(i)
        squares = np.zeros((len(block.time), k))
        for t in range(len(block.time)):
            if enters[t]:
                np.add.at(risk, (who[enters[t]], state[enters[t]]), 1.0)
            if leaves[t]:
                np.subtract.at(risk, (who[leaves[t]], state[leaves[t]]), 1.0)
            u = u @ matrix[t] + risk @ drift[t]
            over = [i for i in leaves[t + 1] if into[i] >= 0 and into[i] != state[i] and ends[i] == block.time[t]]
            if over:
                own = scale[t, state[over]]
                np.add.at(u, (who[over], into[over]), own)
                np.subtract.at(u, (who[over], state[over]), own)
            squares[t] = (u * u).sum(0)
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * k), pa.array(m.reshape(-1)))
        none = lambda n, kind: pa.nulls(n, kind)
        grp, parts = key[0].as_py(), []
        for kind, n, time, name, cells in (
            (0, len(squares), pa.array(block.time), none(len(squares), ids.type), lists(squares)),
            (1, len(u), none(len(u), pa.array(block.time).type), names.dictionary, lists(u)),
        ):
            parts.append(
                pa.table(
                    [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, grp, np.int64)), time, name, cells],
                    names=["kind", "grp", "time", "id", "u"],
                )
            )
        return pa.concat_tables(parts)

    return run


def occupancy_limits(
    df: DataFrame,
    key: str = "id",
    states: Sequence = survival.STATES,
    censor=0,
    origin: dt.date | None = None,
    start_at: str = "first_event",
    level: float = 0.95,
    scale: str = "log",
    decimals: int | None = None,
    persons: int = PERSONS,
    times: int = TIMES,
) -> DataFrame:
    """The occupancy curve with ``std_error``, ``low`` and ``high`` per time and state.

    Rows (time, state, estimate, std_error, low, high) for every end time, ``date`` as well
    with ``origin``. All intervals of one ``key`` count as one observation; rows without
    a key are one person. Limits hold for ``level`` on the ``log`` scale (no limits where the
    share is 0, none above 1) or the ``plain`` one. Intervals that the curve does not use
    are left out here, too; no intervals give no rows.
    """
    if scale not in ("log", "plain"):
        raise ValueError(f"unknown scale {scale!r}")
    states, spark = list(states), df.sparkSession
    ship(spark)
    stages = Stages(spark, name="limits")
    curve = stages.write(survival.paths(df, states, censor, [], start_at).select("time", "begins", "n", "h", "p"), "curve")
    total, first, last = curve.agg(F.count("*"), F.min(F.when(F.col("begins"), F.col("time"))), F.max("time")).first()
    out = curve.select("time", "p")
    if total:
        first = last if first is None else first
        risk = np.array(curve.where(F.col("time") == F.lit(first)).first()["n"])
        start, shares = risk / risk.sum(), risk / risk.sum()
        at = {state: i for i, state in enumerate(states)}

        def number(column: Column) -> Column:
            return F.coalesce(*[F.when(column == F.lit(s), F.lit(i)) for s, i in at.items()], F.lit(-1))

        used = survival.usable_intervals(df, states)
        into = F.when(F.col("state") == F.lit(censor), F.lit(-1)).otherwise(number(F.col("state")))
        groups = F.pmod(F.xxhash64(F.col(key)), F.lit(max(1, -(-used.select(key).distinct().count() // persons))))
        rows = used.select(
            groups.alias("grp"), F.col(key).alias("id"), "days0", "days", number(F.col("state0")).alias("a"), into.alias("b")
        )
        rows = stages.write(rows, "intervals")
        blocks = -(-total // times)
        edges = curve.agg(F.percentile_approx("time", [b / blocks for b in range(1, blocks)])).first()[0] if blocks > 1 else []
        edges = [None, *sorted(set(edges)), None]
        kind, clock = rows.schema["id"].dataType.simpleString(), curve.schema["time"].dataType.simpleString()
        known = rows.select("grp", "id").limit(0).withColumn("u", F.array().cast("array<double>"))
        sums = None
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            some = curve
            if low is not None:
                some = some.where(F.col("time") > F.lit(low))
            if high is not None:
                some = some.where(F.col("time") <= F.lit(high))
            found = some.select("time", "n", "h", "p").toArrow()
            if not len(found):
                continue
            block, shares = _block(found, len(states), shares)
            fold = _fold(block, first, start, float(risk.sum()), sums is None)
            both = rows.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(
                fold, f"kind int, grp long, time {clock}, id {kind}, u array<double>"
            )
            done = stages.write(both, f"block-{b}")
            known = done.where("kind = 1").select("grp", "id", "u")
            part = done.where("kind = 0").select("time", "u")
            sums = part if sums is None else sums.unionByName(part)
        variance = sums.groupBy("time").agg(*[F.sum(F.col("u")[i]).alias(f"v{i}") for i in range(len(states))])
        out = out.join(variance, "time")
    else:
        out = out.withColumns({f"v{i}": F.lit(0.0) for i in range(len(states))})
    z = NormalDist().inv_cdf(0.5 + level / 2)
    rounded = (lambda c: c) if decimals is None else (lambda c: F.round(c, decimals))
    cells = []
    for i, state in enumerate(states):
        p, se = F.col("p")[i], F.sqrt(F.col(f"v{i}"))
        if scale == "log":
            low, high = (F.when(p > 0, p * F.exp(sign * z * se / p)) for sign in (-1, 1))
            high = F.when(high > 1, F.lit(1.0)).otherwise(high)
        else:
            low, high = p - z * se, p + z * se
        named = {"estimate": p, "std_error": se, "low": low, "high": high}
        cells.append(F.struct(F.lit(state).alias("state"), *[rounded(v).alias(c) for c, v in named.items()]))
    out = out.select("time", F.inline(F.array(*cells)))
    return out if origin is None else out.withColumn("date", plus_days(F.lit(origin), F.col("time")))
