"""Running sums and products as a tree against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_survival import SCHEMA, aalen_johansen, histories

from panelspark.operators import scan, survival


@pytest.mark.parametrize("op,size,fan,levels", [("sum", 2, 3, 4), ("product", 2, 3, 4), ("product", 3, 50, 2), ("sum", 1, 4, 0)])
def test_what_lies_before_each_row(spark, op, size, fan, levels):
    rng = np.random.default_rng(size)
    rows = []
    for group in ("a", "b", None):
        at = sorted(rng.choice(1000, 60, replace=False).tolist())
        rows += [(group, a, rng.integers(0, 9, size).astype(float).tolist() if op == "sum" else rng.dirichlet([1.0] * size, size).reshape(-1).tolist()) for a in at]
    df = spark.createDataFrame(rows, "g string, at long, v array<double>").repartition(5)
    got = scan.before_each(df.where("g IS NOT NULL"), ["g"], op, size, levels, fan).collect()
    assert len(got) == 120
    for group in "ab":
        total = np.zeros(size) if op == "sum" else np.eye(size)
        found = {r.at: r.before for r in got if r.g == group}
        for _, at, v in (r for r in rows if r[0] == group):
            assert np.allclose(found[at], total.reshape(-1), atol=1e-12)
            total = total + v if op == "sum" else total @ np.array(v).reshape(size, size)


def test_a_fine_clock_needs_no_larger_task(spark, monkeypatch):
    """Hundreds of thousands of ranges, most of them with one time, at the default span."""
    data = [(i, a * 7_919_999, b * 7_919_999, s, t) for i, a, b, s, t in histories(3)]
    monkeypatch.setattr(scan, "FAN", 64)
    curve = survival.state_occupancy(spark.createDataFrame(data, SCHEMA.replace("int, state0", "long, state0").replace("days0 int", "days0 long").replace("days int", "days long")))
    got = {(r.time, r.state): r.estimate for r in curve.collect()}
    want = {(t, s): p[i] for t, p in aalen_johansen(data).items() for i, s in enumerate((1, 2, 3))}
    assert got.keys() == want.keys() and max(abs(got[c] - want[c]) for c in want) < 1e-12


def test_many_times_equal_the_plain_fold(spark):
    """A time per second for two days, against one fold over all of them."""
    n = 172_800
    df = spark.range(n).select(
        F.col("id"), F.lit(0).cast("long").alias("days0"), (F.col("id") + 1).alias("days"), F.lit(1).alias("state0"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, 0).otherwise(2).alias("state"),
    )
    curve = survival.state_occupancy(df, states=(1, 2)).where("state = 1").toArrow().sort_by("time")
    moved = np.array([r.state == 2 for r in df.orderBy("id").select("state").collect()])
    want = np.cumprod(1 - moved / np.arange(n, 0, -1))
    assert np.allclose(curve.column("estimate").to_numpy(), want, atol=1e-12) and len(curve) == n
