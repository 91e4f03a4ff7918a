import hashlib
import math
import random

import numpy as np
import pytest

from panelspark.llm import centroids

SIZE = 5


def plain(rows, clusters, rounds, scale=64.0):
    """(id, vector) rows -> sorted (id, cluster, distance), centroids; whole numbers throughout."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    seeds = [list(v) for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(seeds))
            out.append((i, c, d, v))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(seeds)):
            own = [v for _, k, _, v in found if k == c]
            if own:
                seeds[c] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i is None, i or 0, c, d) for i, c, d, _ in assign())), seeds


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = [(i, [draw.uniform(-2, 2) + 3 * (i % 4) for _ in range(SIZE)]) for i in range(200)]
    out += [(7, out[7][1]), (7, [0.0] * SIZE), (None, [1.0] * SIZE), (None, [1.0] * SIZE), (300, [5000.0, -9e5, 0.0, 1.0, 2.0])]
    out += [(400, None), (401, []), (402, [1.0] * 4), (403, [1.0] * 6), (404, [None, 1.0, 1.0, 1.0, 1.0])]
    return out + [(405, [math.nan] + [1.0] * 4), (406, [math.inf] + [1.0] * 4), (407, [-math.inf] * SIZE)]


def found(spark, rows, **more):
    schema = "vec_id long, embedding array<double>, id string, v int, cluster string, distance string"
    df = spark.createDataFrame([(i, v, "x", 1, "x", "x") for i, v in rows], schema)
    out, m = centroids.cluster(df, dimensions=SIZE, **more)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in out.collect()), m.tolist()


@pytest.mark.parametrize("clusters,rounds", [(6, 3), (1, 2), (300, 1), (4, 0)])
def test_clusters_as_by_whole_numbers(spark, rows, clusters, rounds):
    assert found(spark, rows, clusters=clusters, rounds=rounds) == plain(rows, clusters, rounds)


def test_equal_vectors_are_one_cluster(spark):
    same = [(i, [0.5] * SIZE) for i in range(20)]
    got, _ = found(spark, same, clusters=3)
    assert {r[2:] for r in got} == {(0, 0)}


def test_no_vectors(spark):
    out, m = centroids.cluster(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert centroids.with_totals(out, m).collect() == [] and len(m) == 0


def test_totals(spark, rows):
    schema = "vec_id long, embedding array<double>"
    got = centroids.with_totals(*centroids.cluster(spark.createDataFrame(rows, schema), dimensions=SIZE, clusters=5)).collect()
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for c in {r.cluster for r in got}:
        own = [r for r in got if r.cluster == c]
        assert {r.cluster_inertia for r in own} == {sum(r.distance for r in own)} and len({r.centroid_sha256 for r in own}) == 1
    assert centroids.digest(np.array([-1, 20])) == hashlib.sha256(b"-1,20").hexdigest()


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        found(spark, [(1, [1e30] * SIZE)])
