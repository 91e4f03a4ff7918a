"""Centroid clustering by scalar lookup tables.

Components become whole numbers, so that a distance is an exact sum of squared
differences of whole numbers. In every round each batch of vectors tabulates, per
dimension, the squared difference of each whole number that occurs in it and each
centroid's component; the distances are gathers from these tables, added up over
the dimensions. Only the centroids go to the tasks, and only sums per centroid and
dimension come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.scratch import Scratch

DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64.0, 16, 3
SEED = "1"
# Vectors whose tables and distances are held at once.
BATCH = 8192


def largest_component(dimensions: int) -> int:
    """Whole numbers up to this size have distances that fit into 62 bits."""
    return int((2**62 / dimensions) ** 0.5 / 2)


def _whole(dimensions: int, scale: float):
    """Vectors with all components there and finite, as whole numbers."""
    limit = largest_component(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            right = lists.is_valid().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(right & (sizes == dimensions))
            flat = lists.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, dimensions)  # a null component reads as not a number
            finite = np.isfinite(x).all(1)
            whole = np.floor(x[finite] * scale)
            if len(whole) and np.abs(whole).max() > limit:
                raise ValueError(f"a component beyond {limit / scale}: distances would not fit into whole numbers of 64 bits")
            whole = whole.astype(np.int64)
            offsets = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at[finite])), pa.ListArray.from_arrays(offsets, pa.array(whole.reshape(-1)))],
                names=["id", "v"],
            )

    return run


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the smaller number), and the squared distance.

    One table per dimension: a row per whole number that occurs there, a column per
    centroid. Numbers that lie close together are their own place in the table,
    others are ranked first.
    """
    total = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        x, c = v[:, d], centroids[:, d]
        low, high = int(x.min()), int(x.max())
        if high - low < 4 * len(x) + 1024:
            occurring, place = np.arange(low, high + 1), x - low
        else:
            occurring, place = np.unique(x, return_inverse=True)
        table = (occurring[:, None] - c[None, :]) ** 2
        total += table[place]
    best = total.argmin(1)
    return best, total[np.arange(len(v)), best]


def _vectors(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) of some rows at a time."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    v = flat.reshape(-1, dimensions)
    for at in range(0, len(v), BATCH):
        yield at, v[at : at + BATCH]


def _sums(centroids: np.ndarray):
    """Per centroid of a task: number and component sums of its vectors."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python's whole numbers do not overflow, however many vectors a task has.
        count, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for batch in batches:
            for _, v in _vectors(batch, dimensions):
                own, _ = nearest(v, centroids)
                count += np.bincount(own, minlength=k)
                order = np.argsort(own, kind="stable")
                edge = np.searchsorted(own[order], np.arange(k + 1))
                for c in np.flatnonzero(np.diff(edge)):
                    sums[c] += v[order[edge[c] : edge[c + 1]]].sum(0)
        seen = np.flatnonzero(count)
        rows = [(int(c), d, int(count[c]), str(int(sums[c, d]))) for c in seen for d in range(dimensions)]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "dim", "n", "s"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(v, centroids) for _, v in _vectors(batch, centroids.shape[1])]
            if found:
                own, distance = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
                )

    return run


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _seeds(vectors: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose seeded id has the smallest digest, in that order, ties by the vectors."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _text(F.col("id"))).cast("binary"), 256)
    first = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
    scale: float = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Rows (``id_col``, ``cluster``, ``distance``) and the final centroids.

    Vectors with exactly ``dimensions`` components, none null or non-finite, take part,
    each component x as floor(scale * x); other rows have no result. The first
    centroids are the ``clusters`` vectors whose ``seed:id`` has the smallest sha256
    (a null id is empty text; equal ids are told apart by their vectors); with fewer
    vectors there are fewer centroids. A round assigns every vector to its nearest
    centroid and replaces each centroid that has vectors by the floor of their mean.
    Ties go to the smaller number, so one of two equal centroids stays empty. Repeated
    ids and rows keep their rows, extra columns are not read, an empty table gives no
    rows. A component too large for exact 64-bit distances is an error.
    """
    scratch = Scratch(df.sparkSession, "centroids")
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.LongType()))])
    vectors = scratch.write(rows.mapInArrow(_whole(dimensions, scale), schema), "vectors")
    centroids = _seeds(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        sums = vectors.mapInArrow(_sums(centroids), "cluster int, dim int, n long, s string")
        exact = F.sum(F.col("s").cast("decimal(38,0)")).cast("string")
        # One row per centroid and dimension.
        for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), exact.alias("s")).collect():
            centroids[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if len(centroids):
        out = scratch.write(vectors.mapInArrow(_assigned(centroids), schema), "assigned")
    else:
        out = df.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col), centroids


def digest(centroid: np.ndarray) -> str:
    """Lower-case sha256 of the components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    The sums have one row per centroid; they reach the rows as constants.
    """
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    own = {r["cluster"]: int(r["s"]) for r in found}
    if sum(own.values()) >= 2**63:
        raise ValueError("the inertia does not fit into 64 bits")

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    if not len(centroids):
        none = {"cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return assigned.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return assigned.withColumns(
        {
            "cluster_inertia": of_cluster([own.get(c, 0) for c in range(len(centroids))], "long"),
            "inertia": F.lit(sum(own.values())).cast("long"),
            "centroid_sha256": of_cluster([digest(c) for c in centroids], "string"),
        }
    )


def oracle(dimensions: int = DIMENSIONS, scale: int = int(SCALE), clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same in SQL over the table ``embeddings``, for unique ids."""

    def nearest_sql(centroids: str) -> str:
        return (
            f"SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - m) * (x - m)) AS d "
            f"FROM comp JOIN {centroids} USING (i) GROUP BY vec_id, c) t GROUP BY vec_id"
        )

    steps = [
        "raw AS (SELECT vec_id, unnest(embedding) AS f, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
        f"kept AS (SELECT vec_id FROM raw GROUP BY vec_id HAVING count(*) = {dimensions} AND count(f) = {dimensions} AND bool_and(isfinite(f)))",
        f"comp AS (SELECT vec_id, i, CAST(floor({scale}::DOUBLE * CAST(f AS DOUBLE)) AS BIGINT) AS x FROM raw SEMI JOIN kept USING (vec_id))",
        f"seed AS (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS c FROM (SELECT vec_id, sha256('{seed}:' || vec_id) AS h "
        f"FROM kept ORDER BY h LIMIT {clusters}) s)",
        "c0 AS (SELECT c, i, x AS m FROM seed JOIN comp USING (vec_id))",
    ]
    for r in range(rounds):
        steps += [
            f"a{r} AS ({nearest_sql(f'c{r}')})",
            f"u{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM comp JOIN a{r} USING (vec_id) GROUP BY c, i)",
            f"c{r + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{r} LEFT JOIN u{r} USING (c, i))",
        ]
    steps += [
        f"last AS ({nearest_sql(f'c{rounds}')})",
        f"name AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)",
    ]
    return (
        "WITH " + ",\n".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps) + "\n"
        "SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, "
        "CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        "h AS centroid_sha256 FROM last JOIN name USING (c)"
    )
