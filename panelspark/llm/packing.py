"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents longer than a bin are cut into full pieces and a rest. Pieces are dealt by a
hash to as many shards as their number asks for, and every shard is packed on its own:
largest first, bins in order of what they have left. The search starts at the
tightest bin that has room and goes on to its successors until one is compatible:
its bitmap of duplicate clusters lacks the piece's, and its source has not yet come
``per_source`` times. Only ids and sizes travel, no text.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.mixing import n_words
from panelspark.llm.scratch import Scratch, parts_for

CAPACITY = 2048  # words
PER_SOURCE = 2
SHARD_ROWS = 2048


def best_fit(
    sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int
) -> list[int]:
    """Bin of each piece, pieces given largest first; sources and clusters as small numbers."""
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    seen_clusters: list[int] = []  # a bitmap per bin
    seen_sources: list[list[int]] = []  # per bin: bitmap k holds sources that came k + 1 times
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order):
            bin_ = order[at][1]
            if not (seen_clusters[bin_] & cluster_bit or seen_sources[bin_][-1] & source_bit):
                break
            at += 1
        if at < len(order):
            room, bin_ = order.pop(at)
        else:
            room, bin_ = capacity, len(seen_clusters)
            seen_clusters.append(0)
            seen_sources.append([0] * per_source)
        insort(order, (room - size, bin_))
        seen_clusters[bin_] |= cluster_bit
        planes = seen_sources[bin_]
        planes[next(k for k in range(per_source) if not planes[k] & source_bit)] |= source_bit
        out.append(bin_)
    return out


def _codes(column: pa.ChunkedArray) -> list[int]:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()


def _pack(capacity: int, per_source: int, shards: int):
    schema = pa.schema(
        [("id", pa.int64()), ("piece", pa.int64()), ("size", pa.int64()), ("bin_id", pa.int64()), ("bin_size", pa.int64())]
    )

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(
            [("size", "descending"), ("id", "ascending"), ("piece", "ascending"), ("cluster", "ascending"), ("source", "ascending")]
        )
        sizes = rows.column("size").to_pylist()
        bins = np.array(
            best_fit(sizes, _codes(rows.column("source")), _codes(rows.column("cluster")), capacity, per_source), np.int64
        )
        filled = np.bincount(bins, weights=np.array(sizes), minlength=len(bins)).astype(np.int64)
        shard = np.int64(rows.column("shard")[0].as_py())
        return pa.table(
            [rows.column("id"), rows.column("piece"), rows.column("size"), pa.array(bins * shards + shard), pa.array(filled[bins])],
            schema=schema,
        )

    return run


def pack(
    docs: DataFrame, cluster: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``id_col``, ``piece``, ``size`` (words), ``bin_id`` and ``bin_size`` of every piece.

    Piece p of a document holds its words from p * capacity on. ``cluster`` is a
    whole-number key of duplicates; a bin never holds two pieces of one cluster, nor
    more than ``per_source`` of one source (null sources are one source, null clusters
    one cluster). Texts without words are one piece of size 0 with a null bin. Ids may
    be null or repeat. The same rows give the same bins.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("total"), cluster.cast("long").alias("cluster"),
    )
    # Counting words is the work here, so their numbers are kept for the pieces.
    rows = scratch.write(rows, "sizes")
    count = rows.agg(F.sum(F.ceil(F.col("total") / capacity))).first()[0] or 0
    shards = parts_for(count, shard_rows)
    pieces = rows.withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))))
    ).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity))
    empty = pieces.where("size = 0").select(
        "id", "piece", "size", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_size")
    )
    dealt = pieces.where("size > 0").select(
        F.pmod(F.xxhash64("id", "piece", "cluster"), F.lit(shards)).alias("shard"), "id", "piece", "size", "source", "cluster"
    )
    packed = dealt.groupBy("shard").applyInArrow(
        _pack(capacity, per_source, shards), "id long, piece long, size long, bin_id long, bin_size long"
    )
    return packed.unionByName(empty).withColumnRenamed("id", id_col)


def same_words(text_col: str = "text") -> Column:
    """Cluster of texts that are equal but for case and white space."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(plain)
