"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(id, comp) for every id in ``links`` (columns a, b); comp is the smallest id reached.

    Every id takes the smallest label among its neighbours, then its label's label;
    both steps are partial aggregates and joins, so a hub with many links is no hot
    task, and labels halve their distance each round.
    """
    both = scratch.write(
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select("b", "a"))
        .distinct(),
        f"{name}-both",
    )
    labels = scratch.write(
        both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("comp")),
        f"{name}-0",
    )
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.select(F.col("id").alias("other"), F.col("comp").alias("c")), "other")
            .groupBy("id")
            .agg(F.min("c").alias("c"))
        )
        least = labels.join(near, "id").select("id", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        least = scratch.write(least, f"{name}-{turn}-near")
        # A label is itself an id that is linked, so it has a label of its own.
        jump = least.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        moved = scratch.write(
            least.join(jump, "comp").select("id", F.col("next").alias("comp"), (F.col("next") != F.col("old")).alias("new")),
            f"{name}-{turn}",
        )
        scratch.drop(f"{name}-{turn}-near", f"{name}-{turn - 1}")
        labels = moved.select("id", "comp")
        if moved.where("new").isEmpty():
            scratch.drop(f"{name}-both")
            return labels
