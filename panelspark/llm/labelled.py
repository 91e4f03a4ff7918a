"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.scratch import Scratch, crc_mod

# Labelled rows a classifier is fitted on, at most.
FIT_ROWS = 8000


def fitting_rows(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Written rows (id: its hash, text, label) of at most ``rows`` labelled documents outside the held-out quarter.

    The documents are chosen by a hash of their id, the same in every run, one row each: of
    rows with one id the smallest text, of its labels the largest. Only that many ids
    are sent to the tasks, and the texts stay there. Null ids, null labels and labels
    without a document are left out; a null text is empty.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (crc_mod(id_col, 4) != 2))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    one = found.groupBy("id", "label").agg(F.min("text").alias("text"))
    return Scratch(docs.sparkSession, "fitting").write(one.select(F.xxhash64("id").alias("id"), "text", "label"), label)
