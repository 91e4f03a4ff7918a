"""A corpus pipeline: from raw documents to packed bins.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from panelspark.llm.scratch import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Whole texts are scored, however long; a null text scores as an empty one. Rows without
    an id and repeated rows are each judged by their text; extra columns stay as they are.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (Jaccard 0.8 or more) the smallest id stays.

    Documents without words and rows without an id are linked with nothing and stay.
    Of rows with one id one stays.
    """
    classes = ngram_join.similar_classes(docs, size=5, percent=80)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(first, "doc_id", "left_semi").withColumn(
        "__row", F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"]))
    )
    return known.where("__row = 1").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """13-word windows stay in the smallest document that has them; every row stays."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substring_dedup.remove_repeats(docs, window=13, carry=carry, made="__")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1: documents repeated or cut to the words the mix takes.

    A null source is one source, the last; null and empty texts have no words and are not
    taken. Rows without an id and repeated rows each count with their words. Ties
    between sources go by their order; long texts are taken by blocks of their words.
    """
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words; copies of a document are one duplicate cluster.

    Longer texts are cut into pieces. Null and empty texts are one piece of size 0 without a
    bin. Rows without an id are one cluster, so no two of them share a bin. Null sources
    are one source.
    """
    return packing.pack(docs, F.col("doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

# Trained models, components and best fit are beyond SQL; the tests compare each
# stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = scratch.write(docs, name)
            if at:
                scratch.drop(STAGES[at - 1][0])
    return docs
