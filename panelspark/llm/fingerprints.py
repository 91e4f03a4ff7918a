"""Document fingerprints by consistent weighted sampling, in built-in functions.

Each of ``SAMPLES`` samples of a text with term weights S (here word counts) draws,
for every term, r and c from Gamma(2, 1) and b uniform, from hashes of the term and
the sample's number alone. With t = floor(ln S / r + b), the term with the least
a = c / exp(r (t - b + 1)) is the sample, together with its t. Two texts give the
same sample with a probability equal to their generalised Jaccard similarity,
sum of least weights over sum of largest. ln a, a function of the term and t, stands
for the pair.

Texts meet the next document's text in buckets of ids, one shuffle of the texts;
counting words, sampling and taking the least all follow in the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.quality_rules import SPACE
from panelspark.llm.scratch import Scratch

SAMPLES = 32
# Texts meet in groups of 2^BUCKET_BITS consecutive ids.
BUCKET_BITS = 10
SEED = 77


def _terms(text: Column) -> Column:
    """Sorted hashes of the words of ``text``, repeats included."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _counts(terms: str, starts: str) -> Column:
    """(term, ln of its count) from sorted hashes and the places where their runs start."""
    at, until = F.col(starts), F.size(F.col(terms))
    return F.transform(
        at,
        lambda x, i: F.struct(
            F.get(F.col(terms), x).alias("term"),
            F.ln((F.coalesce(F.get(at, i + 1), until) - x).cast("double")).alias("log_weight"),
        ),
    )


def _uniform(bits: Column, at: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) / float(1 << width)


def _sample(j: int) -> Column:
    """ln a of sample j, from columns ``term`` and ``log_weight``."""
    one = F.xxhash64(F.col("term"), F.lit(SEED + 2 * j))
    two = F.xxhash64(F.col("term"), F.lit(SEED + 2 * j + 1))
    # The sum of two exponentials is Gamma(2, 1).
    r = -F.ln(_uniform(one, 0, 25) * _uniform(one, 25, 25))
    c = -F.ln(_uniform(two, 0, 25) * _uniform(two, 25, 25))
    b = _uniform(two, 50, 14)
    return F.ln(c) - r * (F.floor(F.col("log_weight") / r + b) - b + 1)


def signatures(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and ``fingerprint`` of every row; ``keys`` tell rows apart.

    A fingerprint is eight hex digits per sample, and empty for a text without words.
    Rows are sampled where they lie if ``keys`` begin with the columns they are
    partitioned by.
    """
    terms = texts.select(*keys, _terms(F.col(text_col)).alias("__terms"))
    h = F.col("__terms")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0))),
        lambda i: (F.size(h) > 0) & ((i == 0) | (F.get(h, i) != F.get(h, i - 1))),
    )
    rows = (
        terms.withColumn("__starts", starts)
        .select(*keys, F.explode_outer(_counts("__terms", "__starts")).alias("__x"))
        .select(*keys, F.col("__x.term").alias("term"), F.col("__x.log_weight").alias("log_weight"))
    )
    least = rows.groupBy(*keys).agg(*[F.min(_sample(j)).alias(f"__s{j}") for j in range(SAMPLES)])
    code = [
        F.lpad(F.lower(F.hex(F.xxhash64(F.col(f"__s{j}")).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for j in range(SAMPLES)
    ]
    return least.select(*keys, F.when(F.col("__s0").isNull(), "").otherwise(F.concat(*code)).alias("fingerprint"))


def likeness(one: Column, other: Column) -> Column:
    """Share of equal samples; texts without words are like each other and nothing else."""
    same = F.filter(
        F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
        lambda i: F.substr(one, i * 8 + 1, F.lit(8)) == F.substr(other, i * 8 + 1, F.lit(8)),
    )
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(F.size(same) / float(SAMPLES))


_PLACE = ["known", "bucket"]


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of descending ids: ``known``, ``bucket``, ``rn``, ``id``, ``text``.

    Rows without an id come last, by a hash of their text. Nothing is ordered beyond
    a bucket of consecutive ids.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).isNotNull().alias("known"),
        F.coalesce(F.shiftright(F.col(id_col).cast("long"), BUCKET_BITS), F.shiftright(F.xxhash64(text), 44)).alias("bucket"),
        F.col(id_col).alias("id"), text.alias("text"),
    )
    order = Window.partitionBy(*_PLACE).orderBy(F.col("id").desc(), F.xxhash64("text").desc())
    return rows.withColumn("rn", F.row_number().over(order))


def with_next(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``next``: the column's value in the row that follows, after the last the first.

    Within a bucket a window finds it; a bucket's last row takes the first row of
    the next bucket, of which there is one per bucket.
    """
    within = Window.partitionBy(*_PLACE).orderBy("rn")
    heads = rows.where("rn = 1").select(*_PLACE, F.col(column).alias("head"))
    every = Window.partitionBy(F.lit(0)).orderBy(F.col("known").desc(), F.col("bucket").desc())
    here = F.struct("known", "bucket")
    after = heads.select(*_PLACE).withColumn(
        "after",
        F.coalesce(F.lead(here).over(every), F.first(here).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))),
    )
    follow = after.join(
        heads.select(F.struct("known", "bucket").alias("after"), "head"), "after"
    ).select(*_PLACE, "head")
    return (
        rows.withColumn("__lead", F.lead(column).over(within))
        .join(follow, _PLACE)
        .withColumn("next", F.coalesce("__lead", "head"))
        .drop("__lead", "head")
    )


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last half of the code points (rounded down) replaced by
    the first as many, or all, of the next document's, in descending order of ids
    (after the last document comes the first). Returns ``id_col``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next`` per row.

    A null text is empty. Rows without an id come last. Rows of one id follow each
    other by a hash of their text; ids are expected to be few times repeated, as a
    bucket holds all rows of its ids. A single row is its own next one.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(placed(docs, id_col, text_col), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    )
    keys = [*_PLACE, "rn", "id", "n_chars", "edited_sha256", "kind"]
    both = rows.select(
        *_PLACE, "rn", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"),
    ).select(*keys[:-1], "x.kind", "x.text")
    made = scratch.write(signatures(both, keys, "text"), "signatures")
    pairs = made.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    pairs = scratch.write(pairs, "pairs")
    scratch.drop("signatures")
    return with_next(pairs, "fingerprint").select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
