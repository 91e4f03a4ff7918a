"""Row selection by key, joins and row binding.

None of these pulls a whole key group into one task before it has been reduced:
``first_per_key`` limits rows per key on the map side, ``collapse`` aggregates
there, and a join leaves skewed partitions to be split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.nulls import _col


def as_list(names) -> list:
    return [names] if isinstance(names, str) or not isinstance(names, Sequence) else list(names)


def _ranked(df: DataFrame, key, order) -> DataFrame:
    w = Window.partitionBy(*as_list(key)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def first_per_key(df: DataFrame, key, order) -> DataFrame:
    """First whole row per key, missing order values last; its values may be NULL."""
    return _ranked(df, key, [_col(o).asc_nulls_last() for o in as_list(order)])


def last_per_key(df: DataFrame, key, order, then=()) -> DataFrame:
    """Last whole row per key: the reverse of the order used by ``first_per_key``.

    Among rows tied on ``order`` the first by ``then`` is taken.
    """
    last = [_col(o).desc_nulls_first() for o in as_list(order)]
    return _ranked(df, key, [*last, *[_col(o).asc_nulls_last() for o in as_list(then)]])


def collapse(df: DataFrame, key, order: str) -> DataFrame:
    """One row per key holding the values of the row with the smallest ``order``.

    Same rows as ``first_per_key`` for a unique, known ``order``; a plain
    aggregate, so fixed-width columns need no sort and repeats are combined
    before the shuffle.
    """
    key = as_list(key)
    rest = [c for c in df.columns if c not in key and c != order]
    picked = df.groupBy(*key).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]
    )
    return picked.select(*df.columns)


def repeated_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their row count ``n``."""
    return df.groupBy(*as_list(key)).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, key) -> DataFrame:
    """``df`` itself, or ValueError when a key repeats. Runs one aggregate job."""
    if not repeated_keys(df, key).isEmpty():
        raise ValueError(f"more than one row per {as_list(key)}")
    return df


def join_on(
    df: DataFrame,
    other: DataFrame,
    on,
    how: str = "left",
    null_safe: bool = False,
    expect: str | None = None,
) -> DataFrame:
    """Equi-join on same-named columns (``left``, ``right``, ``left_semi``, ``left_anti``).

    ``null_safe`` lets missing keys match each other. Repeated keys multiply
    rows unless ``expect="one"``, which rejects them on the attached side.
    """
    on = as_list(on)
    if expect == "one":
        require_unique(df if how == "right" else other, on)
    elif expect is not None:
        raise ValueError("expect must be 'one' or None")
    if not null_safe:
        return df.join(other, on=on, how=how)
    left, right = df.alias("l"), other.alias("r")
    match = reduce(
        lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    )
    joined = left.join(right, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    kept = "r" if how == "right" else "l"
    extra = [F.col(f"r.{c}") for c in other.columns if c not in on]
    own = [F.col(f"{kept if c in on else 'l'}.{c}") for c in df.columns]
    return joined.select(*own, *extra)


def keep_keys(df: DataFrame, other: DataFrame, on, null_safe: bool = False) -> DataFrame:
    """Rows whose key occurs in ``other``; with ``null_safe`` a missing key may too."""
    return join_on(df, other.select(*as_list(on)), on, "left_semi", null_safe)


def drop_keys(df: DataFrame, other: DataFrame, on, null_safe: bool = False) -> DataFrame:
    """Rows whose key does not occur in ``other``; a missing key stays unless ``null_safe``."""
    return join_on(df, other.select(*as_list(on)), on, "left_anti", null_safe)


def attach_table(df: DataFrame, table: DataFrame, on) -> DataFrame:
    """Null-safe left join onto a code table.

    Spark broadcasts the table if its size at run time allows; otherwise adaptive
    execution splits the partitions of frequent codes.
    """
    return join_on(df, table, on, "left", null_safe=True)


def star_join(base: DataFrame, sides: Sequence[DataFrame], on, expect: str | None = None) -> DataFrame:
    """Left-join each side onto ``base`` in turn on the same keys."""
    return reduce(lambda df, side: join_on(df, side, on, "left", expect=expect), sides, base)


def bind_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Stack rows by column name; columns missing on one side become NULL."""
    return df.unionByName(other, allowMissingColumns=True)


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Names of the columns starting with ``prefix``, ignoring case."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def over_columns(df: DataFrame, names, change) -> DataFrame:
    """Replace each named column by ``change(column)``."""
    return df.withColumns({n: change(F.col(n)) for n in as_list(names)})
