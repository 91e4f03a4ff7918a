"""Long to wide and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.keys import as_list, join_on, with_prefix

LAST_UNDERSCORE = re.compile(r"^(.*)_(.*)$")


def split_name(name: str) -> tuple[str, str]:
    """``measure_number`` split at the last underscore."""
    match = LAST_UNDERSCORE.match(name)
    if match is None:
        raise ValueError(f"no underscore in {name!r}")
    return match.group(1), match.group(2)


def pack_visits(df: DataFrame, values: Sequence[str], key="id", number: str = "n_vis") -> DataFrame:
    """One row per person with all its visits in ``cells``, ordered by number.

    The long-panel form of ``pivot_visits``: a person takes as much room as it
    has visits, at most one per day, whatever the longest person has.
    """
    cell = F.struct(number, *values)
    return df.groupBy(*as_list(key)).agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def unpack_visits(packed: DataFrame, key="id") -> DataFrame:
    """One row per packed visit again."""
    return packed.select(*as_list(key), F.inline("cells"))


def visit_numbers(df: DataFrame, number: str = "n_vis") -> list[int]:
    """1 to the largest visit number, found by one small job."""
    top = df.agg(F.max(number)).first()[0]
    return list(range(1, (top or 0) + 1))


def widen(
    packed: DataFrame,
    values: Sequence[str],
    numbers: Sequence[int],
    keep="id",
    number: str = "n_vis",
    dense: bool = False,
) -> DataFrame:
    """Columns ``{value}_{number}`` from packed visits, after the ``keep`` columns.

    Cells are looked up by number, so the work follows the cells that exist,
    where a pivot aggregate would carry every empty one through its buffers. With
    ``dense`` numbers (1, 2, 3 ... for every person, as ``visit_number`` gives them) a
    cell's number is its place.
    """
    keep = as_list(keep)
    if dense:
        cells = [f"try_element_at(cells, {n}).`{v}` AS `{v}_{n}`" for v in values for n in numbers]
        return packed.selectExpr(*[f"`{k}`" for k in keep], *cells)
    by_number = F.transform("cells", lambda c: F.struct(c[number], c))
    found = packed.select(*keep, F.map_from_entries(by_number).alias("_cells"))
    cells = [f"try_element_at(_cells, {n}).`{v}` AS `{v}_{n}`" for v in values for n in numbers]
    return found.selectExpr(*[f"`{k}`" for k in keep], *cells)


def pivot_visits(
    df: DataFrame,
    values: Sequence[str],
    key="id",
    number: str = "n_vis",
    numbers: Sequence[int] | None = None,
    dense: bool = False,
) -> DataFrame:
    """One row per person with a column ``{value}_{number}`` per value and visit.

    Without ``numbers`` every visit gets its columns. The matrix is as wide as
    its longest person; where that is long, ``pack_visits`` holds the same cells
    without the empty ones.
    """
    numbers = visit_numbers(df, number) if numbers is None else list(numbers)
    return widen(pack_visits(df, values, key, number), values, numbers, key, number, dense)


def melt(wide: DataFrame, key="id", name: str = "cell", value: str = "value") -> DataFrame:
    """Every cell of a wide matrix as a row (key, column name, value as number or text)."""
    key = as_list(key)
    kinds = {kind for column, kind in wide.dtypes if column not in key}
    common = "string" if "string" in kinds else "double"
    cells = [F.col(c).cast(common).alias(c) for c in wide.columns if c not in key]
    names = [c for c in wide.columns if c not in key]
    return wide.select(*key, *cells).unpivot(key, names, name, value)


def unpivot_measure(
    wide: DataFrame, measure: str, key="id", number: str = "n_vis", name: str | None = None
) -> DataFrame:
    """Rows (key, number, measure) from the columns ``{measure}_{number}``."""
    columns = [c for c in with_prefix(wide, f"{measure}_") if c[len(measure) + 1:].isdigit()]
    long = wide.unpivot(as_list(key), columns, "_name", name or measure)
    index = F.substring(F.col("_name"), len(measure) + 2, 10).cast("int")
    return long.select(*as_list(key), index.alias(number), F.col(name or measure))


def unpivot_many(wide: DataFrame, keep="id", number: str = "n_vis") -> DataFrame:
    """All ``{measure}_{number}`` columns as one row per number, one column per measure.

    Names split at their last underscore; measures may differ in type. A measure
    without a column for some number is NULL there.
    """
    keep = as_list(keep)
    types: dict[str, str] = {}
    cells: dict[str, dict[str, str]] = {}
    for column, kind in wide.dtypes:
        if column not in keep:
            measure, n = split_name(column)
            types[measure] = kind
            cells.setdefault(n, {})[measure] = column
    rows = []
    for n, row in cells.items():
        fields = [f"{int(n)} AS `{number}`"]
        for m, kind in types.items():
            value = f"`{row[m]}`" if m in row else f"CAST(NULL AS {kind})"
            fields.append(f"{value} AS `{m}`")
        rows.append(f"struct({', '.join(fields)})")
    return wide.selectExpr(*[f"`{k}`" for k in keep], f"inline(array({', '.join(rows)}))")


def observed_cells(visits: DataFrame, cells: DataFrame, on=("id", "n_vis")) -> DataFrame:
    """Cells of observed visits only; a visit without a cell keeps NULL."""
    return join_on(visits, cells, list(on), "left")
