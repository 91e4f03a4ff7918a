"""Domain tables -> imputed measurements per condition, at observed visits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import cap_above, keep_levels, year_range
from panelspark.operators.fills import person_features
from panelspark.operators.forest import forest_impute
from panelspark.operators.keys import bind_rows, first_per_key, join_on, over_columns
from panelspark.operators.panel import visit_number
from panelspark.operators.reshape import (
    observed_cells,
    pack_visits,
    unpivot_measure,
    visit_numbers,
    widen,
)

# Calendar span, covariates of every model.
FIRST_YEAR, LAST_YEAR = 2007, 2019
SOCDEM = ["age", "anyhomels", "inclt5k", "work"]
DRUG = ["alcheavy", "alcmoderate", "curuser", "anntivwomj", "cigyn"]
HIV = ["hiv", "hcvvis"]
PERSON = ["enroll_period", "beduchs", "m0f1", "black"]
YEAR = "yr"
NOT_LEVELS = ["age"]


@dataclass(frozen=True)
class Condition:
    """One condition: its source table, measures and what of them is kept."""

    table: str
    numbers: tuple[str, ...]
    flags: tuple[str, ...]
    outputs: tuple[str, ...]


# Measures per condition.
CONDITIONS = {
    "diab": Condition("comorbid", ("hba1c",), ("diabdx6m", "diabtx6m", "evrdiab"), ("hba1c", "diabtx6m")),
    "hbp": Condition(
        "comorbid", ("bpsys", "bpdias"), ("hbpdx6m", "hbptx6m", "evrhbp"), ("bpsys", "bpdias", "hbptx6m")
    ),
    "liver": Condition("comorbid", ("fbscan",), (), ("fbscan",)),
    "lung": Condition("comorbid", ("fev_fvc",), ("lungdx6m", "lungtx6m", "evrlungdx"), ("fev_fvc", "lungtx6m")),
    "dep": Condition("mental", ("cesdtot",), ("depdx6m", "deptx6m", "emeddep"), ("cesdtot", "deptx6m")),
    "renal": Condition(
        "comorbid",
        ("gfr", "uprt_crt"),
        ("renaldx6m", "renaltx6m", "evrrenal"),
        ("gfr", "uprt_crt", "renaltx6m"),
    ),
}
# Kidney filtration is modelled apart before and from this year on,
# and capped in the earlier part.
GFR_SPLIT, GFR_CAP = 2011, 95.0


def in_span(df: DataFrame) -> DataFrame:
    return df.filter(year_range("visdate", FIRST_YEAR, LAST_YEAR))


def person_table(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Baseline columns per person."""
    first = first_per_key(in_span(tables["socdem"]).select("id", "visdate", "m0f1", "black"), "id", "visdate")
    base = tables["base"].select("id", "beduchs", "enroll_period")
    return join_on(base, first.select("id", "m0f1", "black"), "id")


def visit_table(tables: Mapping[str, DataFrame], condition: Condition | None) -> DataFrame:
    """Numbered visits with the measures of a condition and all covariates.

    Without a condition the visits are those of the sociodemographic table.
    """
    on = ["id", "visdate"]
    socdem = in_span(tables["socdem"]).select(*on, *SOCDEM)
    drug = in_span(tables["drug"]).select(*on, *DRUG)
    hiv = in_span(tables["hiv"]).select(*on, *HIV)
    if condition is None:
        sides, rows = [drug, hiv], socdem
    else:
        measures = [*condition.numbers, *condition.flags]
        sides, rows = [socdem, drug, hiv], in_span(tables[condition.table]).select(*on, *measures)
    for side in sides:
        rows = join_on(rows, side, on)
    rows = visit_number(rows).withColumn(YEAR, F.year("visdate"))
    flags = [c for c in [*SOCDEM, *DRUG, *HIV, *(condition.flags if condition else ())] if c not in NOT_LEVELS]
    return over_columns(rows, flags, lambda c: keep_levels(c, [0, 1]))


def with_person(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """Rows of visits or of the wide matrix with their person's baseline columns."""
    return over_columns(
        join_on(rows, persons, "id"), ["beduchs", "m0f1", "black"], lambda c: keep_levels(c, [0, 1])
    )


def impute_long(
    rows: DataFrame,
    persons: DataFrame,
    numbers: Sequence[str],
    flags: Sequence[str],
    outputs: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    **settings,
) -> DataFrame:
    """One forest per variable over visit rows; every column with gaps is filled.

    Other visits of the person enter as the last value before, the first after
    and the mean of the others, for every measure; so the number of forests does
    not grow with the number of visits. ``targets`` limits what is filled.
    """
    rows, features = person_features(with_person(rows, persons), [*numbers, *flags])
    return forest_impute(
        rows.withColumn("visit_no", F.col("n_vis").cast("double")),
        row_key=["id", "visdate"],
        numeric=list(numbers),
        levels=[*flags, YEAR, *PERSON],
        targets=targets,
        features=[*features, "visit_no"],
        **settings,
    ).data


def impute_wide(
    rows: DataFrame,
    persons: DataFrame,
    numbers: Sequence[str],
    flags: Sequence[str],
    outputs: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    **settings,
) -> DataFrame:
    """One forest per variable and visit number over the person matrix.

    Every cell with gaps is filled and ``outputs`` (default: all measures) are taken
    back to visits; ``targets`` limits the measures that are filled. The matrix has a column per variable and visit, so this layout is for panels
    with few visits per person.
    """
    measures = [*numbers, *flags, YEAR]
    packed = with_person(pack_visits(rows, measures), persons)
    # A cell is looked up by its number: the rows may begin with a later visit than the first.
    matrix = widen(packed, measures, visit_numbers(rows), ["id", *PERSON])
    cells = {m: [c for c in matrix.columns if c.startswith(f"{m}_") and c[len(m) + 1:].isdigit()] for m in measures}
    kept = list(outputs) if outputs else [*numbers, *flags]
    filled = forest_impute(
        matrix,
        row_key=["id"],
        numeric=[c for m in numbers for c in cells[m]],
        levels=[*[c for m in [*flags, YEAR] for c in cells[m]], *PERSON],
        targets=[c for m in targets for c in cells[m]] if targets else None,
        **settings,
    ).data
    out = rows.select("id", "visdate", "n_vis", YEAR)
    for m in kept:
        out = observed_cells(out, unpivot_measure(filled.select("id", *cells[m]), m))
    return join_on(out, filled.select("id", *PERSON), "id")


LAYOUTS: dict[str, Callable[..., DataFrame]] = {"long": impute_long, "wide": impute_wide}


def impute_condition(
    tables: Mapping[str, DataFrame], name: str, layout: str = "long", **settings
) -> DataFrame:
    """Imputed measures of one condition: ``id``, ``visdate``, ``n_vis`` and outputs."""
    condition, fill = CONDITIONS[name], LAYOUTS[layout]
    rows, persons = visit_table(tables, condition), person_table(tables)
    shared = [c for c in [*SOCDEM, *DRUG, *HIV] if c not in NOT_LEVELS]
    flags = [*condition.flags, *shared]
    on = ["id", "visdate", "n_vis"]
    if name == "renal":
        return _impute_renal(rows, persons, flags, fill, settings).select(*on, *condition.outputs)
    filled = fill(rows, persons, [*condition.numbers, *NOT_LEVELS], flags, outputs=condition.outputs, **settings)
    if name == "dep":
        filled = over_columns(filled, "cesdtot", lambda c: F.ceil(c).cast("double"))
    return filled.select(*on, *condition.outputs)


def _impute_renal(rows, persons, flags, fill, settings) -> DataFrame:
    """Three models: protein over all years, filtration before and from the split on."""
    on = ["id", "visdate", "n_vis"]
    protein = fill(
        rows.drop("gfr"), persons, ["uprt_crt", *NOT_LEVELS], flags, outputs=["uprt_crt", "renaltx6m"], **settings
    )
    parts = []
    for early in (True, False):
        part = rows.filter(F.col(YEAR) < GFR_SPLIT if early else F.col(YEAR) >= GFR_SPLIT)
        filled = fill(part.drop("uprt_crt"), persons, ["gfr", *NOT_LEVELS], flags, outputs=["gfr"], **settings)
        filled = filled.select(*on, "gfr")
        parts.append(filled.withColumn("gfr", cap_above("gfr", GFR_CAP)) if early else filled)
    filtration = bind_rows(*parts)
    return join_on(filtration, protein.select(*on, "uprt_crt", "renaltx6m"), on)


def impute_covariates(tables: Mapping[str, DataFrame], layout: str = "long", **settings) -> DataFrame:
    """Imputed covariates and baseline columns of every visit."""
    rows, persons = visit_table(tables, None), person_table(tables)
    flags = [c for c in [*SOCDEM, *DRUG, *HIV] if c not in NOT_LEVELS]
    filled = LAYOUTS[layout](rows, persons, NOT_LEVELS, flags, **settings)
    return filled.select("id", "visdate", "n_vis", *PERSON, *SOCDEM, *DRUG, *HIV, YEAR)
