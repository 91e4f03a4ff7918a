"""Disease-registry records: stage, treatment years, prognosis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.nulls import _col, fill_sentinel, in_set
from panelspark.functions.parse import parse_number, parse_year, parse_ymd
from panelspark.functions.recode import first_match, recode
from panelspark.operators.keys import attach_table

UNKNOWN_CODE = 99

# Summary-stage code by stage name. ``regional`` also takes every
# code below its own that is not listed.
STAGE_CODES = {
    "in situ": 0,
    "localized": 1,
    "regional": 5,
    "distant": 7,
    "benign": 8,
    "unknown": 9,
}


def dated_records(records: DataFrame, date: str, missing: str = "NA") -> DataFrame:
    """Records with a date, parsed; the missing token and NULL both drop out."""
    return records.filter(F.col(date) != missing).withColumn(date, parse_ymd(date))


def with_stage(
    records: DataFrame, *systems: Column | str | Sequence[Column | str], name: str = "stage"
) -> DataFrame:
    """Add the stage name told by the codes of several coding systems.

    Each system is a text code, or several of which the first known one counts.
    The systems are tried stage by stage in the order of ``STAGE_CODES``: one
    system saying so is enough. No known code, or only unlisted ones, gives NULL.
    """
    numbers = {}
    for k, system in enumerate(systems):
        options = [system] if isinstance(system, (str, Column)) else system
        parsed = [parse_number(o) for o in options]
        numbers[f"_code{k}"] = fill_sentinel(*parsed, sentinel=float(UNKNOWN_CODE))

    def any_code(test) -> Column:
        return reduce(lambda a, b: a | b, [test(F.col(c)) for c in numbers])

    rules = [
        (any_code(lambda c: c <= value if stage == "regional" else c == value), stage)
        for stage, value in STAGE_CODES.items()
    ]
    # Codes become columns first, so that each is parsed once per record.
    return records.withColumns(numbers).withColumn(name, first_match(rules)).drop(*numbers)


def first_year(dates: Sequence[Column | str]) -> Column:
    """Earliest year among partial dates; NULL when none is known."""
    years = [parse_year(d) for d in dates]
    return F.least(*years) if len(years) > 1 else years[0]


def rule_outcome(rules: Sequence[tuple[Column, int | None]], default: int = 0) -> Column:
    """Outcome of the first rule that is true; ``None`` stands for an unknown outcome."""
    return first_match(
        [(cond, F.lit(value).cast("int")) for cond, value in rules], default=F.lit(default)
    )


def select_prognosis(
    prognosis: DataFrame,
    strata: Mapping[str, Sequence[str]],
    shared: str,
    stratum: str = "sex",
    threshold: float = 0.5,
    site: str = "site",
) -> DataFrame:
    """One prognosis row per site and stage, flagged ``poor_prog`` under ``threshold``.

    A site listed for a stratum takes that stratum's rows, any other site the
    rows of the ``shared`` stratum.
    """
    special = [s for sites in strata.values() for s in sites]
    keep = (F.col(stratum) == shared) & ~in_set(site, special)
    for name, sites in strata.items():
        keep = keep | ((F.col(stratum) == name) & in_set(site, sites))
    return prognosis.filter(keep).withColumn(
        "poor_prog", (F.col("survival") < threshold).cast("int")
    )


def attach_prognosis(
    records: DataFrame, prognosis: DataFrame, stage_names: Mapping[str, str]
) -> DataFrame:
    """Join prognosis rows to records by (site, stage); missing keys match each other.

    ``stage_names`` renames the stages of the prognosis table first.
    """
    named = prognosis.withColumn("stage", recode("stage", stage_names))
    return attach_table(records, named, ["site", "stage"])


def first_event(records: DataFrame, date: str, key: str = "id") -> DataFrame:
    """Earliest date per person."""
    return records.groupBy(key).agg(F.min(date).alias(date))


def on_or_before(event: Column | str, date: Column | str) -> Column:
    """1 when the event has happened by ``date``, 0 when not or when there is none."""
    return F.coalesce((_col(event) <= _col(date)).cast("int"), F.lit(0))
