"""A whole study from raw tables to the stacked state curve."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from panelspark.plans.combine import combine
from panelspark.plans.imputation import CONDITIONS, impute_condition, impute_covariates
from panelspark.plans.intake import death_table, domain_tables, enriched_visits, same_day_visits
from panelspark.plans.registry import registry
from panelspark.plans.trajectories import follow_up, stacked_curve, state_curve, yearly_curve, yearly_states
from panelspark.session import tune
from panelspark.sources.stages import Stages, fingerprint
from panelspark.sources.tables import RAW_SCHEMAS, read_table, stage, write_table


def read_raw(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All raw tables of a study folder."""
    suffix = ".csv" if fmt == "csv" else ".parquet"
    return {
        name: read_table(spark, f"{root}/{name}{suffix}", schema, fmt)
        for name, schema in RAW_SCHEMAS.items()
    }


def run_study(
    raw: Mapping[str, DataFrame],
    root: str,
    layout: str = "long",
    buckets: int | None = None,
    resume: bool = False,
    **forest_settings,
) -> dict[str, DataFrame]:
    """Run every stage, each written under ``root`` before the next reads it.

    ``buckets`` places the person-keyed stage tables by person, see
    ``sources.tables.stage``. With ``resume`` every stage leaves a manifest of the raw
    tables and settings it was made from, and stages that an earlier run with the same
    ones has written whole are read instead of made again. Returns all tables by name.
    """
    spark = tune(raw["visit_raw"].sparkSession)
    stages = Stages(spark, root)
    made_from = {}
    if resume:
        made_from = {
            "inputs": {name: fingerprint(df) for name, df in sorted(raw.items())},
            "settings": {"layout": layout, "buckets": buckets, **forest_settings},
        }
    out: dict[str, DataFrame] = {}

    def put(name: str, make: Callable[[], DataFrame]) -> None:
        if resume and (stages.facts(name) or {}).get("made_from") == made_from:
            out[name] = stages.read(name)
            return
        stages.forget(name)
        out[name] = stage(make(), root, name, buckets=buckets)
        if resume:
            stages.note(name, schema=out[name].schema.jsonValue(), made_from=made_from)

    put("same_day", lambda: same_day_visits(raw["visit_raw"]))
    put("visits", lambda: enriched_visits(raw["visit_raw"], raw["enroll_raw"]))
    out |= domain_tables(out["visits"])
    base = out["base"]
    put("base", lambda: base)
    put("mort", lambda: death_table(raw["death_raw"]))
    put("cancer", lambda: registry(raw["registry_raw"], raw["prognosis_raw"]))
    put("use", lambda: impute_covariates(out, layout, **forest_settings))
    for name in CONDITIONS:
        put(f"{name}_impute", lambda name=name: impute_condition(out, name, layout, **forest_settings))
    imputed = {name: out[f"{name}_impute"] for name in CONDITIONS}
    put("multimorbid_visits", lambda: combine({**imputed, "use": out["use"], "cancer": out["cancer"]}))
    put("intervals", lambda: follow_up(out["multimorbid_visits"], out["mort"]))
    put("curve", lambda: state_curve(out["intervals"]))
    put("curve_wide", lambda: stacked_curve(out["curve"]))
    put("person_years", lambda: yearly_states(out["multimorbid_visits"]))
    put("yearly_curve", lambda: yearly_curve(out["person_years"]))
    return out


def export(tables: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> None:
    """Write tables for other tools, one folder each."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}.{fmt}", fmt, order=[c for c in ("id", "visdate") if c in df.columns])
