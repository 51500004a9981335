"""All registries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import aggregation, functions, panel_problems, panels, quality, relational, resolution, texts, ticks
from marlstone.plans.registry import Registry


def registries() -> list[Registry]:
    return [panel_problems.R, relational.R, aggregation.R, functions.R, ticks.R, quality.R, resolution.R, texts.R, panels.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.R.queries["panel_inst_own"](spark, sf_dir)
