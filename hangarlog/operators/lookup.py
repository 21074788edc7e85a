"""Descriptions of codes and names of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hangarlog.functions.text import system_of
from hangarlog.plans.sizing import join_small
from hangarlog.reference_data import UNKNOWN_DESCRIPTION, UNKNOWN_SYSTEM


def with_description(df: DataFrame, dictionary: DataFrame, missing: str = UNKNOWN_DESCRIPTION) -> DataFrame:
    named = join_small(df, dictionary.select("code", "description"), ["code"], "left")
    return named.withColumn("description", F.coalesce("description", F.lit(missing)))


def with_system(df: DataFrame, systems: DataFrame) -> DataFrame:
    """System name by the first two characters of the code."""
    tagged = df.withColumn("prefix", system_of("code"))
    named = join_small(tagged, systems.select("prefix", "system"), ["prefix"], "left")
    return named.withColumn("system", F.coalesce("system", F.lit(UNKNOWN_SYSTEM))).drop("prefix")


def merge_dictionaries(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """All codes of both; where both describe one, the first wins."""
    spare = fallback.select("code", F.col("description").alias("_spare"))
    return first.select("code", "description").join(spare, "code", "full").select(
        "code", F.coalesce("description", "_spare").alias("description"))
