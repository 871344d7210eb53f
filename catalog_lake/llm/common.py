"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six characters that separate words, as a character list and as a regular expression class.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of non-space characters; none for NULL and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def groups_for(df: DataFrame, column: str, target_bytes: int = 8 << 20, least: int = 1) -> int:
    """How many groups of about ``target_bytes`` the column's texts make, over all rows."""
    total = df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0
    return max(least, math.ceil(total / target_bytes))
