"""Joins against a list of keys of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def without_keys(df: DataFrame, keys: DataFrame, on: str, spread: Column) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not among ``keys``."""
    return _by_keys(df, keys, on, spread, "left_anti")


def with_keys(df: DataFrame, keys: DataFrame, on: str, spread: Column) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys``."""
    return _by_keys(df, keys, on, spread, "left_semi")


def _by_keys(df: DataFrame, keys: DataFrame, on: str, spread: Column, how: str) -> DataFrame:
    """Each key is repeated once per salt and the rows are salted by ``spread``.

    So a key that holds a large part of the rows is shared by many tasks. Whether
    the list is short enough to be broadcast is left to adaptive execution, which
    knows its size in bytes.
    """
    keys = keys.select(on).where(F.col(on).isNotNull()).distinct()
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [on, "_salt"], how).drop("_salt")
