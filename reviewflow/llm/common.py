"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows; by the pigeonhole
#: principle at most HOT_SHARE keys are, whatever the size of the data.
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hot_keys(counts: DataFrame, keys: list[str], rows: int, count: str = "n") -> DataFrame:
    """The keys of ``counts`` with more than ``rows / HOT_SHARE`` of the ``rows`` rows, and their salts.

    They are HOT_SHARE at most, so the table may be broadcast at any size of data.
    """
    salts = F.ceil(F.col(count) * F.lit(HOT_SHARE) / F.lit(max(rows, 1))).cast("int")
    return counts.where(salts > 1).select(*keys, salts.alias("_salts"))


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner"
) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is shared by many tasks.

    ``right`` has one row per key; that of a hot key is repeated once per salt, and
    left rows are salted by ``spread``. Each side is shuffled once, by key and salt.
    """
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
