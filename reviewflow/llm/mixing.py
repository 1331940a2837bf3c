"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the copy rate of its documents: each
document is taken floor(rate) times, and once more with the fractional rest as
probability. The rests are rounded dependently: two open documents of a source
meet, and word mass moves at random from one to the other until one of their
probabilities is 0 or 1, keeping every expectation and the mass of the pair. A
bucket of documents leaves one open document; these meet again in larger buckets,
a tree, until one is left per source, which is rounded by chance. So a source's
taken words miss its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.llm.words import count_words
from reviewflow.session import ship_package, stored

BUCKET = 4096  # documents of a first bucket, about
FAN_IN = 1024  # buckets that meet in a bucket of the next level
EDGE = 1e-12


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(count_words(batch.column(2)))], names=["doc_id", "source", "size"]
        )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of each row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(_sizes, "doc_id long, source string, size long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, n, target of each row of ``sources`` (source, source_size, n).

    Weights go round over the sources by code point, null last. The targets add
    up to ``share`` times all sizes; one that would pass ``most`` times its
    source's size stops there, and the rest share the excess by weight. The loop
    fixes at least one source per pass and reads only the table of sources.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = stored(sources.withColumn("weight", F.get(cycle, place % len(weights))), "mix-weights")
    total = float(table.agg(F.sum("source_size")).head()[0] or 0)
    level, cap = 0.0, F.col("source_size") * F.lit(float(most))
    while True:
        stopped = F.col("weight") * F.lit(level) >= cap
        used, open_weight = table.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).head()
        if not open_weight:
            break
        raised = max((share * total - used) / open_weight, 0.0)
        if raised <= level:
            break
        level = raised
    return table.select("source", "source_size", "n", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _pivot(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Rounds the open documents of one bucket; the last one open keeps its probability.

        Documents meet in falling order of mass: those of like mass settle each
        other, so that the one left over, and with it the final error, is small.
        """
        rows = rows.sort_values(
            ["mass", "draw", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True
        )
        p, mass = rows["p"].to_numpy(copy=True), rows["mass"].to_numpy(dtype=np.float64)
        draws = np.random.default_rng([seed, int(rows["draw"].sum()) & 0x7FFFFFFF, len(rows)]).random(len(rows))
        a = 0
        for b in range(1, len(p)):
            up = min((1 - p[a]) * mass[a], p[b] * mass[b])  # words that may move from b to a
            down = min(p[a] * mass[a], (1 - p[b]) * mass[b])
            moved = up if draws[b] * (up + down) < down else -down
            p[a] = min(max(p[a] + moved / mass[a], 0.0), 1.0)
            p[b] = min(max(p[b] - moved / mass[b], 0.0), 1.0)
            if EDGE < p[b] < 1 - EDGE:
                a = b if not EDGE < p[a] < 1 - EDGE else a
        open_ = (p > EDGE) & (p < 1 - EDGE)
        rows["p"] = np.where(open_, p, np.round(p))
        rows["open"] = open_
        return rows

    return run


STEP = "source string, doc_id long, mass long, draw long, bucket long, p double, open boolean"


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    bucket: int = BUCKET,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    The size is the number of words, ``taken`` is copies times size. Rows that
    share doc_id and source (nulls equal) are one unit and get the same copies.
    A unit without words weighs nothing and is rounded by its own chance. Other
    columns are not read; an empty table gives an empty result. The same rows
    give the same mix, however they are partitioned.
    """
    rows = stored(sized(docs), "mix-sizes")
    units = rows.groupBy("source", "doc_id").agg(F.sum("size").alias("mass"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = stored(targets(totals, weights, share, most), "mix-targets")
    known = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = _round(_join_source(units, goals, rows.count(), known).withColumn("rate", rate), seed, bucket, fan_in)
    left = _join_source(rows, goals, rows.count(), known)
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source")
    return (
        left.withColumn("_k", key).alias("a")
        .join(
            copies.withColumn("_k", key).alias("b"),
            F.expr("a._k = b._k AND a.doc_id <=> b.doc_id AND a.source <=> b.source"),
        )
        .select("a.doc_id", "a.source", "a.size", "a.source_size", "a.target", "b.copies", F.expr("b.copies * a.size").alias("taken"))
    )


def _join_source(left: DataFrame, goals: DataFrame, rows: int, known: Column) -> DataFrame:
    """Attach a source's row to its documents; a hot source is dealt to many tasks."""
    goals = goals.withColumn("_source", known).drop("source")
    hot = hot_keys(goals, ["_source"], rows)
    return spread_join(left.withColumn("_source", known), goals, ["_source"], hot, F.col("doc_id")).drop("_source", "n")


def _round(units: DataFrame, seed: int, bucket: int, fan_in: int) -> DataFrame:
    """source, doc_id, copies of each unit (source, doc_id, mass, rate)."""
    whole = F.floor("rate")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("chance")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = units.select(
        "source", "doc_id", "mass", whole.alias("whole"), (F.col("rate") - whole).alias("p"),
        F.xxhash64("doc_id", F.lit(seed)).alias("draw"), chance.alias("chance"),
    )
    start = stored(start, "mix-units")
    open_ = (F.col("mass") > 0) & (F.col("p") > EDGE) & (F.col("p") < 1 - EDGE)
    most = start.where(open_).groupBy("source").count().agg(F.max("count")).head()[0] or 0
    buckets = -(-most // bucket)
    level = start.where(open_).select(
        "source", "doc_id", "mass", "draw", F.pmod("draw", F.lit(max(buckets, 1))).alias("bucket"), "p", F.lit(True).alias("open")
    )
    done = None
    while most:
        level = stored(level.groupBy("source", "bucket").applyInPandas(_pivot(seed), STEP), "mix-level")
        closed = level.where("NOT open")
        done = closed if done is None else done.unionByName(closed)
        level = level.where("open")
        if buckets <= 1:
            break
        buckets = -(-buckets // fan_in)
        level = level.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    rounded = F.when(F.col("chance") < F.col("p"), 1).otherwise(0)
    free = start.where(~open_).select("source", "doc_id", (F.col("whole") + F.when(F.col("p") >= 1 - EDGE, 1).when(F.col("mass") > 0, 0).otherwise(rounded)).cast("long").alias("copies"))
    if done is None:
        return free
    last = level.select("source", "doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    ends = done.select("source", "doc_id", "p").unionByName(last)
    # All open units of a source have the same whole part.
    wholes = start.where(open_).groupBy("source").agg(F.max("whole").alias("whole"), F.count("*").alias("n"))
    known = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    open_copies = _join_source(ends, wholes, start.count(), known)
    return free.unionByName(open_copies.select("source", "doc_id", (F.col("whole") + F.col("p")).cast("long").alias("copies")))
