"""Line dedup: removes lines that spread over many sites.

A HyperLogLog sketch of the sites of each line is merged by aggregation. Where an
estimate is too near the threshold to decide, the sites are counted exactly. A
line on enough sites is boilerplate; its first occurrence stays, so that nothing
vanishes from the corpus, and every other one is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.session import discard, stored

MIN_SITES = 8
SKETCH_BITS = 10  # 2**10 registers: a standard error of 3.3 %
NEAR = 0.25  # estimates within this share of the threshold are counted exactly: over 7 standard errors


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("site"), _row_key(F.col("text")),
    )


def _row_key(text: Column) -> Column:
    """Tells the rows of a doc_id apart."""
    return F.xxhash64(text.cast("string")).alias("row_key")


def _line_key(line: Column) -> list[Column]:
    """128 bits of a trimmed line."""
    trimmed = F.trim(line, F.lit(" \t\r"))
    return [F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(7), trimmed).alias("h2")]


def line_occurrences(docs: DataFrame) -> DataFrame:
    """doc, row_key, site, no, h1, h2 of each line that is not blank."""
    lines = _rows(docs).select("doc", "row_key", "site", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.trim("line", F.lit(" \t\r")) != "").select("doc", "row_key", "site", "no", *_line_key(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, n, first (doc, no) of each line on at least ``min_sites`` sites."""
    keys = ["h1", "h2"]
    sketched = lines.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("estimate"), F.count("*").alias("n"),
        F.min(F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "no")).alias("first"),
    )
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    sketched = stored(sketched.where((F.col("estimate") >= low) & (F.col("n") >= min_sites)), "line-sketches")
    near = sketched.where(F.col("estimate") <= high)
    sites = lines.select(*keys, "site").distinct()  # combines before the shuffle; a line near the threshold has few
    exact = sites.join(near.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("sites"))
    passed = near.join(exact.where(F.col("sites") >= min_sites), keys, "left_semi")
    return sketched.where(F.col("estimate") > high).unionByName(passed).select(*keys, "n", "first")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines and n_removed added.

    Lines end at newlines and are compared after trimming spaces, tabs and
    returns; blank lines always stay. A site is a ``source``; all null sources
    are one site. Of a boilerplate line the occurrence with the least doc_id
    (null last) and line number stays; rows that share that doc_id keep it each.
    Rows that share a doc_id but not a text lose their own lines only. A row
    without doc_id keeps its lines. A null text stays null
    with no lines. Extra columns pass through; columns called n_lines or
    n_removed are replaced.
    """
    keys = ["h1", "h2"]
    lines = stored(line_occurrences(docs), "line-hashes")
    common = stored(boilerplate(lines, min_sites), "line-common")
    hits = spread_join(lines, common, keys, hot_keys(common, keys, lines.count()), F.xxhash64("doc", "no"))
    stays = F.col("first").eqNullSafe(F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "no"))
    removed = hits.where(~stays).groupBy("doc", "row_key").agg(F.collect_set("no").alias("removed"))
    # A row without doc_id is found again by no join; such rows are rare and keep their lines.
    removed = stored(removed.where("doc IS NOT NULL"), "line-removed")
    discard(lines, common)

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), _row_key(F.col("text")))
    joined = rows.join(removed.hint("shuffle_hash"), ["doc", "row_key"], "left")
    joined = joined.withColumn("lines", F.when(F.col("removed").isNotNull(), F.split(F.col("row.text").cast("string"), "\n")))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed")
    joined = joined.withColumn("kept", F.when(
        F.size("lines") > 0, F.transform(numbers, lambda i: F.get("lines", i))
    ))
    text = F.when(F.col("removed").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    n_lines = F.coalesce(F.length("row.text") - F.length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = joined.select(
        *[F.col("row").getField(c).alias(c) for c in others], text.alias("text"), n_lines.cast("long").alias("n_lines"),
        F.when(F.col("row.text").isNull() | F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )
    return out.select(*order, "n_lines", "n_removed")
