"""Labelled corpus: clean, profile, weigh and split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.functions.text import is_nonblank
from reviewflow.operators.history import first_per_key
from reviewflow.schema import LABELS, NUM_LABELS

SPLITS = ("train", "val", "test")


def round_half_even(x: str, digits: int) -> str:
    """Rounding by scaling to the nearest even integer."""
    return f"(rint(({x}) * 1e{digits}D) / 1e{digits}D)"


def clean(corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop blank texts and repeated texts, keeping the first by ``(label_id, key)``.

    Ordering by a short hash before the text spares most comparisons of long
    texts; the text stays part of the key, so only equal texts are merged.
    """
    kept = corpus.where(is_nonblank("text")).withColumn("_hash", F.xxhash64("text"))
    return first_per_key(kept, ["_hash", "text"], [F.asc("label_id"), F.asc(key)]).drop("_hash")


def clean_report(corpus: DataFrame) -> DataFrame:
    """Rows before and after cleaning and how many were removed.

    Counts texts by 256-bit digest, so the shuffle carries digests, not texts.
    """
    digest = f"CASE WHEN {is_nonblank('text')} THEN unhex(sha2(text, 256)) END AS d"
    groups = corpus.selectExpr(digest).groupBy("d").agg(F.count("*").alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("d").alias("rows_after")
    )
    return totals.withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def class_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label").agg(F.count("*").alias("n"))


def class_shares(split_corpus: DataFrame) -> DataFrame:
    """Rows and share of each class within each split, to 3 decimals."""
    n = split_corpus.groupBy("split", "label").agg(F.count("*").alias("n"))
    share = round_half_even("n / sum(n) OVER (PARTITION BY split)", 3)
    return n.selectExpr("*", f"{share} AS share")


def class_weights(corpus: DataFrame) -> DataFrame:
    """Balanced weight of each class, ``rows / (classes * rows of the class)``.

    A class without rows is an error.
    """
    tally = corpus.selectExpr(*[f"count_if(label_id = {i}) AS n{i}" for i in range(NUM_LABELS)])
    total = " + ".join(f"n{i}" for i in range(NUM_LABELS))
    rows = ", ".join(
        f"named_struct('label_id', {i}, 'n', n{i}, 'weight', CASE WHEN n{i} = 0 "
        f"THEN CAST(raise_error('class {LABELS[i]} has no rows') AS DOUBLE) "
        f"ELSE ({total}) / ({NUM_LABELS} * n{i}) END)"
        for i in range(NUM_LABELS)
    )
    return tally.selectExpr(f"inline(array({rows}))")


PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
LIMITS = (512, 256)


def length_profile(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """Distribution of an integer length: moments, percentiles, shares over limits.

    Rows are first reduced to one per distinct length, so the final task sees a
    table no longer than the longest text.
    """
    hist = lengths.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("f"))
    sums = hist.selectExpr(
        "sum(f) AS n",
        "CAST(sum(CAST(x AS DECIMAL(20, 0)) * f) AS DOUBLE) AS s1",
        "CAST(sum(CAST(x AS DECIMAL(10, 0)) * CAST(x AS DECIMAL(10, 0)) * f) AS DOUBLE) AS s2",
        "min(x) AS min",
        "max(x) AS max",
        f"percentile(x, array({', '.join(map(str, PERCENTILES))}), f) AS p",
        *[f"sum(IF(x > {limit}, f, 0L)) AS over{limit}" for limit in LIMITS],
    )
    return sums.selectExpr(
        "n",
        "s1 / n AS mean",
        "CASE WHEN n > 1 THEN sqrt((s2 - s1 * s1 / n) / (n - 1)) END AS std",
        "CAST(min AS BIGINT) AS min",
        *[f"p[{i}] AS p{round(q * 100)}" for i, q in enumerate(PERCENTILES)],
        "CAST(max AS BIGINT) AS max",
        *[f"{round_half_even(f'over{limit} / n', 3)} AS share_over_{limit}" for limit in LIMITS],
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "label_id", seed: int = 42, prefix: int = 4
) -> DataFrame:
    """Add ``split``: a 70/15/15 division within each class, exact and repeatable.

    Rows are ordered by a seeded digest of ``key``, which should be unique. Where
    each class is cut follows from counts per digest prefix and from ranking only
    the rows whose prefix a cut falls into; the rows themselves are then labelled
    in place by comparing with at most two cut points per class. Nothing of the
    size of the data is shuffled or broadcast.
    """
    order = f"md5(concat('{seed}:', CAST({key} AS STRING))) AS _order"
    narrow = df.selectExpr(f"{label} AS _class", order).selectExpr(
        "*", f"substring(_order, 1, {prefix}) AS _bucket"
    )
    cuts = F.broadcast(_cut_points(narrow))
    joined = df.selectExpr("*", order).join(cuts, F.expr(f"{label} <=> _class"), "left")
    split = "CASE WHEN _order <= _train_end THEN 'train' WHEN _order <= _val_end THEN 'val' ELSE 'test' END"
    return joined.selectExpr(*df.columns, f"{split} AS split")


def _cut_points(narrow: DataFrame) -> DataFrame:
    """Per class the digest of the last train and the last validation row."""
    counts = narrow.groupBy("_class", "_bucket").agg(F.count("*").alias("n"))
    placed = counts.selectExpr(
        "*",
        "sum(n) OVER (PARTITION BY _class ORDER BY _bucket) AS upto",
        "sum(n) OVER (PARTITION BY _class) AS size",
    )
    sized = placed.join(F.broadcast(_split_sizes(placed)), "_class")
    # Only buckets holding a cut, at most two per class.
    cut_in = "({0} > upto - n AND {0} <= upto)"
    holding = sized.where(f"{cut_in.format('train_end')} OR {cut_in.format('val_end')}")
    # Equal keys are counted first, so a repeated key costs one row and stays in one split.
    keys = ["_class", "_bucket", "_order", "before", "train_end", "val_end"]
    distinct = (
        narrow.join(F.broadcast(holding.selectExpr("*", "upto - n AS before")), ["_class", "_bucket"])
        .groupBy(*keys)
        .agg(F.count("*").alias("m"))
    )
    ranked = distinct.selectExpr(
        "*", "before + sum(m) OVER (PARTITION BY _class, _bucket ORDER BY _order) AS rank"
    )
    first_at = "min(CASE WHEN {0} > 0 AND rank >= {0} THEN _order END) AS _{0}"
    return ranked.groupBy("_class").agg(
        F.expr(first_at.format("train_end")), F.expr(first_at.format("val_end"))
    )


def _split_sizes(placed: DataFrame) -> DataFrame:
    """Ranks at which train and validation end in each class.

    The held-out part is 30 % of all rows, rounded up, the test part half of
    it, rounded up; each is shared among the classes by largest remainder.
    Works on one row per class.
    """
    classes = placed.groupBy("_class").agg(F.max("size").alias("size"))
    held = _share_out(classes, "(sum(size) OVER () * 3 + 9) DIV 10", "size", "held")
    test = _share_out(held, "(sum(held) OVER () + 1) DIV 2", "held", "test")
    return test.selectExpr("_class", "size - held AS train_end", "size - test AS val_end")


def _share_out(classes: DataFrame, total: str, weight: str, out: str) -> DataFrame:
    """Share a total among the classes in proportion to a weight, by largest remainder."""
    kept = classes.columns
    totals = classes.selectExpr("*", f"{total} AS _total", f"sum({weight}) OVER () AS _sum")
    floors = totals.selectExpr(
        "*", f"(_total * {weight}) DIV _sum AS _floor", f"(_total * {weight}) % _sum AS _rest"
    )
    places = floors.selectExpr(
        "*",
        "_total - sum(_floor) OVER () AS _left",
        "row_number() OVER (ORDER BY _rest DESC, _class) AS _place",
    )
    return places.selectExpr(*kept, f"_floor + IF(_place <= _left, 1L, 0L) AS {out}")
