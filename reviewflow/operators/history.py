"""Prediction history: idempotent insert, latest view, lookup, delete, compaction, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewflow.operators.sizes import with_keys, without_keys
from reviewflow.schema import HISTORY, HISTORY_COLUMNS
from reviewflow.session import stored

MODEL_COLUMNS = ("model_name", "model_version")
BUCKET_DIGITS = 3  # leading hex digits of a review id: buckets of 12 days, 4,096 in all
PARTITIONS = (*MODEL_COLUMNS, "review_bucket")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    ``row_number() = 1`` is planned with a group limit before the shuffle: each
    input task forwards at most one row per key, however many rows a key has.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_predictions(history: DataFrame) -> DataFrame:
    """The newest prediction of each review."""
    order = [F.desc("predicted_at"), F.desc("stored_at"), F.desc("prediction_id")]
    return first_per_key(history, ["review_id"], order)


def new_rows(batch: DataFrame, history: DataFrame, arrival: list[Column]) -> DataFrame:
    """Batch rows whose prediction id is neither stored nor earlier in the batch."""
    fresh = first_per_key(batch, ["prediction_id"], arrival)
    return fresh.join(history.select("prediction_id"), "prediction_id", "left_anti")


def insert_if_absent(
    spark: SparkSession, path: str, batch: DataFrame, stored_at: Column, arrival: list[Column]
) -> int:
    """Append the batch's new rows to the history table; return how many.

    An id is derived from the review and the model version, so only rows of the
    batch's partitions can collide; only their id column is read. Safe to repeat:
    after a crash during this write, or between it and the commit of the input
    position, the replayed rows that were stored are found and left out. One
    writer at a time per table.
    """
    fresh = with_bucket(first_per_key(batch, ["prediction_id"], arrival)).persist()
    try:
        touched = fresh.select(*PARTITIONS).distinct().collect()  # at most versions x buckets
        known = read_partitions(spark, path).where(_within(touched)).select("prediction_id")
        rows = fresh.join(known, "prediction_id", "left_anti").withColumn("stored_at", stored_at)
        rows = rows.select(*HISTORY_COLUMNS).persist()
        try:
            inserted = rows.count()
            if inserted:
                write_history(rows, path)
            return inserted
        finally:
            rows.unpersist()
    finally:
        fresh.unpersist()


def with_bucket(rows: DataFrame) -> DataFrame:
    """Add the partition column made of the leading, time part of the review id."""
    return rows.withColumn("review_bucket", F.substring("review_id", 1, BUCKET_DIGITS))


def _within(partitions: list) -> Column:
    """A literal filter on partition columns: only the listed partitions are listed and read."""
    wanted = F.lit(False)
    models: dict[tuple, list] = {}
    for p in partitions:
        models.setdefault((p.model_name, p.model_version), []).append(p.review_bucket)
    for (name, version), buckets in models.items():
        wanted = wanted | (
            (F.col("model_name") == name) & (F.col("model_version") == version) & F.col("review_bucket").isin(buckets)
        )
    return wanted


def write_history(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by model version and review bucket; each file sorted by review.

    Rows of a partition are gathered into few files; a large partition is split.
    The sort starts with the partition columns, as otherwise the writer sorts by
    them again and the order by review is lost. For the same reason they must not
    be nullable, and not constant, which would drop them from the sort.
    """
    rows = with_bucket(rows)
    nothing = F.substring(F.coalesce("review_id", F.lit("")), 1, 0)
    (
        rows.withColumns({c: F.concat(F.coalesce(c, F.lit("")), nothing) for c in PARTITIONS}).hint("rebalance", *PARTITIONS)
        .sortWithinPartitions(*PARTITIONS, "review_id", F.desc("predicted_at"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#prediction_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")  # sized to the file's rows
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """The stored history with its bucket column; empty before the first write."""
    if not path_exists(spark, path):
        return with_bucket(spark.createDataFrame([], HISTORY))
    return spark.read.schema(f"{HISTORY}, review_bucket STRING").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The stored history, empty before the first write."""
    return read_partitions(spark, path).select(*HISTORY_COLUMNS)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def lookup(history: DataFrame, prediction_id: str) -> DataFrame:
    return history.where(F.col("prediction_id") == prediction_id)


def lookup_review(spark: SparkSession, path: str, review_id: str) -> DataFrame:
    """The stored predictions of a review; only its bucket is read."""
    bucket = F.col("review_bucket") == review_id[:BUCKET_DIGITS]
    return read_partitions(spark, path).where(bucket & (F.col("review_id") == review_id)).select(*HISTORY_COLUMNS)


def counts(history: DataFrame, prediction_id: str | None = None) -> DataFrame:
    """Rows per sentiment and model version, of one prediction or of all."""
    rows = history if prediction_id is None else lookup(history, prediction_id)
    return rows.groupBy("sentiment", *MODEL_COLUMNS).agg(F.count("*").alias("n"))


def delete_by_key(history: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The history without the rows of the given reviews or predictions."""
    return without_keys(history, keys, on, F.col("prediction_id"))


def delete_stored(spark: SparkSession, path: str, keys: DataFrame, on: str) -> int:
    """Delete the stored rows of the given keys; return the number of rewritten partitions.

    Only partitions that hold such a row are rewritten. Keys that are review ids
    also restrict the partitions that are searched.
    """
    rows = read_partitions(spark, path)
    if on == "review_id":
        buckets = [r.review_bucket for r in with_bucket(keys.select(on)).select("review_bucket").distinct().collect()]
        rows = rows.where(F.col("review_bucket").isin(buckets))
    hits = with_keys(rows, keys, on, F.col("prediction_id"))
    return _rewrite(spark, path, hits, lambda found: delete_by_key(found, keys, on))


def compact(spark: SparkSession, path: str, files: int = 1) -> int:
    """Rewrite the partitions that have more than ``files`` files; return how many."""
    rows = read_partitions(spark, path).select(*PARTITIONS, F.col("_metadata.file_path").alias("file"))
    many = rows.groupBy(*PARTITIONS).agg(F.count_distinct("file").alias("n")).where(F.col("n") > files)
    return _rewrite(spark, path, many, lambda found: found)


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, change) -> int:
    """Replace the partitions named by ``touched`` by what ``change`` makes of their rows.

    The new rows are stored beside the table first, so that a run that ends early
    loses nothing; a partition that keeps no row is removed.
    """
    partitions = touched.select(*PARTITIONS).distinct().collect()
    if not partitions:
        return 0
    rows = read_partitions(spark, path).where(_within(partitions))
    folders = rows.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), *PARTITIONS).distinct().collect()
    kept = stored(change(rows).select(*HISTORY_COLUMNS), "history-rewrite")
    left = {tuple(r) for r in with_bucket(kept).select(*PARTITIONS).distinct().collect()}
    write_history(kept, path, "overwrite")
    for r in folders:
        if (r.model_name, r.model_version, r.review_bucket) not in left:
            folder = spark._jvm.org.apache.hadoop.fs.Path(r.folder)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(partitions)


def uniqueness_violations(history: DataFrame) -> DataFrame:
    """Keys stored more than once, for both unique constraints."""

    def repeated(name: str, *columns: str) -> DataFrame:
        groups = history.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        return groups.select(
            F.lit(name).alias("constraint_name"), F.concat_ws("|", *columns).alias("key"), "n"
        )

    return repeated("primary_key", "prediction_id").unionByName(
        repeated("model_identity", "source_event_id", *MODEL_COLUMNS)
    )
