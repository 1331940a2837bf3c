"""Topics: Kafka options, and a Parquet topic log with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.schema import HISTORY_COLUMNS, TOPIC_RECORD

SINK_COLUMNS = ("key", "value", "topic", "headers")


def kafka_source_options(
    servers: str,
    topic: str,
    start: str = "earliest",
    resuming: bool = False,
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Reader options; only committed records are read.

    ``start`` applies to a first run: ``earliest``, ``latest``, or ``error``,
    which insists on a position to resume from.
    """
    if start not in ("earliest", "latest", "error"):
        raise ValueError("start must be earliest, latest or error")
    if start == "error" and not resuming:
        raise RuntimeError("there is no stored position to start from")
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest" if start == "error" else start,
        "failOnDataLoss": "true",
        "kafka.isolation.level": "read_committed",
        "includeHeaders": "true",
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_sink_options(servers: str, delivery_timeout_ms: int = 30_000) -> dict[str, str]:
    """Writer options: every record acknowledged by all replicas, without duplicates."""
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.enable.idempotence": "true",
        "kafka.acks": "all",
        "kafka.delivery.timeout.ms": str(delivery_timeout_ms),
    }


def read_kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def kafka_records(df: DataFrame) -> DataFrame:
    """The columns the Kafka sink takes; it assigns partition and offset itself."""
    return df.select(*[c for c in SINK_COLUMNS if c in df.columns])


def read_topic_log(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """A topic of a Parquet log as a batch."""
    return spark.read.schema(TOPIC_RECORD).parquet(path).where(F.col("topic") == topic)


def stream_topic_log(
    spark: SparkSession, path: str, topic: str, max_files: int | None = None
) -> DataFrame:
    """A topic of a Parquet log as a stream; other topics' folders are not read."""
    reader = spark.readStream.schema(TOPIC_RECORD)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).where(F.col("topic") == topic)


def write_topic_log(records: DataFrame, path: str) -> None:
    """Append keyed records to a Parquet log, one folder per topic."""
    records.write.mode("append").partitionBy("topic").parquet(path)


def jdbc_options(url: str, table: str, **extra: str) -> dict[str, str]:
    """Options for the history in a relational database."""
    return {"url": url, "dbtable": table, "driver": "org.postgresql.Driver", **extra}


def merge_statement(staging: str, target: str) -> str:
    """SQL by which PostgreSQL moves staged rows to the history, each prediction once.

    It returns the ids that were new. Rows whose id or model identity is stored
    already are ignored, as a replay stages them again; the staged rows go in the
    same transaction.
    """
    columns = ", ".join(HISTORY_COLUMNS[:-1])
    return (
        f"WITH staged AS (DELETE FROM {staging} RETURNING {columns}), "
        f"first AS (SELECT DISTINCT ON (prediction_id) {columns} FROM staged ORDER BY prediction_id, predicted_at) "
        f"INSERT INTO {target} ({columns}) SELECT {columns} FROM first "
        "ON CONFLICT DO NOTHING RETURNING prediction_id"
    )


def write_jdbc_staging(rows: DataFrame, options: dict[str, str]) -> None:
    """Append new history rows to a staging table, from which the database merges them."""
    rows.write.format("jdbc").options(**options).mode("append").save()
