"""The online path as Structured Streaming jobs.

Each job commits its input position only after its sink has the output, so a
crash repeats a batch instead of losing it. Replays are harmless: the file sink
skips a batch it already has, the history leaves out stored ids, and event and
prediction ids are derived from the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewflow.functions.decision import DecisionConfig
from reviewflow.operators import contracts, events, history, ingest
from reviewflow.operators.events import ModelIdentity
from reviewflow.operators.rules import require, require_valid
from reviewflow.operators.scoring import predict_events
from reviewflow.schema import DEAD_LETTER_TOPIC, PREDICTIONS_TOPIC, REVIEWS_TOPIC
from reviewflow.sources import topics

ARRIVAL = ("partition", "offset")
NOW = "current_timestamp()"  # one value per query or micro-batch


def publish(reviews: DataFrame, topic: str = REVIEWS_TOPIC) -> DataFrame:
    """Event records of a stream or batch of reviews; an invalid review fails the job."""
    valid = require_valid(contracts.validate_reviews(reviews))
    return events.review_records(events.review_events(valid, NOW), topic)


def publish_after(
    spark: SparkSession,
    reviews: DataFrame,
    cursor: ingest.CursorTable,
    write,
    page: int | None = None,
    lookback: str | None = None,
    published: DataFrame | None = None,
) -> int:
    """One incremental run: read above the cursor, publish, then move the cursor.

    Without ``page`` everything above the cursor is published at once, spread
    over the cluster. The end of the run is fixed first, from the ids alone, so
    that the cursor never passes a review that was not published. ``write``
    receives the records and must return only when they are stored.

    A review inserted later with an id below the cursor is seen only if
    ``lookback`` names a lower id: everything between the two is then read again
    in full, whatever the page, and what ``published`` (review_id) holds is left
    out. Returns the number of published reviews.
    """
    start = cursor.load()
    above = ingest.after(reviews, start)
    ids = above.select(ingest.normal_id().alias("review_id"))
    if page is not None:
        ids = ids.orderBy("review_id").limit(page)
    count, last = ids.agg(F.count("*"), F.max("review_id")).first()
    batch = above.where(ingest.normal_id() <= last) if count else above.where("false")
    if lookback is not None and start is not None:
        missed = ingest.late(reviews, lookback, start, published)
        count, batch = count + missed.count(), batch.unionByName(missed)
    if count:
        write(publish(batch, cursor.target_topic))
        if last is not None:
            cursor.save(last, expected=start)
    return count


def publish_until_empty(
    spark: SparkSession, read, cursor: ingest.CursorTable, write, page: int | None = None
) -> int:
    """Publish run after run until nothing is above the cursor; return how many in all.

    ``read`` gives the reviews anew for each run. A caller that polls waits
    after this returns and calls it again.
    """
    total = 0
    while count := publish_after(spark, read(), cursor, write, page):
        total += count
    return total


def score(
    records: DataFrame,
    udf,
    config: DecisionConfig,
    model: ModelIdentity,
    output_topic: str = PREDICTIONS_TOPIC,
    dead_letter_topic: str = DEAD_LETTER_TOPIC,
) -> DataFrame:
    """Prediction and dead-letter records of a stream or batch of review records."""
    parsed = contracts.parse_review_events(records)
    return events.route(
        predict_events(parsed, udf, config), model, NOW, output_topic, dead_letter_topic
    )


def predictions_to_history(records: DataFrame, strict: bool = True) -> DataFrame:
    """History rows of prediction records; an invalid record fails the job if strict."""
    parsed = contracts.parse_prediction_events(records)
    if strict:
        parsed = require(parsed, "error_type IS NOT NULL", "error_message")
    else:
        parsed = parsed.where("error_type IS NULL")
    flat = parsed.select("event.*", *ARRIVAL)
    return events.history_rows(flat, keep=ARRIVAL)


def start_topic_sink(
    records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write keyed records to a Parquet topic log."""
    return (
        records.writeStream.format("parquet")
        .partitionBy("topic")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def start_kafka_sink(
    records: DataFrame, options: dict[str, str], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write keyed records to Kafka."""
    return (
        topics.kafka_records(records).writeStream.format("kafka")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "200 milliseconds"}))
        .start()
    )


def start_history_sink(
    records: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    strict: bool = True,
    horizon: str | None = None,
) -> StreamingQuery:
    """Insert prediction records into the history table, each prediction once.

    With ``horizon`` (an interval such as ``1 hour``) a prediction that has arrived
    within it is dropped before the table is asked, so a replay costs no read of
    stored ids. The state holds the ids of one horizon, and what lies further back
    is still found in the table. Time is that of arrival, the batch's: no record
    is ever late. Of copies in one batch any may be the one that goes on.
    """
    spark = records.sparkSession
    if horizon is not None:
        rows = predictions_to_history(records, strict).withColumn("_arrived", F.current_timestamp())
        rows = rows.withWatermark("_arrived", horizon).dropDuplicatesWithinWatermark(["prediction_id"])
        records = rows.drop("_arrived")

    def insert(batch: DataFrame, _epoch: int) -> None:
        rows = (batch if horizon is not None else predictions_to_history(batch, strict)).persist()
        try:
            order = [F.asc(c) for c in ARRIVAL]
            history.insert_if_absent(spark, path, rows, F.current_timestamp(), order)
        finally:
            rows.unpersist()

    return (
        records.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
