"""Projections between reviews, events, topic records and history rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from reviewflow.functions import ids, quoted
from reviewflow.schema import (
    DEAD_LETTER_TOPIC,
    DEAD_LETTER_WORKER,
    JSON_HEADERS,
    PREDICTIONS_TOPIC,
    REVIEWS_TOPIC,
    SCHEMA_VERSION,
)

HEADERS = "array(%s)" % ", ".join(
    f"named_struct('key', '{k}', 'value', CAST('{v}' AS BINARY))" for k, v in JSON_HEADERS
)


@dataclass(frozen=True)
class ModelIdentity:
    """Name, version and optional run of the scoring model."""

    name: str
    version: str
    run_id: str | None = None

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.version.strip():
            raise ValueError("model name and version must not be blank")

    def struct(self) -> str:
        run = "CAST(NULL AS STRING)" if self.run_id is None else quoted(self.run_id)
        return f"named_struct('name', {quoted(self.name)}, 'version', {quoted(self.version)}, 'run_id', {run})"

    def prediction_id(self, source_event_id: str) -> str:
        return ids.prediction_id(source_event_id, quoted(self.name), quoted(self.version))


def _struct(source: str, *names: str) -> str:
    return ", ".join(f"'{n}', {source}{n}" for n in names)


def review_events(reviews: DataFrame, emitted_at: str) -> DataFrame:
    """Versioned events of validated reviews; one ``emitted_at`` per batch."""
    return reviews.selectExpr(
        f"{SCHEMA_VERSION} AS schema_version",
        f"{ids.event_id('review_id')} AS event_id",
        "review_id",
        "movie_id",
        "text",
        "created_at AS source_created_at",
        f"{emitted_at} AS emitted_at",
    )


def review_records(events: DataFrame, topic: str = REVIEWS_TOPIC) -> DataFrame:
    """Keyed topic records of review events; absent values are left out of the JSON."""
    members = _struct("", "schema_version", "event_id", "review_id", "movie_id", "text")
    json = (
        f"to_json(named_struct({members}, 'source_created_at', {ids.format_utc('source_created_at')}, "
        f"'emitted_at', {ids.format_utc('emitted_at')}))"
    )
    return events.selectExpr(
        "CAST(review_id AS BINARY) AS key",
        f"CAST({json} AS BINARY) AS value",
        f"{quoted(topic)} AS topic",
        f"{HEADERS} AS headers",
    )


def prediction_event(event: str, prediction: str, model: ModelIdentity, at: str) -> str:
    """Prediction event of a review event and its prediction core."""
    core = _struct(f"{prediction}.", "sentiment", "label_id", "confidence", "probabilities")
    source = _struct(f"{event}.", "review_id", "movie_id", "source_created_at")
    return (
        f"named_struct({core}, 'schema_version', {SCHEMA_VERSION}, "
        f"'prediction_id', {model.prediction_id(f'{event}.event_id')}, "
        f"'source_event_id', {event}.event_id, {source}, "
        f"'model', {model.struct()}, 'predicted_at', {at})"
    )


def prediction_event_json(e: str) -> str:
    members = _struct(
        e, "sentiment", "label_id", "confidence", "probabilities", "schema_version", "prediction_id",
        "source_event_id", "review_id", "movie_id",
    )
    return (
        f"to_json(named_struct({members}, 'source_created_at', {ids.format_utc(e + 'source_created_at')}, "
        f"'model', {e}model, 'predicted_at', {ids.format_utc(e + 'predicted_at')}))"
    )


def dead_letter(failed_at: str) -> str:
    """Dead letter of a rejected record: raw bytes, coordinates and the error."""
    return (
        f"named_struct('schema_version', {SCHEMA_VERSION}, 'worker', '{DEAD_LETTER_WORKER}', "
        "'source_topic', topic, 'source_partition', partition, 'source_offset', offset, "
        f"'key_base64', CASE WHEN length(key) > 0 THEN {ids.plain_base64('key')} END, "
        f"'payload_base64', coalesce({ids.plain_base64('value')}, ''), "
        f"'error_type', error_type, 'error_message', error_message, 'failed_at', {failed_at})"
    )


def dead_letters(parsed: DataFrame, failed_at: str) -> DataFrame:
    """One dead letter per rejected record."""
    rejected = parsed.where("error_type IS NOT NULL")
    return rejected.selectExpr(f"{dead_letter(failed_at)} AS d").select("d.*")


def dead_letter_json(d: str) -> str:
    members = _struct(
        d, "schema_version", "worker", "source_topic", "source_partition", "source_offset",
        "key_base64", "payload_base64", "error_type", "error_message",
    )
    return f"to_json(named_struct({members}, 'failed_at', {ids.format_utc(d + 'failed_at')}))"


def route(
    scored: DataFrame,
    model: ModelIdentity,
    at: str,
    output_topic: str = PREDICTIONS_TOPIC,
    dead_letter_topic: str = DEAD_LETTER_TOPIC,
) -> DataFrame:
    """Outgoing records of parsed and scored input records, one each.

    Valid records (with a ``prediction``) become prediction events keyed by
    review, the others dead letters under their raw key. One projection, so a
    record is parsed and scored once and keeps its place in its partition.
    """
    made = scored.selectExpr(
        "*",
        "error_type IS NULL AS _ok",
        f"CASE WHEN error_type IS NULL THEN {prediction_event('event', 'prediction', model, at)} END AS _out",
        f"CASE WHEN error_type IS NOT NULL THEN {dead_letter(at)} END AS _dead",
    )
    value = f"CASE WHEN _ok THEN {prediction_event_json('_out.')} ELSE {dead_letter_json('_dead.')} END"
    return made.selectExpr(
        "CASE WHEN _ok THEN CAST(event.review_id AS BINARY) ELSE key END AS key",
        f"CAST({value} AS BINARY) AS value",
        f"CASE WHEN _ok THEN {quoted(output_topic)} ELSE {quoted(dead_letter_topic)} END AS topic",
        "partition",
        "offset",
        f"{at} AS timestamp",
        f"{HEADERS} AS headers",
    )


def history_rows(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction events flattened to the 16 columns written to the history."""
    return events.selectExpr(
        "prediction_id",
        "CAST(schema_version AS SMALLINT) AS schema_version",
        "source_event_id",
        "review_id",
        "movie_id",
        "source_created_at",
        "sentiment",
        "CAST(label_id AS SMALLINT) AS label_id",
        "confidence",
        "probabilities.neg AS probability_neg",
        "probabilities.neu AS probability_neu",
        "probabilities.pos AS probability_pos",
        "model.name AS model_name",
        "model.version AS model_version",
        "model.run_id AS model_run_id",
        "predicted_at",
        *keep,
    )
