"""Record schemas and the fixed values of the contracts."""

from __future__ import annotations

# Class order, tolerances, truncation profiles, literals.
LABELS = ("neg", "neu", "pos")
LABEL_TO_ID = {"neg": 0, "neu": 1, "pos": 2}
NUM_LABELS = 3
SCHEMA_VERSION = 1
PROBABILITY_TOLERANCE = 1e-6
MAX_LENGTH, HEAD_TOKENS, TAIL_TOKENS = 512, 256, 254
SHORT_MAX_LENGTH, SHORT_HEAD_TOKENS, SHORT_TAIL_TOKENS = 256, 128, 126
SPECIAL_TOKENS = 2
DEAD_LETTER_WORKER = "sentiment-inference"
STRATEGIES = ("argmax", "class_bias", "thresholds")
JSON_HEADERS = (("content-type", "application/json"), ("schema-version", "1"))

# Default topic names.
REVIEWS_TOPIC = "reviews.v1"
PREDICTIONS_TOPIC = "predictions.v1"
DEAD_LETTER_TOPIC = "reviews.dlq.v1"

REVIEW = "review_id STRING, text STRING, movie_id STRING, created_at TIMESTAMP"

PROBABILITIES = "STRUCT<neg: DOUBLE, neu: DOUBLE, pos: DOUBLE>"
MODEL = "STRUCT<name: STRING, version: STRING, run_id: STRING>"

REVIEW_EVENT = (
    "schema_version INT, event_id STRING, review_id STRING, movie_id STRING, "
    "text STRING, source_created_at TIMESTAMP, emitted_at TIMESTAMP"
)

PREDICTION_EVENT = (
    f"sentiment STRING, label_id INT, confidence DOUBLE, probabilities {PROBABILITIES}, "
    "schema_version INT, prediction_id STRING, source_event_id STRING, review_id STRING, "
    f"movie_id STRING, source_created_at TIMESTAMP, model {MODEL}, predicted_at TIMESTAMP"
)

DEAD_LETTER = (
    "schema_version INT, worker STRING, source_topic STRING, source_partition INT, "
    "source_offset BIGINT, key_base64 STRING, payload_base64 STRING, error_type STRING, "
    "error_message STRING, failed_at TIMESTAMP"
)

TOPIC_RECORD = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, timestamp TIMESTAMP, "
    "headers ARRAY<STRUCT<key: STRING, value: BINARY>>"
)

HISTORY = (
    "prediction_id STRING, schema_version SMALLINT, source_event_id STRING, review_id STRING, "
    "movie_id STRING, source_created_at TIMESTAMP, sentiment STRING, label_id SMALLINT, "
    "confidence DOUBLE, probability_neg DOUBLE, probability_neu DOUBLE, probability_pos DOUBLE, "
    "model_name STRING, model_version STRING, model_run_id STRING, predicted_at TIMESTAMP, "
    "stored_at TIMESTAMP"
)
HISTORY_COLUMNS = tuple(part.split()[0] for part in HISTORY.split(", "))

CURSOR = (
    "checkpoint_id STRING, schema_version INT, last_review_id STRING, "
    "source_collection STRING, target_topic STRING, updated_at TIMESTAMP"
)

DECISION_CONFIG = (
    "temperature DOUBLE, strategy STRING, "
    "params STRUCT<bias: ARRAY<DOUBLE>, thresholds: ARRAY<DOUBLE>>"
)
