"""Review, event, logit and history views over the given tables.

The faulty variants break whole sources (or label groups) in one way each, so
an oracle knows what each record must yield without parsing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.functions import ids, quoted
from reviewflow.functions.decision import DecisionConfig, add_prediction
from reviewflow.functions.text import strip_text
from reviewflow.operators import events
from reviewflow.operators.events import ModelIdentity
from reviewflow.schema import HISTORY_COLUMNS, PREDICTIONS_TOPIC, REVIEWS_TOPIC
from reviewflow.session import configure, stored

EMITTED_AT = "2026-01-01T00:00:00Z"
PREDICTED_AT = "2026-01-02T03:04:05.678901Z"
TEMPERATURE = 1.3
ARGMAX = DecisionConfig(TEMPERATURE)
CLASS_BIAS = DecisionConfig(TEMPERATURE, "class_bias", bias=(0.25, 0.25, 0.0))
THRESHOLDS = DecisionConfig(TEMPERATURE, "thresholds", thresholds=(0.45, 0.25, 0.45))
MODEL_A = ModelIdentity("demo-sentiment", "1", "run-a")
MODEL_B = ModelIdentity("demo-sentiment", "2", None)

# The second model's own output order and names.
EXTERNAL_NAMES = {0: "neutral", 1: "positive", 2: "negative"}
EXTERNAL_TO_LABEL = {"neutral": "neu", "positive": "pos", "negative": "neg"}
TOPIC_PARTITIONS = 3

# How each source breaks its review events; other sources are sound.
EVENT_FAULTS = {
    "src0": "null_value",
    "src1": "cut_json",
    "src2": "json_array",
    "src3": "bad_utf8",
    "src4": "version_text",
    "src5": "version_two",
    "src6": "unknown_field",
    "src7": "blank_text",
    "src8": "foreign_event_id",
    "src9": "naive_time",
    "src10": "upper_review_id",
    "src11": "other_key",
    "src12": "null_key",
    "src13": "bad_utf8_key",
    "src14": "newline_review_id",
    "src15": "trailing_text",
    "src16": "offset_time",
    "src17": "version_decimal",
}

# How each source breaks its prediction events.
PREDICTION_FAULTS = {
    "src0": "null_value",
    "src1": "label_mismatch",
    "src2": "sum_off",
    "src3": "sum_within",
    "src4": "confidence_off",
    "src5": "label_text",
    "src6": "model_extra",
    "src7": "blank_run",
    "src8": "other_prediction_id",
    "src9": "naive_time",
    "src10": "probability_text",
    "src11": "other_key",
    "src12": "probability_missing",
}

# How each source breaks its review documents.
DOCUMENT_FAULTS = {
    "src0": "upper_id",
    "src1": "short_id",
    "src2": "unicode_blank_text",
    "src3": "tab_movie",
    "src4": "naive_time",
    "src5": "offset_time",
    "src6": "ascii_blank_text",
    "src7": "null_movie",
    "src8": "newline_id",
}


TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under its known schema, so no file is opened to infer one."""
    return configure(spark).read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def instant(text: str) -> str:
    return f"to_timestamp('{text}')"


def hex_id(number: str) -> str:
    return f"lower(lpad(hex({number}), 24, '0'))"


def documents_as_reviews(documents: DataFrame, moments: DataFrame) -> DataFrame:
    created = moments.selectExpr("event_id AS doc_id", "CAST(ts AS TIMESTAMP) AS created_at")
    return documents.join(created, "doc_id", "left").selectExpr(
        f"{hex_id('doc_id')} AS review_id", "text", "source AS movie_id", "created_at", "doc_id"
    )


def with_creation(page: DataFrame, moments: DataFrame) -> DataFrame:
    """A page of few rows with a ``doc_id`` and its ``created_at``; ``moments`` is read past it, not shuffled."""
    page = stored(page, "page-documents")
    near = moments.join(F.broadcast(page.select("doc_id").distinct()), F.col("event_id") == F.col("doc_id"), "left_semi")
    created = near.selectExpr("event_id AS doc_id", "CAST(ts AS TIMESTAMP) AS created_at")
    return page.join(created, "doc_id", "left")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as reviews; the creation time comes from ``events``."""
    return documents_as_reviews(table(spark, sf_dir, "documents"), table(spark, sf_dir, "events"))


def by_case(column: str, values: dict[str, str], other: str) -> str:
    """The expression listed for a column's value, else ``other``."""
    cases = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in values.items())
    return f"CASE {column} {cases} ELSE {other} END"


def with_fault(df: DataFrame, faults: dict[str, str]) -> DataFrame:
    named = {source: quoted(fault) for source, fault in faults.items()}
    return df.selectExpr("*", f"{by_case('movie_id', named, quoted('none'))} AS fault")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review documents as stored, some broken: ``_id, text, movie_id, created_at`` as text."""
    rows = with_fault(reviews(spark, sf_dir), DOCUMENT_FAULTS)
    wall = "date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    ids_by = {"upper_id": "upper(review_id)", "short_id": "substring(review_id, 1, 23)",
              "newline_id": "concat(review_id, '\\n')"}
    texts = {"unicode_blank_text": quoted("\xa0 \x1c\u3000"), "ascii_blank_text": "' \\t\\n'"}
    movies = {"tab_movie": "'\\t'", "null_movie": "NULL"}
    times = {"naive_time": wall, "offset_time": f"concat({wall}, '+03:30')"}
    return rows.selectExpr(
        f"{by_case('fault', ids_by, 'review_id')} AS _id",
        f"{by_case('fault', texts, 'text')} AS text",
        f"{by_case('fault', movies, 'movie_id')} AS movie_id",
        f"{by_case('fault', times, ids.format_utc('created_at'))} AS created_at",
        "doc_id",
    )


def topic_position(doc_id: str) -> list[str]:
    """Partition and offset of a record in a three-partition topic."""
    return [
        f"CAST({doc_id} % {TOPIC_PARTITIONS} AS INT) AS partition",
        f"{doc_id} DIV {TOPIC_PARTITIONS} AS offset",
    ]


def review_log_of(review_rows: DataFrame) -> DataFrame:
    """Review events as topic records, broken source by source (``EVENT_FAULTS``)."""
    sent_ids = {"upper_review_id": "upper(review_id)", "newline_review_id": "concat(review_id, '\\n')"}
    event_ids = {"foreign_event_id": quoted("review:" + "f" * 24)}
    emitted = {"naive_time": "'2026-01-01T00:00:00'", "offset_time": "'2026-01-01T03:00:00+03:00'"}
    body = (
        f"to_json(named_struct('event_id', {by_case('fault', event_ids, ids.event_id('review_id'))}, "
        f"'review_id', {by_case('fault', sent_ids, 'review_id')}, 'movie_id', movie_id, "
        f"'text', {by_case('fault', {'blank_text': quoted(chr(0xa0) + chr(0x3000))}, 'text')}, "
        f"'source_created_at', {ids.format_utc('created_at')}, "
        f"'emitted_at', {by_case('fault', emitted, quoted(EMITTED_AT))}))"
    )
    rows = with_fault(review_rows, EVENT_FAULTS).selectExpr("*", f"{body} AS body")
    pick = lambda values, other="''": by_case("fault", values, other)
    json = ", ".join([
        pick({"json_array": "'['"}),
        "'{\"schema_version\":'",
        pick({"version_text": "'\"1\"'", "version_two": "'2'", "version_decimal": "'1.0'"}, "'1'"),
        "','",
        pick({"unknown_field": "'\"extra\":true,'"}),
        pick({"cut_json": "''"}, "substring(body, 2)"),
        pick({"json_array": "']'", "trailing_text": "'x'"}),
    ])
    stray = pick({"bad_utf8": "unhex('FF')"}, "unhex('')")
    key = pick(
        {"other_key": f"CAST({ids.event_id('review_id')} AS BINARY)", "bad_utf8_key": "unhex('C328')",
         "null_key": "NULL"},
        "CAST(review_id AS BINARY)",
    )
    return rows.selectExpr(
        f"{key} AS key",
        f"CASE WHEN fault != 'null_value' THEN concat(CAST(concat({json}) AS BINARY), {stray}) END AS value",
        f"'{REVIEWS_TOPIC}' AS topic",
        *topic_position("doc_id"),
        f"{instant(EMITTED_AT)} AS timestamp",
        f"{events.HEADERS} AS headers",
    )


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_log_of(reviews(spark, sf_dir))


# The prediction of a scorer that always answers pos with .1 .1 .8.
CONSTANT_PREDICTION = (
    "named_struct('sentiment', 'pos', 'label_id', 2, 'confidence', 0.8D, "
    "'probabilities', named_struct('neg', 0.1D, 'neu', 0.1D, 'pos', 0.8D))"
)


def prediction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction events of all reviews under the constant scorer."""
    made = events.review_events(reviews(spark, sf_dir), instant(EMITTED_AT))
    scored = made.selectExpr("struct(*) AS event", f"{CONSTANT_PREDICTION} AS prediction")
    out = events.prediction_event("event", "prediction", MODEL_A, instant(PREDICTED_AT))
    return scored.selectExpr(f"{out} AS e").select("e.*")


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction events as topic records, broken source by source (``PREDICTION_FAULTS``)."""
    edits = {  # fault: text to replace in the JSON, replacement
        "label_mismatch": ('"sentiment":"pos"', '"sentiment":"neu"'),
        "sum_off": ('"neu":0.1', '"neu":0.100002'),
        "sum_within": ('"neu":0.1', '"neu":0.1000005'),
        "confidence_off": ('"confidence":0.8', '"confidence":0.7'),
        "label_text": ('"label_id":2', '"label_id":"2"'),
        "model_extra": ('"run_id":"run-a"', '"run_id":"run-a","uri":"x"'),
        "blank_run": ('"run_id":"run-a"', '"run_id":" "'),
        "other_prediction_id": ('"prediction_id":"', '"prediction_id":"00'),
        "naive_time": (PREDICTED_AT, PREDICTED_AT[:-1]),
        "probability_text": ('"neg":0.1', '"neg":"0.1"'),
        "probability_missing": ('"neg":0.1,', ""),
    }
    old, new = ({f: quoted(e[i]) for f, e in edits.items()} for i in (0, 1))
    rows = with_fault(prediction_events(spark, sf_dir), PREDICTION_FAULTS).selectExpr(
        "*", f"{events.prediction_event_json('')} AS json"
    )
    json = f"replace(json, {by_case('fault', old, quoted('none'))}, {by_case('fault', new, quoted('none'))})"
    return rows.selectExpr(
        f"CAST({by_case('fault', {'other_key': 'prediction_id'}, 'review_id')} AS BINARY) AS key",
        f"CASE WHEN fault != 'null_value' THEN CAST({json} AS BINARY) END AS value",
        f"'{PREDICTIONS_TOPIC}' AS topic",
        *topic_position("CAST(conv(review_id, 16, 10) AS BIGINT)"),
        f"{instant(PREDICTED_AT)} AS timestamp",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic is neg, else low quality is neu, else pos."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.selectExpr(
        "doc_id",
        f"{strip_text('text')} AS text",
        "CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 0 THEN 'neu' ELSE 'pos' END AS label",
        "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label_id",
    )


def _logits(spark: SparkSession, sf_dir: str, first: int, lift: float, order=(0, 1, 2)) -> DataFrame:
    dims = ", ".join(
        f"CAST(embedding[{first + i}] AS DOUBLE) * 16.0D + IF(label % 3 = {i}, {lift}D, 0.0D)" for i in order
    )
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS row_key", f"array({dims}) AS logits", "label % 3 AS label_id"
    )


def logits_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of the first model with their true labels."""
    return _logits(spark, sf_dir, 0, 3.0)


def logits_b(spark: SparkSession, sf_dir: str, external: bool = False) -> DataFrame:
    """Logits of the second model, optionally in its own class order."""
    return _logits(spark, sf_dir, 3, 1.5, (1, 2, 0) if external else (0, 1, 2))


def _model_history(spark, sf_dir, logits: DataFrame, model: ModelIdentity, delay: str) -> DataFrame:
    moments = table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_key", "CAST(ts AS TIMESTAMP) AS predicted_at"
    )
    rows = add_prediction(logits.drop("label_id"), CLASS_BIAS).join(moments, "row_key")
    rows = rows.selectExpr("*", f"{hex_id('row_key')} AS review_id")
    made = rows.selectExpr(
        "sentiment", "label_id", "confidence", "probabilities", "1 AS schema_version",
        f"{model.prediction_id(ids.event_id('review_id'))} AS prediction_id",
        f"{ids.event_id('review_id')} AS source_event_id",
        "review_id", "CAST(NULL AS STRING) AS movie_id", "CAST(NULL AS TIMESTAMP) AS source_created_at",
        f"{model.struct()} AS model", "predicted_at",
    )
    stored = f"timestamp_micros(unix_micros(predicted_at) + {delay} * 1000000L) AS stored_at"
    return events.history_rows(made).selectExpr("*", stored).select(*HISTORY_COLUMNS)


def history_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of model version 1."""
    return _model_history(spark, sf_dir, logits_a(spark, sf_dir), MODEL_A, "60")


def history_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions of version 2, earlier, at the same time or later by class."""
    return _model_history(spark, sf_dir, logits_b(spark, sf_dir), MODEL_B, "label_id * 60")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_a(spark, sf_dir).unionByName(history_b(spark, sf_dir))
