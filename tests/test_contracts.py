import base64
import json

import pytest
from pyspark.errors import PySparkException

from reviewflow.functions import ids
from reviewflow.operators import contracts, events, rules
from reviewflow.operators.events import ModelIdentity

RID = "5e1f00d4c0ffee00ba5eba11"
GOOD = {
    "schema_version": 1, "event_id": "review:" + RID, "review_id": RID, "text": "A quiet film, well told",
    "emitted_at": "2026-01-01T00:00:00Z",
}
TOPIC = "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT"


def record(changes=None, drop=(), key=RID, raw=None):
    body = {**GOOD, **(changes or {})}
    for name in drop:
        body.pop(name)
    value = json.dumps(body).encode() if raw is None else raw
    return (key.encode() if isinstance(key, str) else key, value)


def parse(spark, records, parser=contracts.parse_review_events):
    rows = [(k, v, "reviews.v1", 0, i) for i, (k, v) in enumerate(records)]
    return parser(spark.createDataFrame(rows, TOPIC)).orderBy("offset").collect()


VALID = {
    "plain": record(),
    "null optional": record({"movie_id": None, "source_created_at": None}),
    "version 1.0": record(raw=json.dumps(GOOD).replace('"schema_version": 1', '"schema_version": 1.0').encode()),
    "version true": record({"schema_version": True}),
    "offset time": record({"emitted_at": "2026-01-01T03:00:00+03:00"}),
    "minus offset without colon": record({"emitted_at": "2025-12-31T20:30:00-0330"}),
    "far offset": record({"emitted_at": "2026-01-01T23:59:00+23:59"}),
    "no seconds": record({"emitted_at": "2026-01-01 00:00z"}),
    "cut digits": record({"emitted_at": "2026-01-01T00:00:00.0000009Z"}),
    "digit string": record({"emitted_at": "1767225600"}),
    "milliseconds": record({"emitted_at": "1767225600000"}),
    "upper review id": record({"review_id": RID.upper()}),
    "repeated key": record(raw=json.dumps(GOOD).replace("{", '{"text": "", ', 1).encode()),
    "surrogate pair": record(raw=json.dumps({**GOOD, "text": chr(0x1F600)}).encode()),
    "escaped backslash before u": record({"text": chr(92) + "ud800"}),
    "surrounding space": record(raw=b" \n" + json.dumps(GOOD).encode() + b"\n"),
    "numeric id": record(
        {"event_id": "review:" + "1" * 24, "review_id": int("1" * 24)}, key="1" * 24
    ),
}

CONTRACT = {
    "not json": (record(raw=b"not json"), "json_object"),
    "empty": (record(raw=b""), "json_object"),
    "array": (record(raw=b"[1]"), "json_object"),
    "invalid utf-8": (record(raw=json.dumps(GOOD).encode().replace(b"quiet", b"\xff")), "json_object"),
    "trailing text": (record(raw=json.dumps(GOOD).encode() + b"x"), "json_object"),
    "two values": (record(raw=json.dumps(GOOD).encode() * 2), "json_object"),
    "two list items": (record(raw=json.dumps(GOOD).encode() + b"," + json.dumps(GOOD).encode()), "json_object"),
    "closed list": (record(raw=json.dumps(GOOD).encode() + b"] ["), "json_object"),
    "high surrogate": (record({"text": "a" + chr(0xD800)}), "json_object"),
    "low surrogate": (record({"text": chr(92) + chr(0xDC00)}), "json_object"),
    "swapped surrogates": (record({"text": chr(0xDE00) + chr(0xD83D)}), "json_object"),
    "year zero": (record({"emitted_at": "0000-01-01T00:00:00Z"}), "emitted_at"),
    "version text": (record({"schema_version": "1"}), "schema_version"),
    "version two": (record({"schema_version": 2}), "schema_version"),
    "version false": (record({"schema_version": False}), "schema_version"),
    "version missing": (record(drop=["schema_version"]), "schema_version"),
    "unknown field": (record({"extra": 1}), "unknown_field"),
    "text number": (record({"text": 5}), "text"),
    "text null": (record({"text": None}), "text"),
    "text missing": (record(drop=["text"]), "text"),
    "blank movie": (record({"movie_id": "\t"}), "movie_id"),
    "movie number": (record({"movie_id": 7}), "movie_id"),
    "other event id": (record({"event_id": "review:" + "f" * 24}), "event_id_matches"),
    "upper event id": (record({"event_id": "review:" + RID.upper()}), "event_id"),
    "id and newline": (record({"review_id": RID + "\n"}), "review_id"),
    "short id": (record({"review_id": RID[:-1]}), "review_id"),
    "naive time": (record({"emitted_at": "2026-01-01T00:00:00"}), "emitted_at"),
    "date only": (record({"emitted_at": "2026-01-01"}), "emitted_at"),
    "time number": (record({"emitted_at": 1767225600}), "emitted_at"),
    "hour 24": (record({"emitted_at": "2026-01-01T24:00:00Z"}), "emitted_at"),
    "offset 24": (record({"emitted_at": "2026-01-01T00:00:00+24:00"}), "emitted_at"),
    "spaced offset": (record({"emitted_at": "2026-01-01T00:00:00 +03:00"}), "emitted_at"),
    "naive source time": (record({"source_created_at": "2026-01-01T00:00:00"}), "source_created_at"),
    **{
        f"blank text U+{ord(ch):04X}": (record({"text": ch}), "text")
        for ch in " \t\x0b\x1c\x1f\x85\xa0 \u3000"
    },
}


def test_valid_events(spark):
    rows = parse(spark, VALID.values())
    assert {n: r.violations for n, r in zip(VALID, rows) if r.error_type} == {}
    for name, row in zip(VALID, rows):
        assert row.event.emitted_at.isoformat().startswith("2026-01-01T00:00:00"), name
        assert row.event.review_id == row.event.review_id.lower()


def test_broken_contracts(spark):
    rows = parse(spark, [r for r, _ in CONTRACT.values()])
    found = {n: (r.error_type, ",".join(r.violations)) for n, r in zip(CONTRACT, rows)}
    # A broken review id leaves nothing to compare the event id with.
    assert found == {n: ("ValidationError", want) for n, (_, want) in CONTRACT.items()}
    assert all(r.event is None for r in rows)


def test_error_precedence_and_dead_letters(spark):
    long = record({"text": "x" * 200}, key=None)
    records = [
        (RID.encode(), None), (b"\xc3\x28", b"oops"), record(key=b"\xc3\x28"), record(key="other"), long,
        record(key=""),
    ]
    rows = [(k, v, "reviews.v1", 1, i) for i, (k, v) in enumerate(records)]
    parsed = contracts.parse_review_events(spark.createDataFrame(rows, TOPIC))
    letters = events.dead_letters(parsed, "to_timestamp('2026-01-01T00:00:00Z')").orderBy("source_offset").collect()
    assert [x.error_type for x in letters] == [
        "ValueError", "ValidationError", "UnicodeDecodeError", "ValueError", "ValueError", "ValueError",
    ]
    assert letters[0].payload_base64 == "" and letters[4].key_base64 is None and letters[5].key_base64 is None
    assert base64.b64decode(letters[1].key_base64) == b"\xc3\x28"
    assert letters[4].payload_base64 == base64.b64encode(long[1]).decode()
    assert {(x.worker, x.source_topic, x.source_partition) for x in letters} == {
        ("sentiment-inference", "reviews.v1", 1)
    }


def test_upper_case_key_is_a_mismatch(spark):
    rows = parse(spark, [record({"review_id": RID.upper()}, key=RID), record({"review_id": RID.upper()}, key=RID.upper())])
    assert [r.error_type for r in rows] == [None, "ValueError"]


def test_split_conserves_rows(spark):
    records = [*VALID.values(), *[r for r, _ in CONTRACT.values()]]
    rows = [(k, v, "t", 0, i) for i, (k, v) in enumerate(records)]
    parsed = contracts.parse_review_events(spark.createDataFrame(rows, TOPIC))
    valid, broken = rules.split_valid(parsed)
    assert (valid.count(), broken.count()) == (len(VALID), len(CONTRACT))


def test_the_payload_is_parsed_once_under_a_filter(spark):
    df = spark.createDataFrame([(b"k", b"{}", "t", 0, 0)], TOPIC)
    rejected = contracts.parse_review_events(df).where("error_type IS NOT NULL")
    plan = rejected._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


MODEL = ModelIdentity("integration-model", "1", "run")


def prediction(**changes):
    event = "review:" + RID
    body = {
        "sentiment": "pos", "label_id": 2, "confidence": 0.8,
        "probabilities": {"neg": 0.1, "neu": 0.1, "pos": 0.8}, "schema_version": 1,
        "prediction_id": None, "source_event_id": event, "review_id": RID,
        "model": {"name": "integration-model", "version": "1", "run_id": "run"},
        "predicted_at": "2026-01-01T00:00:00Z",
    }
    import hashlib

    body["prediction_id"] = hashlib.sha256(f"{event}\0integration-model\x001".encode()).hexdigest()
    body.update(changes)
    return (RID.encode(), json.dumps(body).encode())


PREDICTIONS = [
    ({}, None),
    ({"probabilities": {"neg": 0.1, "neu": 0.1000005, "pos": 0.8}}, None),
    ({"probabilities": {"neg": 0.1, "neu": 0.100002, "pos": 0.8}}, "probability_sum"),
    ({"probabilities": {"neg": 0, "neu": 0, "pos": 1}, "confidence": 1}, None),
    ({"confidence": 0.7}, "confidence_matches"),
    ({"confidence": True}, "confidence"),
    ({"sentiment": "neu"}, "label_mapping,confidence_matches"),
    ({"label_id": 2.0}, None),
    ({"label_id": "2"}, "label_id"),
    ({"label_id": 3}, "label_id"),
    ({"model": {"name": "integration-model", "version": "1"}}, None),
    ({"model": {"name": "integration-model", "version": "1", "uri": "x"}}, "unknown_model_field"),
    ({"model": {"name": " ", "version": "1"}}, "model_name,prediction_id_matches"),
    ({"model": 3}, "model_name,model_version"),
    ({"prediction_id": "0" * 64}, "prediction_id_matches"),
    ({"prediction_id": "0" * 63}, "prediction_id"),
    ({"source_event_id": "review:" + "f" * 24}, "source_event_id_matches,prediction_id_matches"),
    ({"probabilities": {"neg": 0.1, "neu": 0.1, "pos": 0.8, "x": 0}}, "unknown_probability"),
    ({"probabilities": {"neg": 0.1, "neu": 0.1, "pos": "0.8"}}, "probabilities"),
    ({"extra": 1}, "unknown_field"),
]


def test_prediction_events(spark):
    rows = parse(spark, [prediction(**c) for c, _ in PREDICTIONS], contracts.parse_prediction_events)
    assert [",".join(r.violations) or None for r in rows] == [want for _, want in PREDICTIONS]
    assert [r.error_type for r in rows] == ["ValidationError" if want else None for _, want in PREDICTIONS]


def test_fail_fast_mode(spark):
    good = "5e1f00d4c0ffee00ba5eba11"
    df = spark.createDataFrame([(good, "a", None, None), ("bad", "b", None, None)],
                               "review_id STRING, text STRING, movie_id STRING, created_at TIMESTAMP")
    checked = contracts.validate_reviews(df)
    assert rules.require_valid(checked.where(f"review_id = '{good}'")).count() == 1
    with pytest.raises(PySparkException, match="contract violated: review_id"):
        rules.require_valid(checked).collect()


def test_store_check_is_looser_than_the_contract(spark):
    df = spark.createDataFrame([(RID, "\xa0", None, None), (RID, "\t", None, None)],
                               "_id STRING, text STRING, movie_id STRING, created_at TIMESTAMP")
    store = [r[0] for r in df.selectExpr(contracts.review_store_violations()).collect()]
    assert store == [[], ["text"]]
    assert [r.violations for r in contracts.validate_reviews(df, "_id").collect()] == [["text"], ["text"]]


def test_storage_checks_treat_unknown_as_passed(spark):
    columns = "prediction_id, schema_version, source_event_id, review_id, movie_id, sentiment, label_id, confidence, probability_neg, probability_neu, probability_pos, model_name, model_version, model_run_id, predicted_at"
    base = {
        "prediction_id": f"'{'a' * 64}'", "schema_version": "1", "source_event_id": f"'review:{RID}'",
        "review_id": f"'{RID}'", "movie_id": "CAST(NULL AS STRING)", "sentiment": "'pos'", "label_id": "2",
        "confidence": "0.8D", "probability_neg": "0.1D", "probability_neu": "0.1D", "probability_pos": "0.8D",
        "model_name": "'m'", "model_version": "'1'", "model_run_id": "CAST(NULL AS STRING)",
        "predicted_at": "now()",
    }

    def check(**changes):
        row = {**base, **changes}
        df = spark.range(1).selectExpr(*[f"{row[c.strip()]} AS {c.strip()}" for c in columns.split(",")])
        return contracts.check_constraints(df).first().violations

    assert check() == []
    assert check(movie_id="'\\t'") == []
    assert check(movie_id="'  '") == ["movie_id_non_blank"]
    assert check(model_run_id="''") == ["model_run_id_non_blank"]
    assert check(prediction_id=f"'{'a' * 64}\\n'") == ["prediction_id_sha256"]
    assert check(confidence="double('NaN')") == ["confidence_range", "confidence_matches_label"]
    assert check(sentiment="CAST(NULL AS STRING)") == ["sentiment_not_null"]
    assert check(label_id="0") == ["label_mapping", "confidence_matches_label"]


def test_utc_text_round_trip(spark):
    df = spark.sql("SELECT timestamp'2026-01-01 00:00:00.000120' a, timestamp'2026-01-01 00:00:00' b")
    row = df.selectExpr(f"{ids.format_utc('a')} AS a", f"{ids.format_utc('b')} AS b").first()
    assert (row.a, row.b) == ("2026-01-01T00:00:00.000120Z", "2026-01-01T00:00:00Z")


def test_parsed_records_have_the_declared_types(spark):
    from reviewflow import schema

    declared = lambda ddl: spark.createDataFrame([], ddl).schema.simpleString()
    log = spark.createDataFrame([], TOPIC)
    reviews = contracts.parse_review_events(log)
    assert reviews.select("event.*").schema.simpleString() == declared(schema.REVIEW_EVENT)
    predictions = contracts.parse_prediction_events(log).select("event.*")
    assert predictions.schema.simpleString() == declared(schema.PREDICTION_EVENT)
    stored = events.history_rows(predictions).selectExpr("*", "now() AS stored_at")
    assert stored.schema.simpleString() == declared(schema.HISTORY)
    letters = events.dead_letters(reviews, "now()")
    assert letters.schema.simpleString() == declared(schema.DEAD_LETTER)
    checked = contracts.validate_reviews(spark.createDataFrame([], schema.REVIEW)).drop("violations")
    assert checked.schema.simpleString() == declared(schema.REVIEW)
    assert reviews.count() == predictions.count() == letters.count() == 0
