import json

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from reviewflow.functions.decision import DecisionConfig
from reviewflow.operators import history, scoring
from reviewflow.operators.events import ModelIdentity
from reviewflow.schema import DEAD_LETTER_TOPIC, PREDICTIONS_TOPIC, REVIEWS_TOPIC, TOPIC_RECORD
from reviewflow.sources import topics
from reviewflow.streaming import jobs

ONCE = {"availableNow": True}
MODEL = ModelIdentity("m", "1", "run")


def rid(i):
    return f"5e1f00d4c0ffee00ba5{i:05d}"


def append_reviews(spark, path, ids, poison=()):
    """Append one file of review records to the log; poison ids get broken payloads."""
    rows = []
    for i in ids:
        body = {"schema_version": 1, "event_id": "review:" + rid(i), "review_id": rid(i), "text": f"t{i}",
                "emitted_at": "2026-01-01T00:00:00Z"}
        value = b"{" if i in poison else json.dumps(body).encode()
        rows.append((rid(i).encode(), value, REVIEWS_TOPIC, 0, i, None, None))
    topics.write_topic_log(spark.createDataFrame(rows, TOPIC_RECORD).coalesce(1), path)


def udf():
    return scoring.scorer_udf("constant:1", lambda: scoring.ConstantScorer(np.log([0.1, 0.1, 0.8])))


def run_scoring(spark, tmp_path, **source):
    records = topics.stream_topic_log(spark, str(tmp_path / "reviews"), REVIEWS_TOPIC, **source)
    out = jobs.score(records, udf(), DecisionConfig(), MODEL)
    query = jobs.start_topic_sink(out, str(tmp_path / "out"), str(tmp_path / "check"), ONCE)
    query.awaitTermination()
    return query


def run_history(spark, tmp_path, checkpoint, strict=True):
    records = topics.stream_topic_log(spark, str(tmp_path / "out"), PREDICTIONS_TOPIC)
    jobs.start_history_sink(
        records, str(tmp_path / "history"), str(tmp_path / checkpoint), ONCE, strict
    ).awaitTermination()
    return history.read_history(spark, str(tmp_path / "history"))


def topic(spark, tmp_path, name):
    return topics.read_topic_log(spark, str(tmp_path / "out"), name)


def test_scoring_resumes_isolates_poison_and_persists_once(spark, tmp_path):
    append_reviews(spark, str(tmp_path / "reviews"), range(6), poison={2})
    run_scoring(spark, tmp_path)
    assert sorted(r.offset for r in topic(spark, tmp_path, PREDICTIONS_TOPIC).collect()) == [0, 1, 3, 4, 5]
    assert [r.offset for r in topic(spark, tmp_path, DEAD_LETTER_TOPIC).collect()] == [2]

    # A restart with the same checkpoint only reads what is new.
    append_reviews(spark, str(tmp_path / "reviews"), range(6, 10))
    run_scoring(spark, tmp_path)
    out = topic(spark, tmp_path, PREDICTIONS_TOPIC).collect()
    assert sorted(r.offset for r in out) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    moments = {json.loads(r.value)["predicted_at"] for r in out}
    assert len(moments) == 2  # one clock reading per batch

    stored = run_history(spark, tmp_path, "h1")
    assert stored.count() == 9
    first = {r.prediction_id: r.stored_at for r in stored.collect()}
    # A replay from the start, under a new checkpoint, stores nothing again.
    replayed = run_history(spark, tmp_path, "h2")
    assert {r.prediction_id: r.stored_at for r in replayed.collect()} == first
    assert history.latest_predictions(replayed).count() == 9


def test_batches_can_be_bounded(spark, tmp_path):
    for start in (0, 2, 4):
        append_reviews(spark, str(tmp_path / "reviews"), range(start, start + 2))
    query = run_scoring(spark, tmp_path, max_files=1)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    assert topic(spark, tmp_path, PREDICTIONS_TOPIC).count() == 6


def test_persistence_stops_at_an_invalid_prediction(spark, tmp_path):
    append_reviews(spark, str(tmp_path / "reviews"), range(2))
    run_scoring(spark, tmp_path)
    bad = spark.createDataFrame(
        [(b"k", b"{}", PREDICTIONS_TOPIC, 0, 9, None, None)], TOPIC_RECORD
    )
    topics.write_topic_log(bad, str(tmp_path / "more"))
    records = topics.stream_topic_log(spark, str(tmp_path / "more"), PREDICTIONS_TOPIC)
    query = jobs.start_history_sink(records, str(tmp_path / "history"), str(tmp_path / "c"), ONCE)
    with pytest.raises(StreamingQueryException, match="contract violated"):
        query.awaitTermination()
    assert history.read_history(spark, str(tmp_path / "history")).count() == 0
    jobs.start_history_sink(
        records, str(tmp_path / "history"), str(tmp_path / "c2"), ONCE, strict=False
    ).awaitTermination()
    assert history.read_history(spark, str(tmp_path / "history")).count() == 0
    assert run_history(spark, tmp_path, "c3").count() == 2


def test_publishing_stream(spark, tmp_path):
    schema = "review_id STRING, text STRING, movie_id STRING, created_at TIMESTAMP, extra STRING"
    reviews = spark.createDataFrame([(rid(1).upper(), "a", None, None, "x")], schema)
    reviews.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    records = jobs.publish(stream).selectExpr("*", "0 AS partition", "0L AS offset")
    jobs.start_topic_sink(records, str(tmp_path / "out"), str(tmp_path / "check"), ONCE).awaitTermination()
    (row,) = topics.read_topic_log(spark, str(tmp_path / "out"), REVIEWS_TOPIC).collect()
    assert bytes(row.key).decode() == rid(1)
    assert json.loads(row.value) | {"emitted_at": ""} == {
        "schema_version": 1, "event_id": "review:" + rid(1), "review_id": rid(1), "text": "a", "emitted_at": "",
    }


def test_idle_query_stops_on_request(spark, tmp_path):
    append_reviews(spark, str(tmp_path / "reviews"), range(1))
    records = topics.stream_topic_log(spark, str(tmp_path / "reviews"), REVIEWS_TOPIC)
    query = jobs.start_topic_sink(
        jobs.score(records, udf(), DecisionConfig(), MODEL), str(tmp_path / "out"), str(tmp_path / "check")
    )
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and topic(spark, tmp_path, PREDICTIONS_TOPIC).count() == 1


def test_replays_within_the_horizon_never_reach_the_table(spark, tmp_path, monkeypatch):
    append_reviews(spark, str(tmp_path / "reviews"), range(6))
    run_scoring(spark, tmp_path)
    first = topic(spark, tmp_path, PREDICTIONS_TOPIC).collect()
    log, seen = str(tmp_path / "log"), []
    whole = history.insert_if_absent

    def spy(spark, path, rows, *more):
        seen.append(rows.count())
        return whole(spark, path, rows, *more)

    monkeypatch.setattr(history, "insert_if_absent", spy)

    def run(table, horizon):
        seen.clear()
        records = topics.stream_topic_log(spark, log, PREDICTIONS_TOPIC, max_files=1)
        query = jobs.start_history_sink(
            records, str(tmp_path / table), str(tmp_path / f"{table}-check"), ONCE, horizon=horizon
        )
        query.awaitTermination()
        states = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        stored = history.read_history(spark, str(tmp_path / table))
        return sorted(r.review_id for r in stored.collect()), sum(seen), states

    for copy in range(3):
        rows = spark.createDataFrame([{**r.asDict(), "offset": r.offset + 100 * copy} for r in first], TOPIC_RECORD)
        topics.write_topic_log(rows.coalesce(1), log)
    ids = sorted(rid(i) for i in range(6))
    assert run("long", "1 hour")[:2] == (ids, 6)
    stored, asked, states = run("none", "0 seconds")
    # The state is bounded by the horizon; what it has forgotten is found in the table.
    assert stored == ids and asked >= 6 and max(states) <= 6 and states[-1] <= 6
