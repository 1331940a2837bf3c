import json

import numpy as np
import pytest
from pyspark.errors import PySparkException

from reviewflow.functions.decision import DecisionConfig
from reviewflow.operators import classifier, contracts, corpus, events, scoring
from reviewflow.operators.events import ModelIdentity
from reviewflow.sources import files, topics

SCHEMA = "doc_id BIGINT, text STRING"


@pytest.fixture()
def folders(tmp_path):
    for label, name, raw in (
        ("neg", "a.txt", b"  bad\r\nfilm \n"), ("neg", "b.txt", b"\xff broken"), ("neu", "a.txt", b"NA"),
        ("pos", "c.txt", "　хорошо ".encode()), ("pos", "note.md", b"ignored"), ("other", "d.txt", b"x"),
    ):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(raw)
    return str(tmp_path)


def test_class_folders(spark, folders, tmp_path):
    rows = {(r.label, r.label_id, r.text) for r in files.read_class_folders(spark, folders).collect()}
    assert rows == {
        ("neg", 0, "bad\nfilm"), ("neg", 0, "� broken"), ("neu", 1, "NA"), ("pos", 2, "хорошо"),
    }
    with pytest.raises(FileNotFoundError):
        files.read_class_folders(spark, str(tmp_path / "other"))
    (tmp_path / "empty" / "pos").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        files.read_class_folders(spark, str(tmp_path / "empty"))


def test_snapshot_is_built_once_and_keeps_text(spark, folders, tmp_path):
    path, calls = str(tmp_path / "snap"), []

    def build():
        calls.append(1)
        return files.read_class_folders(spark, folders)

    first = files.snapshot(spark, path, build)
    assert "NA" in {r.text for r in files.snapshot(spark, path, build).collect()}
    assert len(calls) == 1 and first.count() == 4
    files.write_snapshot(first.select("text", "label"), str(tmp_path / "csv"), "csv")
    back = files.read_csv(spark, str(tmp_path / "csv"), "text STRING, label STRING")
    assert {(r.text, r.label) for r in back.collect()} == {(r.text, r.label) for r in first.collect()}


def test_first_usable_text_and_preview(spark, tmp_path):
    (tmp_path / "in.csv").write_text('text\n" "\n"first, ""quoted""\nline"\nsecond\n')
    df = files.read_csv(spark, str(tmp_path / "in.csv"))
    assert files.first_usable(df, "monotonically_increasing_id()").first().text == 'first, "quoted"\nline'
    assert files.preview(df, 2).count() == 2


def test_decision_config_and_report(spark, tmp_path):
    path = tmp_path / "config.json"
    good = {"temperature": 1.47, "strategy": "class_bias", "params": {"bias": [-1.5, -0.25, 0.0]}, "val_macro_f1": 0.7}
    path.write_text(json.dumps(good, indent=2))
    assert files.read_decision_config(spark, str(path)) == DecisionConfig(1.47, "class_bias", bias=(-1.5, -0.25, 0.0))
    for bad in ({"strategy": "argmax"}, {**good, "temperature": 0}, {**good, "strategy": "x"}, [good, good], 3):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.read_decision_config(spark, str(path))
    out = tmp_path / "report"
    files.write_report(spark.sql("SELECT 1 AS a, named_struct('b', array(0.5D)) AS c"), str(out))
    (part,) = out.glob("part-*.json")
    assert json.loads(part.read_text()) == {"a": 1, "c": {"b": [0.5]}}


class Recorder:
    """Logits are the text length; remembers nothing between workers."""

    def __init__(self, width=3, limit=4):
        self.width, self.limit = width, limit

    def logits(self, texts):
        assert 0 < len(texts) <= self.limit
        return np.array([[len(t)] * self.width for t in texts], dtype=float)


def test_batches_keep_input_order():
    texts = ["aaa", "b", "cc", "dddd", "e"]
    assert scoring.score_texts(Recorder(limit=2), texts, 2)[:, 0].tolist() == [3, 1, 2, 4, 1]
    with pytest.raises(RuntimeError, match="shape"):
        scoring.score_texts(Recorder(width=2), texts, 2)


def test_scoring_udf(spark):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(40)], SCHEMA)
    udf = scoring.scorer_udf("cue-test:1", lambda: scoring.CueScorer(("x", "y", "z"), 2.0), 4)
    rows = scoring.predict(df, udf, DecisionConfig()).collect()
    assert len(rows) == 40 and all(r.logits == [2.0, 0.0, 0.0] and r.sentiment == "neg" for r in rows)
    assert scoring.predict(df.where("false"), udf, DecisionConfig()).count() == 0
    blank = spark.createDataFrame([(1, "\xa0")], SCHEMA)
    with pytest.raises(PySparkException, match="non-blank"):
        scoring.predict(blank, udf, DecisionConfig()).collect()
    with pytest.raises(ValueError):
        scoring.scorer_udf("m", scoring.ConstantScorer, 0)


def test_rejected_records_are_not_scored(spark):
    rid = "5e1f00d4c0ffee00ba5eba11"
    good = json.dumps({"schema_version": 1, "event_id": "review:" + rid, "review_id": rid, "text": "ok",
                       "emitted_at": "2026-01-01T00:00:00Z"}).encode()
    rows = [(rid.encode(), good, "reviews.v1", 0, 0), (rid.encode(), None, "reviews.v1", 0, 1)]
    log = spark.createDataFrame(rows, "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT")
    constant = scoring.scorer_udf("constant:1", lambda: scoring.ConstantScorer(np.log([0.1, 0.1, 0.8])))
    parsed = scoring.predict_events(contracts.parse_review_events(log), constant, DecisionConfig())
    out = events.route(parsed, ModelIdentity("m", "1"), "timestamp_seconds(0)").orderBy("offset").collect()
    assert [r.topic for r in out] == ["predictions.v1", "reviews.dlq.v1"]
    event = json.loads(out[0].value)
    assert event["sentiment"] == "pos" and event["confidence"] == pytest.approx(0.8)
    assert event["model"] == {"name": "m", "version": "1"} and "movie_id" not in event
    assert event["predicted_at"] == "1970-01-01T00:00:00Z"
    assert [(h.key, bytes(h.value)) for h in out[0].headers] == [
        ("content-type", b"application/json"), ("schema-version", b"1"),
    ]
    with pytest.raises(ValueError):
        ModelIdentity(" ", "1")


def test_classifier_learns_and_gives_three_logits(spark):
    words = ("awful", "plain", "great")
    rows = [(i, f"{words[i % 3]} film number {i}", words[i % 3], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label STRING, label_id INT")
    split = corpus.stratified_split(df, "doc_id").persist()
    part = lambda n: split.where(f"split = '{n}'")
    model = classifier.train(part("train"), part("val"), (0.01,), 1 << 10, 10)
    scored = classifier.add_logits(model, part("test")).collect()
    assert scored and all(len(r.logits) == 3 and int(np.argmax(r.logits)) == r.label_id for r in scored)
    split.unpersist()


def test_connector_options():
    options = topics.kafka_source_options("h:1", "reviews.v1", "latest", max_per_trigger=16)
    assert options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "16"
    assert options["kafka.isolation.level"] == "read_committed" and options["failOnDataLoss"] == "true"
    with pytest.raises(RuntimeError):
        topics.kafka_source_options("h:1", "t", "error")
    assert topics.kafka_source_options("h:1", "t", "error", resuming=True)["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        topics.kafka_source_options("h:1", "t", "now")
    sink = topics.kafka_sink_options("h:1")
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true"
    assert topics.jdbc_options("jdbc:x", "t", batchsize="100")["batchsize"] == "100"
