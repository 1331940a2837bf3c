"""The registered queries: each runs an operator over whole given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.functions import decision, ids
from reviewflow.functions.text import head_tail, token_count, tokens
from reviewflow.operators import (
    calibrate,
    contracts,
    corpus,
    ensemble,
    events,
    history,
    ingest,
    metrics,
    rules,
    scoring,
)
from reviewflow.plans import views
from reviewflow.schema import (
    DEAD_LETTER_TOPIC,
    LABELS,
    PREDICTIONS_TOPIC,
    REVIEWS_TOPIC,
    SHORT_HEAD_TOKENS,
    SHORT_MAX_LENGTH,
    SHORT_TAIL_TOKENS,
)
from reviewflow.session import stored, work_folder
from reviewflow.sources import files, topics
from reviewflow.streaming import jobs

CUES, CUE_SCALE = ("e", "a", "n"), 16.0
SECOND_CUES = ("o", "t", "i")  # in the second scorer's class order
CURSOR = "0" * 21 + "064"  # the id of document 100
LOOKUP_ROW = 7
TEMPERATURES = [0.5, 1.0, 1.3, 2.0]
CLASS_LOSS_WEIGHTS = {0: 2.0, 1: 1.5, 2: 0.5}


def r9(x: str, name: str | None = None) -> str:
    """Rounded to nine decimals, under its own or the given name."""
    return f"round({x}, 9) AS {name or x}"


def stamp(name: str, source: str = "") -> str:
    return f"{ids.format_utc(source + name)} AS {name}"


JOINED = "array_join(violations, ',') AS violations"


def cue_udf():
    return scoring.scorer_udf("cue:1", lambda: scoring.CueScorer(CUES, CUE_SCALE))


# --------------------------------------------------------------------------- decisions
def softmax_probs(spark, sf):
    rows = decision.with_scores(views.logits_a(spark, sf), "logits", views.TEMPERATURE)
    return decision.with_softmax(rows).selectExpr(
        "row_key", *[r9(x, f"p_{n}") for x, n in zip(decision.names("_p"), LABELS)]
    )


def _decided(config):
    def query(spark, sf):
        return decision.add_prediction(views.logits_a(spark, sf).drop("label_id"), config).selectExpr(
            "row_key", "label_id", "sentiment", r9("confidence")
        )

    return query


def prediction_id(spark, sf):
    docs = views.table(spark, sf, "documents").selectExpr(f"{views.hex_id('doc_id')} AS review_id")
    event = ids.event_id("review_id")
    return docs.selectExpr(
        "review_id", f"{event} AS event_id", f"{views.MODEL_A.prediction_id(event)} AS prediction_id"
    )


# --------------------------------------------------------------------------- events
def review_events(spark, sf):
    made = events.review_events(views.reviews(spark, sf), views.instant(views.EMITTED_AT))
    return made.selectExpr(
        "schema_version", "event_id", "review_id", "movie_id", "md5(text) AS text_md5",
        stamp("source_created_at"), stamp("emitted_at"),
    )


def prediction_events(spark, sf):
    return views.prediction_events(spark, sf).selectExpr(
        "sentiment", "label_id", "confidence", *[f"probabilities.{n} AS p_{n}" for n in LABELS],
        "schema_version", "prediction_id", "source_event_id", "review_id", "movie_id",
        stamp("source_created_at"), "model.name AS model_name", "model.version AS model_version",
        "model.run_id AS model_run_id", stamp("predicted_at"),
    )


def _flat_history(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "prediction_id", "schema_version", "source_event_id", "review_id", "movie_id",
        stamp("source_created_at"), "sentiment", "label_id", r9("confidence"),
        *[r9(f"probability_{n}") for n in LABELS], "model_name", "model_version", "model_run_id",
        stamp("predicted_at"), stamp("stored_at"),
    )


def history_rows(spark, sf):
    return _flat_history(views.history(spark, sf))


def latest_prediction(spark, sf):
    return _flat_history(history.latest_predictions(views.history(spark, sf)))


def sentiment_summary(spark, sf):
    """Flagship: decide, store and keep the latest prediction of each review, then summarise."""
    latest = history.latest_predictions(views.history(spark, sf))
    return latest.groupBy("sentiment").agg(
        F.count("*").alias("reviews"), F.expr(r9("avg(confidence)", "mean_confidence"))
    )


def event_envelope(spark, sf):
    made = events.review_events(views.reviews(spark, sf), views.instant(views.EMITTED_AT))
    return events.review_records(made).selectExpr(
        "CAST(key AS STRING) AS key", "md5(value) AS value_md5", "topic",
        "headers[0].key AS header_1", "CAST(headers[0].value AS STRING) AS header_1_value",
        "headers[1].key AS header_2", "CAST(headers[1].value AS STRING) AS header_2_value",
    )


def route_by_topic(spark, sf):
    parsed = contracts.parse_review_events(views.review_log(spark, sf))
    scored = parsed.selectExpr("*", f"{views.CONSTANT_PREDICTION} AS prediction")
    out = events.route(scored, views.MODEL_A, views.instant(views.PREDICTED_AT))
    return out.selectExpr(
        "topic", "partition", "offset", f"{ids.plain_base64('key')} AS key_base64", "md5(value) AS value_md5"
    )


def dead_letters(spark, sf):
    parsed = contracts.parse_review_events(views.review_log(spark, sf))
    return events.dead_letters(parsed, views.instant(views.PREDICTED_AT)).selectExpr(
        "schema_version", "worker", "source_topic", "source_partition", "source_offset", "key_base64",
        "md5(payload_base64) AS payload_md5", "error_type", "error_message", stamp("failed_at"),
    )


# --------------------------------------------------------------------------- contracts
def validate_review(spark, sf):
    checked = contracts.validate_reviews(views.raw_documents(spark, sf), "_id")
    return checked.selectExpr("review_id", "md5(text) AS text_md5", "movie_id", stamp("created_at"), JOINED)


def validate_store_document(spark, sf):
    docs = views.raw_documents(spark, sf)
    return docs.selectExpr("doc_id", f"array_join({contracts.review_store_violations()}, ',') AS violations")


def validate_event(spark, sf):
    parsed = contracts.parse_review_events(views.review_log(spark, sf))
    return parsed.selectExpr(
        "partition", "offset", "error_type", JOINED, "event.event_id", "event.review_id", "event.movie_id",
        "md5(event.text) AS text_md5", stamp("source_created_at", "event."), stamp("emitted_at", "event."),
    )


def validate_prediction(spark, sf):
    """Predictions broken by embedding label: sums, ranges, mapping, confidence."""
    groups = views.table(spark, sf, "embeddings").selectExpr("vec_id AS row_key", "label AS fault")
    good = decision.add_prediction(views.logits_a(spark, sf).drop("label_id"), views.ARGMAX)
    neg = (
        "CASE fault WHEN 1 THEN probabilities.neg + 2e-6D WHEN 2 THEN probabilities.neg + 5e-7D "
        "WHEN 4 THEN double('NaN') WHEN 7 THEN -0.25D ELSE probabilities.neg END"
    )
    rows = good.join(groups, "row_key").selectExpr(
        "row_key", "fault", "sentiment", "label_id",
        f"named_struct('neg', {neg}, 'neu', probabilities.neu, 'pos', probabilities.pos) AS probabilities",
    )
    rows = rows.selectExpr(
        "row_key",
        "CASE WHEN fault = 6 THEN 'bad' WHEN fault = 0 THEN IF(sentiment = 'pos', 'neg', 'pos') "
        "ELSE sentiment END AS sentiment",
        "IF(fault = 5, 3, label_id) AS label_id",
        f"{decision.chosen_probability('probabilities', 'label_id')} / IF(fault = 3, 2, 1) AS confidence",
        "probabilities",
    )
    return contracts.validate_predictions(rows).selectExpr("row_key", JOINED)


def validate_prediction_event(spark, sf):
    parsed = contracts.parse_prediction_events(views.prediction_log(spark, sf))
    return parsed.selectExpr(
        "partition", "offset", "error_type", JOINED, "event.prediction_id", "event.label_id",
        "event.probabilities.neu AS p_neu", "event.model.run_id", stamp("predicted_at", "event."),
    )


def check_constraints(spark, sf):
    """History rows broken by class and version, against the storage checks."""
    fault = "concat(model_version, '/', label_id)"
    broken = views.history(spark, sf).selectExpr(
        "prediction_id", "source_event_id", "review_id", "sentiment", "label_id", "probability_neg",
        "probability_neu", "probability_pos", "model_name", "model_version", "predicted_at",
        f"CASE {fault} WHEN '1/0' THEN ' ' WHEN '1/1' THEN '\\t' ELSE movie_id END AS movie_id",
        f"CASE {fault} WHEN '2/0' THEN 1.5D WHEN '2/1' THEN confidence / 2 ELSE confidence END AS confidence",
        f"CASE {fault} WHEN '1/2' THEN '  ' ELSE model_run_id END AS model_run_id",
        f"CAST(IF({fault} = '2/2', 2, 1) AS SMALLINT) AS schema_version",
    )
    return contracts.check_constraints(broken).selectExpr("prediction_id", JOINED)


def uniqueness_violations(spark, sf):
    """Version 1 stored twice, version 2 once more under other ids."""
    one, two = views.history_a(spark, sf), views.history_b(spark, sf)
    again = two.withColumn("prediction_id", F.expr("sha2(concat('x', prediction_id), 256)"))
    return history.uniqueness_violations(one.unionByName(one).unionByName(two).unionByName(again))


def quarantine_split(spark, sf):
    """Valid and quarantined records add up to the input, by source partition; parsed once."""
    parsed = contracts.parse_review_events(views.review_log(spark, sf)).selectExpr(
        "partition", "IF(error_type IS NULL, array(), array(error_type)) AS violations"
    )
    return rules.with_side(parsed).groupBy("partition", "side").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- corpus
def clean_corpus(spark, sf):
    kept = corpus.clean(views.corpus(spark, sf))
    return kept.selectExpr("doc_id", "md5(text) AS text_md5", "label", "label_id")


def clean_report(spark, sf):
    return corpus.clean_report(views.corpus(spark, sf))


def class_counts(spark, sf):
    return corpus.class_counts(views.corpus(spark, sf))


def _split_corpus(spark, sf):
    return corpus.stratified_split(views.corpus(spark, sf).select("doc_id", "label", "label_id"), "doc_id")


def stratified_split(spark, sf):
    return _split_corpus(spark, sf).select("doc_id", "label_id", "split")


def class_shares(spark, sf):
    return corpus.class_shares(_split_corpus(spark, sf))


def class_weights(spark, sf):
    return corpus.class_weights(views.corpus(spark, sf)).selectExpr("label_id", "n", r9("weight"))


def length_profile(spark, sf):
    docs = views.table(spark, sf, "documents")
    profile = corpus.length_profile(docs.selectExpr(f"{token_count(tokens('text'))} AS n_tokens"))
    rounded = [f"round({c}, 6) AS {c}" for c in ("mean", "std", "p50", "p75", "p90", "p95", "p99")]
    return profile.selectExpr("n", *rounded, "min", "max", "share_over_512", "share_over_256")


def head_tail_tokens(spark, sf):
    toks = views.table(spark, sf, "documents").selectExpr("doc_id", f"{tokens('text')} AS t")
    short = head_tail("t", SHORT_MAX_LENGTH, SHORT_HEAD_TOKENS, SHORT_TAIL_TOKENS)
    cut = toks.selectExpr("doc_id", "size(t) AS n", f"{head_tail('t')} AS long", f"{short} AS short")
    return cut.selectExpr(
        "doc_id", "n", "size(long) AS n_long", "md5(array_join(long, ' ')) AS long_md5",
        "size(short) AS n_short", "md5(array_join(short, ' ')) AS short_md5",
    )


# --------------------------------------------------------------------------- evaluation
def _predicted(spark, sf, config=views.CLASS_BIAS):
    return decision.with_decision(views.logits_a(spark, sf), config)


def confusion(spark, sf):
    return metrics.confusion(_predicted(spark, sf))


def per_class_report(spark, sf):
    report = metrics.per_class_report(_predicted(spark, sf))
    return report.selectExpr("class", r9("precision"), r9("recall"), r9("f1"), "support")


def eval_metrics(spark, sf):
    m = metrics.eval_metrics(_predicted(spark, sf))
    return m.selectExpr(*[r9(c) for c in m.columns])


def weighted_ce(spark, sf):
    loss = calibrate.with_nll(views.logits_a(spark, sf))
    return loss.agg(metrics.weighted_cross_entropy(CLASS_LOSS_WEIGHTS).alias("ce")).selectExpr(
        r9("ce", "weighted_ce")
    )


def nll_by_temperature(spark, sf):
    found = calibrate.nll_by_temperature(views.logits_a(spark, sf), TEMPERATURES)
    return found.selectExpr("temperature", r9("nll"))


def temperature_fit(spark, sf):
    rows = views.logits_a(spark, sf)
    found = calibrate.nll_by_temperature(rows, [calibrate.fit_temperature(rows)])
    return found.selectExpr("round(temperature, 6) AS temperature", r9("nll"))


def grid_class_bias(spark, sf):
    found = calibrate.grid_class_bias(views.logits_a(spark, sf), views.TEMPERATURE)
    return found.selectExpr("grid_idx", "bias_neg", "bias_neu", r9("macro_f1"))


def grid_thresholds(spark, sf):
    found = calibrate.grid_thresholds(views.logits_a(spark, sf), views.TEMPERATURE)
    return found.selectExpr("grid_idx", *[r9(c) for c in found.columns[1:]])


def _split_logits(logits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validation and test rows; written once, as every search reads them again."""
    keyed = stored(corpus.stratified_split(logits, "row_key").where("split != 'train'"), "split", "split")
    return keyed.where("split = 'val'").drop("split"), keyed.where("split = 'test'").drop("split")


def strategy_compare(spark, sf):
    val, _ = _split_logits(views.logits_a(spark, sf))
    return calibrate.compare_strategies(val, views.TEMPERATURE).selectExpr(
        "place", "strategy", *[r9(f"bias[{i}]", f"bias_{LABELS[i]}") for i in range(2)],
        *[r9(f"thresholds[{i}]", f"threshold_{n}") for i, n in enumerate(LABELS)], r9("macro_f1"),
    )


def strategy_select(spark, sf):
    val, _ = _split_logits(views.logits_a(spark, sf))
    best = calibrate.select_strategy(calibrate.compare_strategies(val, views.TEMPERATURE))
    return best.selectExpr("place", "strategy", r9("macro_f1"))


def heldout_gain(spark, sf):
    keyed = corpus.stratified_split(views.logits_a(spark, sf), "row_key")
    gain = calibrate.heldout_gain(keyed.where("split = 'test'"), views.CLASS_BIAS)
    return gain.selectExpr(*[r9(c) for c in gain.columns])


def calibration_report(spark, sf):
    """Temperature and strategy chosen on validation rows, evaluated once on test rows."""
    val, test = _split_logits(views.logits_a(spark, sf))
    _, report = calibrate.calibrate(val, test)
    return report.selectExpr(
        "round(temperature, 6) AS temperature", "strategy", r9("val_macro_f1"), r9("test_macro_f1"),
        r9("baseline_test_macro_f1"), r9("gain"),
    )


# --------------------------------------------------------------------------- ensemble
def _permutation() -> list[int]:
    return decision.class_permutation(views.EXTERNAL_NAMES, views.EXTERNAL_TO_LABEL)


def _aligned(spark, sf):
    return ensemble.aligned_probabilities(
        views.logits_a(spark, sf), views.logits_b(spark, sf, external=True), _permutation()
    )


def ensemble_scored(spark, sf):
    """Weights for two scorers over the same texts, the second with its own class order and text profile."""
    texts = views.corpus(spark, sf).where("text != ''").select("doc_id", "label_id", "text")
    short = head_tail("t", SHORT_MAX_LENGTH, SHORT_HEAD_TOKENS, SHORT_TAIL_TOKENS)
    cut = texts.selectExpr("doc_id", f"{tokens('text')} AS t").selectExpr("doc_id", f"array_join({short}, ' ') AS text")
    second = scoring.scorer_udf("cue:2", lambda: scoring.CueScorer(SECOND_CUES, CUE_SCALE))
    aligned = ensemble.aligned_probabilities(
        scoring.score(texts, cue_udf()), scoring.score(cut, second), _permutation(), "doc_id"
    )
    return ensemble.weight_sweep(aligned).selectExpr("grid_idx", r9("weight"), r9("macro_f1"))


def ensemble_probs(spark, sf):
    return _aligned(spark, sf).selectExpr(
        "row_key", *[r9(b, f"external_{n}") for b, n in zip(ensemble.EXTERNAL, LABELS)],
        *[r9(m, f"mixed_{n}") for m, n in zip(ensemble.mix(0.55), LABELS)],
    )


def ensemble_sweep(spark, sf):
    return ensemble.weight_sweep(_aligned(spark, sf)).selectExpr("grid_idx", r9("weight"), r9("macro_f1"))


def ensemble_diagnostics(spark, sf):
    return ensemble.diagnostics(_aligned(spark, sf)).selectExpr(r9("disagreement_rate"), r9("both_wrong_rate"))


def ensemble_report(spark, sf):
    """The mixing weight chosen on validation rows, evaluated once on test rows."""
    report = ensemble.evaluate(*_split_logits(_aligned(spark, sf)), "external-demo", _permutation())
    return report.selectExpr(
        "external_model.name AS external_name",
        "array_join(transform(external_model.permutation, x -> CAST(x AS STRING)), ',') AS external_permutation",
        r9("own_model.test_macro_f1", "own_macro_f1"),
        r9("external_model.test_macro_f1", "external_macro_f1"),
        r9("ensemble.best_weight_own", "best_weight"),
        r9("ensemble.val_macro_f1", "val_macro_f1"),
        r9("ensemble.test_macro_f1", "ensemble_macro_f1"),
        *[r9(f"ensemble.test_per_class_f1.{n}", f"ensemble_f1_{n}") for n in LABELS],
        r9("ensemble.gain_over_own", "gain"),
        r9("diagnostics.disagreement_rate", "disagreement_rate"),
        r9("diagnostics.both_wrong_rate", "both_wrong_rate"),
    )


# --------------------------------------------------------------------------- ingest, history
def keyset_page(spark, sf):
    docs = views.table(spark, sf, "documents")
    rows = docs.selectExpr(f"{views.hex_id('doc_id')} AS review_id", "md5(text) AS text_md5")
    return ingest.keyset_page(rows, CURSOR)


def advance_cursor(spark, sf):
    """One pipeline per source and language; some have an older cursor, some a higher one."""
    docs = views.table(spark, sf, "documents")
    published = docs.selectExpr(
        "source AS checkpoint_id", "lang AS source_collection", f"'{REVIEWS_TOPIC}' AS target_topic",
        f"{views.hex_id('doc_id')} AS review_id",
    )
    cursors = (
        docs.join(views.table(spark, sf, "labels"), "doc_id")
        .groupBy("source", "lang")
        .agg(F.expr("max(doc_id * (1 + toxic)) AS top"))
        .selectExpr(
            "source AS checkpoint_id", "lang AS source_collection", f"'{REVIEWS_TOPIC}' AS target_topic",
            f"{views.hex_id('top')} AS last_review_id",
        )
    )
    out = ingest.advance_cursor(published, cursors, views.instant(views.EMITTED_AT))
    return out.selectExpr(*out.columns[:-1], stamp("updated_at"))


def next_offsets(spark, sf):
    docs = views.table(spark, sf, "documents")
    return ingest.next_offsets(docs.selectExpr(f"'{REVIEWS_TOPIC}' AS topic", *views.topic_position("doc_id")))


def insert_if_absent(spark, sf):
    """A batch of both versions, the second twice, against a history holding the first."""
    one, two = views.history_a(spark, sf), views.history_b(spark, sf)
    later = two.withColumn("predicted_at", F.expr("predicted_at + INTERVAL 1 DAY"))
    arrived = [df.selectExpr("*", f"{n} AS arrival") for n, df in ((1, one), (3, later), (2, two))]
    batch = arrived[0].unionByName(arrived[1]).unionByName(arrived[2])
    fresh = history.new_rows(batch, one, [F.asc("arrival")])
    return fresh.selectExpr("prediction_id", "review_id", "model_version", "arrival", stamp("predicted_at"))


def history_lookup(spark, sf):
    """One prediction of the stored table, found by its review and its id."""
    review = f"{LOOKUP_ROW:024x}"
    model = views.MODEL_A
    wanted = hashlib.sha256(f"review:{review}\0{model.name}\0{model.version}".encode()).hexdigest()
    found = history.lookup(history.lookup_review(spark, _stored_history(spark, sf), review), wanted)
    return found.select("prediction_id", "review_id", "sentiment", "model_version")


def _stored_history(spark, sf) -> str:
    path = work_folder(views.configure(spark), "history")
    history.write_history(views.history(spark, sf), path)
    return path


def history_counts(spark, sf):
    return history.counts(views.history(spark, sf))


def history_delete(spark, sf):
    """The stored history after the reviews that version 2 called negative were deleted."""
    path = _stored_history(spark, sf)
    keys = views.history_b(spark, sf).where("sentiment = 'neg'").select("review_id")
    history.delete_stored(spark, path, keys, "review_id")
    return history.read_history(spark, path).select("prediction_id", "review_id", "model_version")


def history_compact(spark, sf):
    """The stored history after two appends and a compaction."""
    path = work_folder(views.configure(spark), "history")
    for rows in (views.history_a(spark, sf), views.history_b(spark, sf)):
        for part in (0, 1):
            history.write_history(rows.where(f"pmod(hash(prediction_id), 2) = {part}"), path)
    history.compact(spark, path)
    return history.read_history(spark, path).select("prediction_id", "review_id", "sentiment", "model_version")


# --------------------------------------------------------------------------- tables and files
def history_table(spark, sf):
    """The stored history after two batches, the second repeating the first."""
    path = work_folder(views.configure(spark), "history")
    one, two = views.history_a(spark, sf), views.history_b(spark, sf)
    batches = one.drop("stored_at"), one.unionByName(two).unionByName(two).drop("stored_at")
    for rows in batches:
        history.insert_if_absent(spark, path, rows, F.current_timestamp(), [F.asc("predicted_at")])
    return history.read_history(spark, path).selectExpr(
        "prediction_id", "review_id", "sentiment", "label_id", r9("confidence"), "model_version",
        "model_run_id", stamp("predicted_at"), "stored_at IS NOT NULL AS stored",
    )


def corpus_snapshot(spark, sf):
    """The cleaned corpus written as Parquet once and read back."""
    path = work_folder(views.configure(spark), "snapshot")
    for _ in range(2):
        kept = files.snapshot(spark, path, lambda: corpus.clean(views.corpus(spark, sf)))
    return kept.selectExpr("doc_id", "md5(text) AS text_md5", "label", "label_id")


def corpus_csv(spark, sf):
    """The corpus written as CSV and read back, texts with line breaks and quotes included."""
    path = work_folder(views.configure(spark), "csv")
    files.write_snapshot(views.corpus(spark, sf), path, "csv")
    back = files.read_csv(spark, path, "doc_id BIGINT, text STRING, label STRING, label_id INT")
    return back.selectExpr("doc_id", "md5(text) AS text_md5", "label", "label_id")


def decide_from_report(spark, sf):
    """Calibrate, write the report, read it back as a config and decide all rows with it."""
    rows = views.logits_a(spark, sf)
    _, report = calibrate.calibrate(*_split_logits(rows))
    path = work_folder(spark, "report")
    files.write_report(report, path)
    config = files.read_decision_config(spark, path)
    return decision.with_decision(rows, config).select("row_key", "label_id", "pred")


def _positioned(records: DataFrame) -> DataFrame:
    """Records with the partition and offset that their review's number gives them."""
    return records.selectExpr("*", *views.topic_position("CAST(conv(CAST(key AS STRING), 16, 10) AS BIGINT)"))


def keyset_mixed_case(spark, sf):
    """Pages of reviews whose ids are spelled in both cases, one after the other, validated."""
    docs, moments = views.table(spark, sf, "documents"), views.table(spark, sf, "events")
    spelled = docs.selectExpr(
        f"{views.hex_id('doc_id')} AS review_id", "doc_id", "text", "source AS movie_id"
    ).withColumn("review_id", F.expr("IF(doc_id % 2 = 0, upper(review_id), review_id)"))
    cursor, pages = CURSOR, []
    for _ in range(3):
        # Each document is a review at least once, so the page lies among the first documents: only they meet events.
        first = ingest.keyset_page(spelled, cursor, ingest.PAGE_SIZE)
        page = stored(ingest.valid_page(views.with_creation(first, moments), cursor, ingest.PAGE_SIZE), "page")
        cursor = page.agg(F.max("review_id")).first()[0]
        pages.append(page.selectExpr("review_id", "md5(text) AS text_md5", f"{len(pages)} AS page"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def lookback_publish(spark, sf):
    """Reviews of one language arrive late, below the cursor; each is published exactly once."""
    folder = work_folder(views.configure(spark), "published")
    cursor = ingest.CursorTable(spark, f"{folder}-cursor", "late-reviews", "documents", REVIEWS_TOPIC)
    docs = views.reviews(spark, sf)
    early = docs.where("doc_id % 3 != 0")

    def write(records: DataFrame) -> None:
        topics.write_topic_log(_positioned(records), folder)

    jobs.publish_after(spark, early, cursor, write)
    for _ in range(2):
        log = topics.read_topic_log(spark, folder, REVIEWS_TOPIC).selectExpr("CAST(key AS STRING) AS review_id")
        jobs.publish_after(spark, docs, cursor, write, page=5, lookback="", published=stored(log, "known"))
    parsed = contracts.parse_review_events(topics.read_topic_log(spark, folder, REVIEWS_TOPIC))
    return parsed.groupBy("event.review_id").agg(F.count("*").alias("published"))


def cursor_identity(spark, sf):
    """Three pipelines over the reviews: where each one's cursor is, and what others may do with it."""
    folder = work_folder(views.configure(spark), "cursors")
    ends = (
        views.reviews(spark, sf).groupBy(F.expr("doc_id % 3").alias("k"))
        .agg(F.min("review_id").alias("first"), F.max("review_id").alias("last")).orderBy("k").collect()
    )

    def outcome(call) -> str:
        try:
            return call() or "none"
        except (ingest.CursorMismatch, ingest.CursorRegression, ingest.CursorConflict) as error:
            return type(error).__name__

    rows = []
    for end in ends:  # one row per pipeline
        name = f"pipeline-{end.k}"
        own = ingest.CursorTable(spark, folder, name, "documents", REVIEWS_TOPIC)
        before = outcome(own.load)
        own.save(end.first)
        own.save(end.last, expected=end.first)
        rows.append((
            name, before, own.load(), outcome(lambda: own.save(end.first)), outcome(lambda: own.save(end.last, expected=end.first)),
            outcome(ingest.CursorTable(spark, folder, name, "events", REVIEWS_TOPIC).load),
            outcome(ingest.CursorTable(spark, folder, name, "documents", PREDICTIONS_TOPIC).load),
        ))
    names = ("checkpoint_id", "before", "last_review_id", "backwards", "outdated", "other_source", "other_topic")
    return spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in names))


def incremental_publish(spark, sf):
    """Publish above the cursor twice; the second run finds nothing new."""
    folder = work_folder(views.configure(spark), "published")
    cursor = ingest.CursorTable(spark, f"{folder}-cursor", "reviews-to-topic", "documents", REVIEWS_TOPIC)

    def write(records: DataFrame) -> None:
        topics.write_topic_log(_positioned(records), folder)

    for _ in range(2):
        jobs.publish_after(spark, views.reviews(spark, sf), cursor, write)
    parsed = contracts.parse_review_events(topics.read_topic_log(spark, folder, REVIEWS_TOPIC))
    return parsed.selectExpr(
        "error_type", "event.event_id", "event.movie_id", "md5(event.text) AS text_md5",
        stamp("source_created_at", "event."), f"'{cursor.load()}' AS cursor",
    )


# --------------------------------------------------------------------------- scoring
def scored_predictions(spark, sf):
    """Every document scored by a Python model in Arrow batches, decided natively."""
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    scored = scoring.predict(docs, cue_udf(), views.CLASS_BIAS)
    return scored.selectExpr(
        "doc_id", "label_id", "sentiment", r9("confidence"),
        *[r9(f"probabilities.{n}", f"p_{n}") for n in LABELS],
    )


def _scored_log(spark, sf) -> str:
    """Run publish, score and route as a stream over ``documents``; return the log folder."""
    folder = work_folder(views.configure(spark), "topic-log")
    docs = spark.readStream.schema(views.TABLES["documents"]).parquet(
        f"{sf}/documents.parque[t]"
    )
    records = views.review_log_of(views.documents_as_reviews(docs, views.table(spark, sf, "events")))
    out = jobs.score(records, cue_udf(), views.CLASS_BIAS, views.MODEL_A)
    run = jobs.start_topic_sink(out, folder, f"{folder}-checkpoint", {"availableNow": True})
    run.awaitTermination()
    return folder


def stream_history(spark, sf):
    """Streamed scoring and persistence; run twice with new checkpoints, stored once."""
    log = _scored_log(spark, sf)
    stored = work_folder(spark, "history")
    for attempt in ("first", "replay"):
        records = topics.stream_topic_log(spark, log, PREDICTIONS_TOPIC)
        jobs.start_history_sink(
            records, stored, f"{stored}-{attempt}", {"availableNow": True}
        ).awaitTermination()
    rows = history.read_history(spark, stored)
    return rows.selectExpr(
        "prediction_id", "review_id", "movie_id", stamp("source_created_at"), "sentiment", "label_id",
        r9("confidence"), "model_version", "model_run_id",
    )


def stream_history_deduped(spark, sf):
    """A log that holds every prediction twice; the stream's state drops the second copies."""
    log = _scored_log(spark, sf)
    records = topics.read_topic_log(spark, log, PREDICTIONS_TOPIC)
    both = work_folder(spark, "topic-log")
    topics.write_topic_log(records, both)
    topics.write_topic_log(records.withColumn("offset", F.expr("offset + 1000000000000")), both)
    table = work_folder(spark, "history")
    jobs.start_history_sink(
        topics.stream_topic_log(spark, both, PREDICTIONS_TOPIC), table, f"{table}-once", {"availableNow": True}, horizon="1 hour"
    ).awaitTermination()
    rows = history.read_history(spark, table)
    return rows.selectExpr(
        "prediction_id", "review_id", "movie_id", stamp("source_created_at"), "sentiment", "label_id",
        r9("confidence"), "model_version", "model_run_id",
    )


def stream_dead_letters(spark, sf):
    """Dead letters of the streamed scoring job."""
    letters = topics.read_topic_log(spark, _scored_log(spark, sf), DEAD_LETTER_TOPIC)
    members = (
        "source_topic STRING, source_partition INT, source_offset BIGINT, key_base64 STRING, "
        "error_type STRING, error_message STRING"
    )
    return letters.selectExpr(f"inline(array(from_json(CAST(value AS STRING), '{members}')))")


def text_classifier(spark, sf):
    """A class-weighted classifier trained on the split corpus, evaluated on its test rows."""
    from reviewflow.operators import classifier

    clean = stored(corpus.clean(views.corpus(spark, sf)), "corpus")
    split = stored(corpus.stratified_split(clean, "doc_id"), "split", "split")
    part = lambda name: split.where(f"split = '{name}'")
    model = classifier.train(part("train"), part("val"))
    logits = stored(classifier.add_logits(model, part("test")), "scored")
    scored = metrics.eval_metrics(decision.with_decision(logits, views.ARGMAX)).select("macro_f1")
    counts = logits.groupBy("label_id").agg(
        F.count("*").alias("n_test"),
        F.count_if(F.expr("size(logits) = 3 AND forall(logits, x -> NOT isnan(x) AND abs(x) < 1e300)")).alias("n_scored"),
    )
    classes = F.expr("count(*) OVER ()")
    counts = counts.withColumn("majority_f1", F.expr("2 * max(n_test) OVER () / (max(n_test) OVER () + sum(n_test) OVER ())") / classes)
    return counts.crossJoin(F.broadcast(scored)).selectExpr(
        "label_id", "n_test", "n_scored", r9("majority_f1", "majority_macro_f1"), "macro_f1 > majority_f1 AS beats_majority"
    )


def queries():
    found = {
        "softmax_probs": softmax_probs,
        "decide_argmax": _decided(views.ARGMAX),
        "decide_class_bias": _decided(views.CLASS_BIAS),
        "decide_thresholds": _decided(views.THRESHOLDS),
        "head_tail": head_tail_tokens,
    }
    for f in (
        prediction_id, review_events, prediction_events, history_rows, latest_prediction,
        sentiment_summary, event_envelope, route_by_topic, dead_letters, validate_review,
        validate_store_document, validate_event, validate_prediction, validate_prediction_event,
        check_constraints, uniqueness_violations, quarantine_split, clean_corpus, clean_report,
        class_counts, stratified_split, class_shares, class_weights, length_profile, confusion,
        per_class_report, eval_metrics, weighted_ce, nll_by_temperature, temperature_fit,
        grid_class_bias, grid_thresholds, strategy_compare, strategy_select, heldout_gain,
        calibration_report, ensemble_probs, ensemble_sweep, ensemble_diagnostics, ensemble_report, ensemble_scored,
        keyset_page, advance_cursor, next_offsets, insert_if_absent, history_lookup,
        keyset_mixed_case, lookback_publish, history_compact,
        history_counts, history_delete, history_table, corpus_snapshot, corpus_csv, decide_from_report,
        cursor_identity, incremental_publish, scored_predictions, stream_history, stream_history_deduped, stream_dead_letters,
        text_classifier,
    ):
        found[f.__name__] = f
    return found


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment_summary(spark, sf_dir)
