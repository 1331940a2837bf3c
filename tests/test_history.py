from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewflow.operators import history, ingest
from reviewflow.operators.sizes import with_keys, without_keys
from reviewflow.plans import queries, views
from reviewflow.schema import HISTORY_COLUMNS
from reviewflow.sources import topics
from reviewflow.streaming import jobs

RIDS = [f"5e1f00d4c0ffee00ba5eba1{i}" for i in range(1, 10)]


def rows(spark, *items):
    """History rows (prediction id, review, predicted second, stored second, version)."""
    df = spark.createDataFrame(
        [(p, r, a, b, v) for p, r, a, b, v in items], "p STRING, r STRING, a INT, b INT, v STRING"
    )
    values = {
        "prediction_id": "p", "schema_version": "1S", "source_event_id": "concat('review:', r)",
        "review_id": "r", "movie_id": "CAST(NULL AS STRING)", "source_created_at": "CAST(NULL AS TIMESTAMP)",
        "sentiment": "'pos'", "label_id": "2S", "confidence": "0.8D", "probability_neg": "0.1D",
        "probability_neu": "0.1D", "probability_pos": "0.8D", "model_name": "'m'", "model_version": "v",
        "model_run_id": "CAST(NULL AS STRING)", "predicted_at": "timestamp_seconds(a)",
        "stored_at": "timestamp_seconds(b)",
    }
    return df.selectExpr(*[f"{e} AS {c}" for c, e in values.items()])


def test_latest_breaks_ties_by_stored_at_then_id(spark):
    df = rows(
        spark,
        ("a", RIDS[0], 1, 9, "1"), ("b", RIDS[0], 2, 1, "2"),
        ("c", RIDS[1], 5, 2, "1"), ("d", RIDS[1], 5, 1, "2"),
        ("e", RIDS[2], 5, 5, "1"), ("f", RIDS[2], 5, 5, "2"),
    )
    latest = {r.review_id: r.prediction_id for r in history.latest_predictions(df).collect()}
    assert latest == {RIDS[0]: "b", RIDS[1]: "c", RIDS[2]: "f"}


def test_a_hot_review_is_reduced_before_the_shuffle(spark):
    df = spark.range(9000).selectExpr(
        "sha2(CAST(id AS STRING), 256) AS prediction_id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS review_id",
        "timestamp_seconds(id) AS predicted_at", "timestamp_seconds(0) AS stored_at",
    )
    latest = history.latest_predictions(df)
    assert latest._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert latest.count() == 6001
    assert latest.where("review_id = 'hot'").selectExpr("unix_seconds(predicted_at)").first()[0] == 8997


def test_insert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "history")
    first = rows(spark, ("a", RIDS[0], 1, 0, "1"), ("b", RIDS[1], 1, 0, "1"), ("a", RIDS[0], 9, 0, "1"))
    batch = first.drop("stored_at").withColumn("offset", F.expr("unix_seconds(predicted_at)"))
    insert = lambda df: history.insert_if_absent(
        spark, path, df, F.expr("timestamp_seconds(100)"), [F.asc("offset")]
    )
    assert insert(batch) == 2
    assert insert(batch) == 0
    more = rows(spark, ("a", RIDS[0], 1, 0, "1"), ("c", RIDS[0], 1, 0, "2"), ("d", RIDS[5], 1, 0, "1"))
    assert insert(more.drop("stored_at").withColumn("offset", F.lit(1))) == 2
    assert insert(more.where("false").drop("stored_at").withColumn("offset", F.lit(1))) == 0
    stored = history.read_history(spark, path)
    assert stored.columns == list(HISTORY_COLUMNS)
    assert sorted(r.prediction_id for r in stored.collect()) == ["a", "b", "c", "d"]
    kept = history.lookup(stored, "a").selectExpr("unix_seconds(predicted_at) p", "unix_seconds(stored_at) s").first()
    assert (kept.p, kept.s) == (1, 100)
    assert history.counts(stored, "a").collect()[0].n == 1


def files(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path, other = str(tmp_path / "a"), "0" * 24
    history.write_history(rows(
        spark, ("a", RIDS[0], 1, 0, "1"), ("b", RIDS[0], 1, 0, "2"), ("c", RIDS[1], 1, 0, "1"), ("d", other, 1, 0, "1")
    ), path)
    before = files(tmp_path / "a")
    keys = spark.createDataFrame([(RIDS[0],), ("f" * 24,)], "review_id STRING")
    assert history.delete_stored(spark, path, keys, "review_id") == 2
    assert sorted(r.prediction_id for r in history.read_history(spark, path).collect()) == ["c", "d"]
    after = files(tmp_path / "a")
    untouched = {f: t for f, t in before.items() if "review_bucket=000" in str(f)}
    assert untouched and untouched.items() <= after.items()
    assert not list((tmp_path / "a" / "model_name=m").glob("model_version=2/review_bucket=*"))
    assert history.delete_stored(spark, path, keys, "review_id") == 0
    one = spark.createDataFrame([("d",)], "prediction_id STRING")
    assert history.delete_stored(spark, path, one, "prediction_id") == 1
    assert [r.prediction_id for r in history.read_history(spark, path).collect()] == ["c"]


def test_compaction_keeps_rows_and_other_partitions(spark, tmp_path):
    path = str(tmp_path / "a")
    for i, r in enumerate(RIDS[:4]):
        history.write_history(rows(spark, (f"p{i}", r, 1, 0, "1")), path)
    history.write_history(rows(spark, ("q", "0" * 24, 1, 0, "1")), path)
    before = files(tmp_path / "a")
    assert len(before) == 5 and history.compact(spark, path) == 1
    after = files(tmp_path / "a")
    assert len(after) == 2 and len(set(before.items()) & set(after.items())) == 1
    assert sorted(r.prediction_id for r in history.read_history(spark, path).collect()) == ["p0", "p1", "p2", "p3", "q"]


def test_files_are_sorted_by_review(spark, tmp_path):
    path = str(tmp_path / "a")
    shuffled = [RIDS[i] for i in (4, 0, 7, 2, 8, 1)]
    many = rows(spark, *[(f"{v}{i}", r, i, 0, v) for v in "12" for i, r in enumerate(shuffled)]).repartition(2)
    history.write_history(many, path)
    for f in files(tmp_path / "a"):
        found = [r.review_id for r in spark.read.parquet(str(f)).collect()]
        assert len(found) == 6 and found == sorted(found)


def test_insert_reads_only_partitions_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "a")
    history.write_history(rows(spark, ("a", RIDS[0], 1, 0, "1"), ("b", "0" * 24, 1, 0, "1")), path)
    batch = rows(spark, ("a", RIDS[0], 1, 0, "1"), ("c", RIDS[1], 1, 0, "1"))
    touched = history.with_bucket(batch).select(*history.PARTITIONS).distinct().collect()
    scan = history.read_partitions(spark, path).where(history._within(touched)).select("prediction_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "review_bucket" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert [r.prediction_id for r in scan.collect()] == ["a"]
    (tmp_path / "a" / "model_name=m" / "model_version=1" / "review_bucket=000").rename(tmp_path / "away")
    assert history.insert_if_absent(spark, path, batch.drop("stored_at"), F.expr("timestamp_seconds(9)"), [F.asc("predicted_at")]) == 1


def test_lookup_of_a_stored_review(spark, tmp_path):
    path = str(tmp_path / "a")
    history.write_history(rows(spark, ("a", RIDS[0], 1, 0, "1"), ("b", RIDS[1], 1, 0, "1")), path)
    assert [r.prediction_id for r in history.lookup_review(spark, path, RIDS[1]).collect()] == ["b"]


def test_the_merge_ignores_stored_rows():
    text = topics.merge_statement("staging", "history")
    assert "DISTINCT ON (prediction_id)" in text and text.endswith("ON CONFLICT DO NOTHING RETURNING prediction_id")
    assert "stored_at" not in text and all(c in text for c in HISTORY_COLUMNS[:-1])


def test_history_layout_is_pruned_by_model_version(spark, tmp_path):
    path = str(tmp_path / "history")
    history.write_history(rows(spark, ("a", RIDS[0], 1, 0, "1"), ("b", RIDS[0], 1, 0, "2")), path)
    assert (tmp_path / "history" / "model_name=m" / "model_version=1").is_dir()
    scan = history.read_history(spark, path).where("model_version = '1' AND review_id = 'x'")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "model_version" in filters.split("PushedFilters")[0] and "EqualTo(review_id,x)" in plan


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_key_joins_agree_with_and_without_broadcast(spark, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = spark.range(300).selectExpr("IF(id < 100, 'hot', CAST(id AS STRING)) AS k", "id AS row")
    keys = spark.createDataFrame([("hot",), ("150",), ("150",), ("none",), (None,)], "k STRING")
    kept = {r.row for r in without_keys(df, keys, "k", F.col("row")).collect()}
    assert kept == set(range(100, 300)) - {150}
    assert {r.row for r in with_keys(df, keys, "k", F.col("row")).collect()} == {*range(100), 150}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def reviews(spark, ids):
    return spark.createDataFrame(
        [(i, f"text {i}", None, None) for i in ids],
        "review_id STRING, text STRING, movie_id STRING, created_at TIMESTAMP",
    )


def test_pages_follow_the_cursor(spark):
    df = reviews(spark, [RIDS[2], RIDS[0], RIDS[1]])
    page = [r.review_id for r in ingest.keyset_page(df, None, 2).collect()]
    assert page == RIDS[:2]
    assert [r.review_id for r in ingest.keyset_page(df, page[-1], 2).collect()] == [RIDS[2]]
    assert ingest.keyset_page(df, RIDS[2], 2).isEmpty()
    with pytest.raises(ValueError):
        ingest.keyset_page(df, None, 0)


def cursor(spark, path, **changes):
    settings = {"checkpoint_id": "c", "source_collection": "reviews", "target_topic": "reviews.v1", **changes}
    return ingest.CursorTable(spark, str(path / "cursor"), **settings)


def test_cursor_moves_forward_only(spark, tmp_path):
    c = cursor(spark, tmp_path)
    assert c.load() is None
    assert c.save(RIDS[0]) == RIDS[0]
    assert c.save(RIDS[1].upper()) == RIDS[1]
    assert c.save(RIDS[1]) == RIDS[1]
    with pytest.raises(ingest.CursorRegression):
        c.save(RIDS[0])
    with pytest.raises(ValueError):
        c.save("nonsense")
    assert cursor(spark, tmp_path, checkpoint_id="other").load() is None
    for changes in ({"source_collection": "x"}, {"target_topic": "y"}):
        with pytest.raises(ingest.CursorMismatch):
            cursor(spark, tmp_path, **changes).load()


def test_incremental_publishing_resumes_and_sees_late_rows_only_with_lookback(spark, tmp_path):
    c, published = cursor(spark, tmp_path), []

    def write(records):
        published.append(sorted(r.key.decode() for r in records.collect()))

    run = lambda ids, **kw: jobs.publish_after(spark, reviews(spark, ids), c, write, **kw)
    assert run([RIDS[4], RIDS[1]], page=1) == 1 and c.load() == RIDS[1]
    assert run([RIDS[4], RIDS[1]]) == 1 and c.load() == RIDS[4]
    assert run([RIDS[4], RIDS[1], RIDS[2]]) == 0
    assert run([RIDS[4], RIDS[1], RIDS[2]], lookback=RIDS[1]) == 2
    assert published == [[RIDS[1]], [RIDS[4]], [RIDS[2], RIDS[4]]]
    assert c.load() == RIDS[4]


def test_ids_are_compared_in_lower_case(spark, tmp_path):
    spelled = [f"{i:024x}" for i in range(1, 16)]
    spelled = [s.upper() if i % 2 else s for i, s in enumerate(spelled)]
    df, start = reviews(spark, spelled), f"{10:024x}"
    page = [r.review_id for r in ingest.keyset_page(df, start, 3).collect()]
    assert [p.lower() for p in page] == [f"{i:024x}" for i in (11, 12, 13)]
    assert ingest.after(df, start.upper()).count() == 5
    valid = ingest.valid_page(df, start, 9).collect()
    assert {r.review_id for r in valid} == {f"{i:024x}" for i in range(11, 16)}
    with pytest.raises(PySparkException, match="contract violated"):
        ingest.valid_page(reviews(spark, ["zz"]), None, 2).collect()
    c, keys = cursor(spark, tmp_path), []
    count = lambda: jobs.publish_after(spark, df, c, lambda r: keys.extend(x.key.decode() for x in r.collect()), page=4)
    assert [count() for _ in range(5)] == [4, 4, 4, 3, 0]
    assert keys == sorted(keys) or sorted(keys) == [f"{i:024x}" for i in range(1, 16)]


def test_lookback_with_pages_makes_progress_and_repeats_nothing(spark, tmp_path):
    c, published = cursor(spark, tmp_path), []

    def write(records):
        published.extend(r.key.decode() for r in records.collect())

    known = lambda: spark.createDataFrame([(p,) for p in published], "review_id STRING")
    run = lambda ids, **kw: jobs.publish_after(spark, reviews(spark, ids), c, write, page=2, **kw)
    assert run([RIDS[0], RIDS[4]]) == 2
    ids = list(RIDS)
    sizes = [run(ids, lookback="0" * 24, published=known()) for _ in range(4)]
    assert sizes == [5, 2, 0, 0]  # three late ones and a page, the last page, nothing
    assert sorted(published) == RIDS and c.load() == RIDS[-1]


def test_pages_are_published_until_none_is_left(spark, tmp_path):
    c, published = cursor(spark, tmp_path), []

    def write(records):
        published.append(sorted(r.key.decode() for r in records.collect()))

    read = lambda: reviews(spark, [RIDS[2], RIDS[0], RIDS[1]])
    assert jobs.publish_until_empty(spark, read, c, write, page=2) == 3
    assert published == [RIDS[:2], [RIDS[2]]]
    assert jobs.publish_until_empty(spark, read, c, write) == 0


def test_of_two_writers_one_moves_the_cursor(spark, tmp_path):
    c = cursor(spark, tmp_path)
    c.save(RIDS[0])
    number, _ = c._latest()
    c._create(number + 1, RIDS[1])
    with pytest.raises(ingest.CursorConflict):
        cursor(spark, tmp_path)._create(number + 1, RIDS[2])  # has seen the same number
    assert c.load() == RIDS[1]
    with pytest.raises(ingest.CursorConflict):
        c.save(RIDS[2], expected=RIDS[0])
    with pytest.raises(ingest.CursorConflict):
        c.save(RIDS[2], expected=None)
    assert c.save(RIDS[2], expected=RIDS[1]) == RIDS[2] == c.load()


def test_old_cursor_numbers_go_and_do_not_come_back(spark, tmp_path):
    c = cursor(spark, tmp_path)
    ids = [f"{i:024x}" for i in range(1, 16)]
    for i in ids:
        c.save(i)
    assert len(c._numbers()) == c.KEPT and c.load() == ids[-1]
    with pytest.raises(ingest.CursorConflict):
        c._create(2, ids[3])  # its number is free again, but others count
    assert c.load() == ids[-1]


def test_concurrent_saves_leave_the_highest(spark, tmp_path):
    ids = [f"{i:024x}" for i in range(1, 41)]

    def save(i):
        while True:
            try:
                return cursor(spark, tmp_path).save(i)
            except ingest.CursorConflict:
                continue
            except ingest.CursorRegression:
                return None

    with ThreadPoolExecutor(4) as pool:
        saved = [x for x in pool.map(save, ids) if x]
    assert ids[-1] in saved and cursor(spark, tmp_path).load() == ids[-1]


def test_an_invalid_review_stops_publishing(spark, tmp_path):
    c = cursor(spark, tmp_path)
    with pytest.raises(PySparkException, match="contract violated"):
        jobs.publish_after(spark, reviews(spark, [RIDS[0], "x"]), c, lambda records: records.collect())
    assert c.load() is None


def test_a_failed_write_leaves_the_cursor(spark, tmp_path):
    c = cursor(spark, tmp_path)

    def write(_records):
        raise OSError("not stored")

    with pytest.raises(OSError):
        jobs.publish_after(spark, reviews(spark, RIDS[:2]), c, write)
    assert c.load() is None


def test_keyset_filter_reaches_the_scan(spark, tmp_path):
    reviews(spark, RIDS).write.parquet(str(tmp_path / "r"))
    page = ingest.keyset_page(spark.read.parquet(str(tmp_path / "r")).select("review_id"), RIDS[3], 2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(review_id" in plan and "TakeOrderedAndProject" in plan and "text" not in plan


def test_views_share_one_identity(spark, sf_small):
    a, b = views.history_a(spark, sf_small), views.history_b(spark, sf_small)
    assert a.join(b, "review_id").count() == a.count() and a.join(b, "prediction_id").count() == 0


def test_only_the_page_meets_the_events(spark, sf_mid, monkeypatch):
    given, valid_page = [], ingest.valid_page
    monkeypatch.setattr(ingest, "valid_page", lambda rows, *rest: given.append(rows.count()) or valid_page(rows, *rest))
    assert queries.keyset_mixed_case(spark, sf_mid).count() == 150
    assert len(given) == 3 and max(given) <= ingest.PAGE_SIZE


def test_a_page_keeps_rows_without_and_with_several_events(spark):
    page = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id LONG, text STRING")
    moments = spark.createDataFrame([(1, 10), (1, 20), (3, 30), (9, 90)], "event_id LONG, s LONG")
    moments = moments.selectExpr("event_id", "timestamp_seconds(s) AS ts")
    got = views.with_creation(page, moments).selectExpr("doc_id", "text", "unix_timestamp(created_at) AS s")
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, "a", 10), (1, "a", 20), (2, "b", None), (3, "c", 30)]
