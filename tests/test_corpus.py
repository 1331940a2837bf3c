import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from reviewflow.functions import text
from reviewflow.operators import corpus
from reviewflow.schema import SHORT_HEAD_TOKENS, SHORT_MAX_LENGTH, SHORT_TAIL_TOKENS


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, label STRING, label_id INT")


def test_clean_keeps_the_lowest_label_and_drops_blanks(spark):
    df = labelled(spark, [
        (5, "same", "pos", 2), (3, "same", "neu", 1), (4, "same", "neu", 1), (1, "NA", "neg", 0),
        (2, "　\x1c", "neg", 0), (6, "", "pos", 2), (7, None, "pos", 2), (8, "Same", "pos", 2),
    ])
    assert sorted(r.doc_id for r in corpus.clean(df).collect()) == [1, 3, 8]
    report = corpus.clean_report(df).first()
    assert (report.rows_before, report.rows_after, report.removed) == (8, 3, 5)


def test_a_text_held_by_a_third_of_the_rows_is_reduced_before_the_shuffle(spark):
    df = spark.range(30_000).selectExpr(
        "id AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id)) AS text", "'pos' AS label", "2 AS label_id"
    )
    kept = corpus.clean(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert kept.count() == 20_001
    assert kept.where("text = 'hot'").first().doc_id == 0


def test_strip_equals_python(spark):
    samples = ["\x1c a　b \x85\xa0", " x ", "​x", "\n\t\x0b", "", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "t STRING")
    got = df.selectExpr(f"{text.strip_text('t')} AS s", f"{text.is_nonblank('t')} AS b").collect()
    assert [(r.s, r.b) for r in got] == [(s.strip(), bool(s.strip())) for s in samples]


@pytest.mark.parametrize("profile", [(512, 256, 254), (SHORT_MAX_LENGTH, SHORT_HEAD_TOKENS, SHORT_TAIL_TOKENS)])
def test_head_tail(spark, profile):
    limit, head, tail = profile
    sizes = [0, 1, limit - 2, limit - 1, 2000]
    df = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in sizes], "n INT, t ARRAY<STRING>")
    for row in df.selectExpr("n", f"{text.head_tail('t', *profile)} AS cut").collect():
        want = [str(i) for i in range(row.n)]
        assert row.cut == (want if row.n <= limit - 2 else want[:head] + want[-tail:])
    with pytest.raises(ValueError):
        text.head_tail("t", 10, 8, 2)


def test_tokens(spark):
    got = spark.sql("SELECT ' a  b\\n\\tc\\r\\n' AS t").selectExpr(f"{text.tokens('t')} AS t").first().t
    assert got == ["a", "b", "c"]


def test_length_profile_equals_numpy(spark):
    n = np.concatenate([np.random.default_rng(0).integers(3, 900, 500), np.full(400, 100_000)])
    row = corpus.length_profile(spark.createDataFrame([(int(x),) for x in n], "n_tokens INT")).first()
    assert (row.n, row["min"], row["max"]) == (900, n.min(), n.max())
    assert row["mean"] == pytest.approx(n.mean()) and row["std"] == pytest.approx(n.std(ddof=1))
    for p in (50, 75, 90, 95, 99):
        assert row[f"p{p}"] == pytest.approx(np.percentile(n, p))
    assert row.share_over_512 == np.round((n > 512).mean(), 3)


def test_class_weights_and_absent_class(spark):
    df = labelled(spark, [(i, str(i), "x", c) for i, c in enumerate([0, 0, 1, 2, 2, 2])])
    got = {r.label_id: r.weight for r in corpus.class_weights(df).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: pytest.approx(2 / 3)}
    with pytest.raises(PySparkException, match="class neu has no rows"):
        corpus.class_weights(df.where("label_id != 1")).collect()


@pytest.mark.parametrize("sizes", [(700, 200, 100), (1, 1, 1), (2, 0, 5), (997, 331, 3)])
@pytest.mark.parametrize("prefix", [1, 4])
def test_split_is_exact_complete_and_repeatable(spark, sizes, prefix):
    rows = [(f"{c}-{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "k STRING, label_id INT")
    split = corpus.stratified_split(df, "k", prefix=prefix)
    got = {r.k: r.split for r in split.collect()}
    assert set(got) == {k for k, _ in rows}
    assert got == {r.k: r.split for r in corpus.stratified_split(df.repartition(3), "k", prefix=5).collect()}
    total = len(rows)
    held = math.ceil(0.3 * total - 1e-9)
    count = lambda name: sum(v == name for v in got.values())
    assert count("test") == math.ceil(held / 2) and count("val") == held - count("test")
    for c, n in enumerate(sizes):
        train = sum(v == "train" for k, v in got.items() if k.startswith(f"{c}-"))
        assert abs(train - 0.7 * n) <= 1.0 + 0.3
    other = {r.k: r.split for r in corpus.stratified_split(df, "k", seed=7, prefix=prefix).collect()}
    assert total < 10 or other != got


def test_rows_of_a_repeated_key_stay_together(spark):
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "CAST(id % 2 AS INT) AS label_id")
    got = corpus.stratified_split(df, "k", prefix=1).groupBy("label_id", "k").agg({"split": "approx_count_distinct"})
    assert {r[2] for r in got.collect()} == {1}


def test_split_shuffles_only_counts_and_cut_buckets(spark):
    df = spark.range(1000).selectExpr("id AS k", "CAST(id % 3 AS INT) AS label_id", "repeat('x', 50) AS payload")
    plan = corpus.stratified_split(df, "k")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "payload" not in line
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
