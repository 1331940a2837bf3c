"""Decision math against numpy, and the grids against direct evaluation."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from reviewflow.functions import decision
from reviewflow.functions.decision import DecisionConfig
from reviewflow.operators import calibrate, ensemble, metrics

BIASES = np.arange(-2.0, 2.01, 0.25)
LEVELS = np.arange(0.20, 0.81, 0.05)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def frame(spark, logits, labels=None):
    labels = [0] * len(logits) if labels is None else labels
    rows = [(i, [float(x) for x in z], int(y)) for i, (z, y) in enumerate(zip(logits, labels))]
    return spark.createDataFrame(rows, "row_key BIGINT, logits ARRAY<DOUBLE>, label_id INT")


def f1_macro(y, p):
    scores = []
    for c in range(3):
        true, pred = np.sum(y == c), np.sum(p == c)
        if true + pred:
            scores.append(2 * np.sum((y == c) & (p == c)) / (true + pred))
    return float(np.mean(scores))


def expected(z, config):
    """Row by row: the best class among those allowed, the first of equals."""
    out = []
    for row in np.asarray(z, dtype=float) / config.temperature:
        score, allowed = row, range(3)
        if config.strategy == "class_bias":
            score = [row[c] + config.bias[c] for c in range(3)]
        if config.strategy == "thresholds":
            score = softmax(row[None, :])[0]
            allowed = [c for c in range(3) if score[c] >= config.thresholds[c]] or range(3)
        out.append(min(allowed, key=lambda c: (-score[c], c)))
    return np.array(out)


EDGES = [
    [0, 0, 0], [1, 1, 0], [0, 1, 1], [1, 0, 1], [1000, -1000, 0], [-1000, -1000, -1000], [2, 1.9, 0],
    [0, 0.25, 0.5], [0.75, 0.5, 0.25], [-0.25, 0, 0.25],
]
CONFIGS = [
    DecisionConfig(),
    DecisionConfig(1.3),
    DecisionConfig(0.7, "class_bias", bias=(-1.5, -0.25, 0.0)),
    DecisionConfig(1.0, "class_bias", bias=(0.25, 0.0, 0.0)),
    DecisionConfig(1.0, "thresholds", thresholds=(0.5, 0.4, 0.6)),
    DecisionConfig(1.0, "thresholds", thresholds=(1 / 3, 1 / 3, 1 / 3)),
    DecisionConfig(2.0, "thresholds", thresholds=(0.9, 0.9, 0.9)),
]


@pytest.mark.parametrize("config", CONFIGS, ids=lambda c: f"{c.strategy}-{c.temperature}")
def test_decisions_equal_numpy(spark, config):
    z = np.array([*EDGES, *np.random.default_rng(1).normal(0, 2, (200, 3))], dtype=float)
    rows = decision.add_prediction(frame(spark, z).drop("label_id"), config).orderBy("row_key").collect()
    assert [r.label_id for r in rows] == expected(z, config).tolist()
    p = softmax(z / config.temperature)
    got = np.array([tuple(r.probabilities) for r in rows])
    assert np.allclose(got, p, rtol=1e-12, atol=1e-15) and np.isfinite(got).all()
    for r in rows:
        assert r.sentiment == ("neg", "neu", "pos")[r.label_id]
        assert r.confidence == r.probabilities[r.label_id]


def test_bias_can_choose_a_less_probable_class(spark):
    config = DecisionConfig(1.0, "class_bias", bias=(0.5, 0.0, 0.0))
    row = decision.add_prediction(frame(spark, [[1.0, 1.2, 0.0]]).drop("label_id"), config).first()
    assert row.sentiment == "neg" and row.confidence < max(row.probabilities)


def test_config_and_shape_errors(spark):
    for bad in ({"temperature": 0.0}, {"temperature": float("nan")}, {"strategy": "best"},
                {"strategy": "class_bias"}, {"strategy": "thresholds", "thresholds": (0.5,)}):
        with pytest.raises(ValueError):
            DecisionConfig(**bad)
    df = spark.createDataFrame([(1, [0.1, 0.2])], "row_key INT, logits ARRAY<DOUBLE>")
    with pytest.raises(PySparkException, match="expected 3 logits, got 2"):
        decision.with_decision(df, DecisionConfig()).collect()


def test_permutation_follows_names():
    names = {0: "neutral", 1: "positive", 2: "negative"}
    assert decision.class_permutation(names, {"neutral": "neu", "positive": "pos", "negative": "neg"}) == [2, 0, 1]


def sample(kind):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 300)
    if kind == "smooth":
        z = rng.normal(0, 1.5, (300, 3)) + 1.5 * np.eye(3)[y]
    elif kind == "quarters":  # every score difference lies exactly on a grid step
        z = rng.integers(-12, 13, (300, 3)) / 4.0 + np.eye(3)[y]
    elif kind == "two classes":
        y = y % 2
        z = rng.normal(0, 1.0, (300, 3)) + 1.5 * np.eye(3)[y] - [0, 0, 9]
    else:  # large scores, rounding near the steps
        z = rng.integers(-8, 9, (300, 3)) / 4.0 * (1 + 1e-15) + 1e5
    return z, y


KINDS = ["smooth", "quarters", "two classes", "large"]


@pytest.mark.parametrize("kind", KINDS)
def test_bias_grid_equals_direct_evaluation(spark, kind):
    z, y = sample(kind)
    t = 1.0 if kind == "quarters" else 1.3
    got = {r.grid_idx: r for r in calibrate.grid_class_bias(frame(spark, z, y), t).collect()}
    assert len(got) == 289
    for i, b0 in enumerate(BIASES):
        for j, b1 in enumerate(BIASES):
            row = got[i * 17 + j]
            assert (row.bias_neg, row.bias_neu) == (b0, b1)
            assert row.macro_f1 == pytest.approx(f1_macro(y, (z / t + [b0, b1, 0.0]).argmax(axis=1)), abs=1e-12)


@pytest.mark.parametrize("kind", ["smooth", "quarters", "two classes"])
def test_threshold_grid_equals_direct_evaluation(spark, kind):
    z, y = sample(kind)
    p = softmax(z)
    got = {r.grid_idx: r for r in calibrate.grid_thresholds(frame(spark, z, y), 1.0).collect()}
    assert len(got) == 2197
    for idx in range(0, 2197, 7):
        t = LEVELS[[idx // 169, idx // 13 % 13, idx % 13]]
        row = got[idx]
        assert (row.threshold_neg, row.threshold_neu, row.threshold_pos) == tuple(t)
        passes = p >= t
        pred = np.where(passes.any(axis=1), np.where(passes, p, -1).argmax(axis=1), p.argmax(axis=1))
        assert row.macro_f1 == pytest.approx(f1_macro(y, pred), abs=1e-12)


def test_threshold_is_reached_by_an_equal_probability(spark):
    p = np.array([[0.25, 0.25, 0.5]])
    got = {r.grid_idx: r.macro_f1 for r in calibrate.grid_thresholds(frame(spark, np.log(p), [0]), 1.0).collect()}
    exact = softmax(np.log(p))[0]
    for idx, f in got.items():
        t = LEVELS[[idx // 169, idx // 13 % 13, idx % 13]]
        masked = np.where(exact >= t, exact, -1.0)
        assert f == (1.0 if (exact >= t).any() and masked.argmax() == 0 else 0.0)


def test_first_of_equal_candidates_wins(spark):
    found = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.4)], "grid_idx INT, macro_f1 DOUBLE")
    assert calibrate.best_candidate(found).first().grid_idx == 1
    tied = spark.createDataFrame([(2, "c", 0.5), (0, "a", 0.5), (1, "b", 0.5)], "place INT, strategy STRING, macro_f1 DOUBLE")
    assert calibrate.select_strategy(tied).first().strategy == "a"
    swept = spark.createDataFrame([(5, 0.25, 0.5), (4, 0.2, 0.5)], "grid_idx INT, weight DOUBLE, macro_f1 DOUBLE")
    assert ensemble.best_weight(swept).first().grid_idx == 4


def test_temperature_minimises_the_loss(spark):
    z, y = sample("smooth")
    df = frame(spark, z, y)
    t = calibrate.fit_temperature(df)

    def loss(t):
        p = softmax(z / t)
        return -np.log(p[np.arange(len(y)), y]).mean()

    grid = np.linspace(t * 0.98, t * 1.02, 401)
    assert abs(grid[np.argmin([loss(x) for x in grid])] - t) < t * 2e-4
    got = {r.temperature: r.nll for r in calibrate.nll_by_temperature(df, [t, 2.0]).collect()}
    assert got[t] == pytest.approx(loss(t), abs=1e-12) and got[2.0] == pytest.approx(loss(2.0), abs=1e-12)


@pytest.mark.parametrize("scale", [1e-4, 0.3, 1.0, 40.0, 3000.0])
def test_temperature_in_few_passes(spark, scale):
    z, y = sample("smooth")
    z = np.asarray(z) * scale

    def slope(b):
        p = softmax(z * b)
        return ((p * z).sum(axis=1) - z[np.arange(len(y)), y]).mean()

    low, high = 1e-9, 1e9
    for _ in range(200):
        middle = (low * high) ** 0.5
        low, high = (low, middle) if slope(middle) > 0 else (middle, high)
    spark.sparkContext.setJobGroup(f"fit-{scale}", "fit")
    try:
        t = calibrate.fit_temperature(frame(spark, z.tolist(), y))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{scale}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert t == pytest.approx(1 / low, rel=1e-9)
    assert 0 < len(jobs) <= (8 if 0.01 < scale < 100 else 12)  # a pass is a job or two


def test_temperature_without_a_positive_optimum_is_an_error(spark):
    # Truth is always the least likely class: the best inverse temperature is not positive.
    with pytest.raises(ValueError, match="not positive"):
        calibrate.fit_temperature(frame(spark, [[2.0, 0.0, 1.0], [0.0, 2.0, 1.0]], [1, 0]))
    with pytest.raises(ValueError, match="no rows"):
        calibrate.fit_temperature(frame(spark, [[0.0, 1.0, 2.0]]).where("false"))


def test_metrics_of_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label_id INT, pred INT")
    m = metrics.eval_metrics(df).first()
    assert m.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2) and m.accuracy == 0.75 and m.f1_pos == 0.0
    report = {r["class"]: r for r in metrics.per_class_report(df).collect()}
    assert report["pos"].support == 0 and report["pos"].f1 == 0.0
    assert report["macro avg"].f1 == pytest.approx(m.macro_f1)
    assert report["weighted avg"].f1 == pytest.approx((2 / 3 * 2 + 4 / 5 * 2) / 4)
    empty = metrics.eval_metrics(df.where("false")).first()
    assert empty.macro_f1 is None and empty.accuracy is None


def test_calibration_report_and_ensemble(spark):
    z, y = sample("smooth")
    config, report = calibrate.calibrate(frame(spark, z[:150], y[:150]), frame(spark, z[150:], y[150:]))
    row = report.first()
    assert row.strategy == config.strategy and row.temperature == config.temperature
    assert row.test_macro_f1 == pytest.approx(f1_macro(y[150:], expected(z[150:], config)), abs=1e-12)
    assert row.baseline_test_macro_f1 == pytest.approx(f1_macro(y[150:], z[150:].argmax(axis=1)), abs=1e-12)

    other = np.random.default_rng(3).normal(0, 1, z.shape) + np.eye(3)[y]
    order = [2, 0, 1]
    external = np.empty_like(other)
    external[:, order] = other
    al = ensemble.aligned_probabilities(frame(spark, z, y), frame(spark, external, y), order)
    a, b = softmax(z), softmax(other)
    weights = np.arange(0.0, 1.01, 0.05)
    best = [f1_macro(y, (w * a + (1 - w) * b).argmax(axis=1)) for w in weights]
    got = [r.macro_f1 for r in ensemble.weight_sweep(al).orderBy("grid_idx").collect()]
    assert np.allclose(got, best, atol=1e-12)
    nested = ensemble.evaluate(al, al, "other", [2, 0, 1]).first()
    assert nested.external_model.name == "other" and nested.external_model.permutation == [2, 0, 1]
    assert nested.ensemble.best_weight_own == weights[int(np.argmax(best))]
    pa, pb = a.argmax(axis=1), b.argmax(axis=1)
    assert nested.diagnostics.disagreement_rate == pytest.approx((pa != pb).mean())
    assert nested.diagnostics.both_wrong_rate == pytest.approx(((pa != y) & (pb != y)).mean())
    assert len(nested.diagnostics.weight_sweep_val) == 21


def test_bias_cells_stay_few_on_low_precision_logits(spark, monkeypatch):
    """Scores in steps of 1/256 often lie on a quarter; the grid equals direct evaluation."""
    rng = np.random.default_rng(5)
    z = rng.integers(-512, 512, size=(4000, 3)) / 256.0
    y = rng.integers(0, 3, size=len(z))
    sizes, candidates = [], calibrate._candidates

    def counted(cells, *rest):
        sizes.append(cells.count())
        return candidates(cells, *rest)

    monkeypatch.setattr(calibrate, "_candidates", counted)
    found = calibrate.grid_class_bias(frame(spark, z, y), 1.0).collect()
    assert len(found) == 289 and sizes[0] < 2500
    for r in found[::37]:
        assert np.isclose(r.macro_f1, f1_macro(y, (z + np.array([r.bias_neg, r.bias_neu, 0.0])).argmax(axis=1)))


def test_unmatched_or_repeated_rows_of_two_models_end_the_job(spark):
    own, other = frame(spark, [[0, 1, 2]] * 50), frame(spark, [[2, 1, 0]] * 40)
    for broken in (other, other.union(frame(spark, [[2, 1, 0]] * 50).where("row_key >= 39"))):
        with pytest.raises(PySparkException, match="own and"):
            ensemble.aligned_probabilities(own, broken, [0, 1, 2]).collect()
    assert ensemble.aligned_probabilities(own, frame(spark, [[2, 1, 0]] * 50), [2, 1, 0]).count() == 50
