"""Temperature, class-bias and threshold searches over labelled logits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.functions import double
from reviewflow.functions.decision import (
    CLASSES,
    DecisionConfig,
    first_max,
    names,
    with_decision,
    with_scores,
    with_softmax,
)
from reviewflow.operators.metrics import Tally, macro_f1

# The search grids.
BIAS_START, BIAS_STEP, BIAS_COUNT = -2.0, 0.25, 17
THRESHOLD_START, THRESHOLD_COUNT = 0.20, 13
THRESHOLD_STEP = (0.20 + 0.05) - 0.20  # a little under 0.05, as the grid is built by addition


def threshold_grid() -> list[float]:
    return [THRESHOLD_START + i * THRESHOLD_STEP for i in range(THRESHOLD_COUNT)]


def bias_at(place: str) -> str:
    return f"({double(BIAS_START)} + {place} * {double(BIAS_STEP)})"


def threshold_at(place: str) -> str:
    return f"({double(THRESHOLD_START)} + {place} * {double(THRESHOLD_STEP)})"


# --------------------------------------------------------------------------- loss
def _true_score(z: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(z))
    return f"CASE label_id {cases} END"


def with_nll(df: DataFrame, out: str = "nll", logits: str = "logits", temperature: float = 1.0) -> DataFrame:
    """Add the cross-entropy of each row."""
    z = names("_z")
    scored = with_scores(df, logits, temperature).selectExpr("*", f"greatest({', '.join(z)}) AS _top")
    rest = " + ".join(f"exp({x} - _top)" for x in z)
    return scored.selectExpr("*", f"_top + ln({rest}) - {_true_score(z)} AS {out}").drop("_top", *z)


def nll_by_temperature(df: DataFrame, temperatures: list[float], logits: str = "logits") -> DataFrame:
    """Mean cross-entropy at each temperature, all in one pass."""
    rows = df.select("label_id", logits)
    for i, t in enumerate(temperatures):
        rows = with_nll(rows, f"nll{i}", logits, t)
    means = rows.agg(*[F.expr(f"avg(nll{i}) AS t{i}") for i in range(len(temperatures))])
    listed = [f"named_struct('temperature', {double(t)}, 'nll', t{i})" for i, t in enumerate(temperatures)]
    return means.selectExpr(f"inline(array({', '.join(listed)}))")


def _slopes(rows: DataFrame, points: list[float]) -> list[tuple[float, float, float]]:
    """(b, slope, curvature) of the mean cross-entropy at each inverse temperature, in one pass."""
    raw = names("raw")
    mean = " + ".join(f"_p{i} * {x}" for i, x in enumerate(raw))
    square = " + ".join(f"_p{i} * {x} * {x}" for i, x in enumerate(raw))
    scaled = rows.selectExpr("*", f"explode(array({', '.join(double(b) for b in points)})) AS b")
    at_b = with_softmax(scaled.selectExpr("*", *[f"{x} * b AS _z{i}" for i, x in enumerate(raw)]))
    moments = at_b.selectExpr("b", f"{mean} AS m", f"{square} AS s", f"{_true_score(raw)} AS y")
    found = moments.groupBy("b").agg(F.expr("avg(m - y)").alias("slope"), F.expr("avg(s - m * m)").alias("curve"))
    return sorted((r.b, r.slope, r.curve) for r in found.collect())  # a row per point


def _cubic_root(a: tuple[float, float, float], c: tuple[float, float, float]) -> float:
    """Where the cubic with the slopes and curvatures of both ends crosses zero."""
    width, low, high = c[0] - a[0], 0.0, 1.0
    for _ in range(80):
        t = 0.5 * (low + high)
        value = (
            (1 + 2 * t) * (1 - t) ** 2 * a[1] + t * (1 - t) ** 2 * width * a[2]
            + t * t * (3 - 2 * t) * c[1] + t * t * (t - 1) * width * c[2]
        )
        low, high = (low, t) if value > 0 else (t, high)
    return a[0] + width * 0.5 * (low + high)


def fit_temperature(df: DataFrame, logits: str = "logits", points: int = 17) -> float:
    """Temperature with the lowest mean cross-entropy.

    The loss is convex in ``b = 1 / T``, so its slope rises with ``b``. Each pass
    takes slope and curvature at many ``b`` together: the first brackets the zero
    between powers of two, the second divides the bracket and interpolates in the
    cell that holds it, the third corrects the outcome by a Newton step. A best
    ``b`` that is not positive and finite is an error.
    """
    rows = with_scores(df.select("label_id", logits), logits, prefix="raw").drop(logits).persist()
    try:
        grid = [2.0 ** (k - points // 2) for k in range(points)]
        while True:
            found = _slopes(rows, grid)
            if not found or found[0][1] is None:
                raise ValueError("no rows to fit a temperature on")
            above = next((i for i, f in enumerate(found) if f[1] > 0), points)
            if 0 < above < points:
                break
            if not 1e-9 < grid[0] < grid[-1] < 1e9:
                raise ValueError("the best temperature is not positive and finite")
            grid = [b * grid[0] / grid[-1] if above == 0 else b * grid[-1] / grid[0] for b in grid]
        low, high = found[above - 1], found[above]
        while True:
            ratio = (high[0] / low[0]) ** (1 / (points + 1))
            found = [low, *_slopes(rows, [low[0] * ratio ** (k + 1) for k in range(points)]), high]
            above = next((i for i, f in enumerate(found) if f[1] > 0), len(found) - 1)
            low, high = found[max(above - 1, 0)], found[above]
            b = _cubic_root(low, high)
            ((_, slope, curve),) = _slopes(rows, [b])
            best = b - slope / curve if curve > 0 else b
            # Far from the cubic, or at the end of what doubles tell apart.
            if abs(best - b) <= 1e-6 * b or high[0] - low[0] <= 1e-12 * b:
                return 1.0 / min(max(best, low[0]), high[0])
    finally:
        rows.unpersist()


# --------------------------------------------------------------------------- grids
def _candidates(cells: DataFrame, count: int, dims: int, decision: str) -> DataFrame:
    """Macro F1 of every point of a ``count ** dims`` grid from counted cells.

    The cell table has a bounded number of rows, and each row meets the whole
    (fixed) grid in place, without a join. ``decision`` reads the grid
    positions ``i0``, ``i1``, ... of the first, second, ... class.
    """
    places = [
        f"CAST((grid_idx DIV {count ** (dims - 1 - k)}) % {count} AS INT) AS i{k}" for k in range(dims)
    ]
    t = Tally()
    return (
        cells.selectExpr("*", f"explode(sequence(0, {count**dims - 1})) AS grid_idx")
        .selectExpr("*", *places)
        .selectExpr("grid_idx", "label_id", "n", f"{decision} AS pred")
        .groupBy("grid_idx")
        .agg(*t.aggregates("label_id", "pred", "n"))
        .selectExpr("grid_idx", *places, t.macro_f1())
    )


def grid_class_bias(df: DataFrame, temperature: float, logits: str = "logits") -> DataFrame:
    """Macro F1 of all 17 x 17 biases for ``neg`` and ``neu`` (``pos`` fixed at 0).

    Grid biases are multiples of 1/4, so whether one biased score reaches
    another depends only on the score difference's quarter, unless it lies
    within rounding of a quarter. Rows are therefore counted per label and
    quarters of the three differences. A row at a quarter is decided at every
    grid point by its exact scores, and such rows are counted per label and
    sequence of decisions: a sequence is fixed by which biased score wins on
    either side of the quarters, so both kinds of cells are a few thousand for any
    number of rows and any precision of the logits.
    """
    rows = with_scores(df.select("label_id", logits), logits, temperature, "z").drop(logits)
    pairs = {"q01": ("z0", "z1"), "q02": ("z0", "z2"), "q12": ("z1", "z2")}
    limit = BIAS_COUNT  # beyond the largest difference of two biases
    slack = f"{double(1e-9 / BIAS_STEP)} * greatest(1.0D, abs(z0), abs(z1), abs(z2))"
    rows = rows.selectExpr(
        "*", f"{slack} AS slack", *[f"({a} - {b}) / {double(BIAS_STEP)} AS {q}" for q, (a, b) in pairs.items()]
    )
    at_quarter = " OR ".join(f"(abs({q} - rint({q})) <= slack AND abs({q}) <= {limit})" for q in pairs)
    rows = rows.selectExpr("*", f"coalesce({at_quarter}, true) AS exact")
    keys = [
        f"CASE WHEN NOT exact THEN floor(greatest(least({q}, {limit}.0D), -{limit + 1}.0D)) END AS {q}"
        for q in pairs
    ]
    by_score = first_max(
        f"(z0 + {bias_at(f'(g DIV {BIAS_COUNT})')})", f"(z1 + {bias_at(f'(g % {BIAS_COUNT})')})", "(z2 + 0.0D)"
    )
    sequence = f"array_join(transform(sequence(0, {BIAS_COUNT**2 - 1}), g -> CAST({by_score} AS STRING)), '')"
    cells = (
        rows.selectExpr("label_id", "exact", *keys, f"CASE WHEN exact THEN {sequence} END AS decided")
        .groupBy("label_id", "exact", *pairs, "decided")
        .agg(F.count("*").alias("n"))
    )
    zero = int(-BIAS_START / BIAS_STEP)  # grid position of a zero bias
    ge01, ge02, ge12 = "q01 >= i1 - i0", f"q02 >= {zero} - i0", f"q12 >= {zero} - i1"
    by_cell = f"CASE WHEN {ge01} AND {ge02} THEN 0 WHEN {ge12} THEN 1 ELSE 2 END"
    by_row = "CAST(substring(decided, grid_idx + 1, 1) AS INT)"
    found = _candidates(cells, BIAS_COUNT, 2, f"CASE WHEN exact THEN {by_row} ELSE {by_cell} END")
    return found.selectExpr(
        "grid_idx", f"{bias_at('i0')} AS bias_neg", f"{bias_at('i1')} AS bias_neu", "macro_f1"
    )


def grid_thresholds(df: DataFrame, temperature: float, logits: str = "logits") -> DataFrame:
    """Macro F1 of all 13 x 13 x 13 thresholds.

    A decision depends only on how many grid values each probability reaches
    and on the order of the probabilities, so rows are counted per label and
    these six values: a bounded table, whatever the number of rows.
    """
    rows = with_softmax(with_scores(df.select("label_id", logits), logits, temperature), prefix="p")
    reached = [
        " + ".join(f"IF({p} >= {double(t)}, 1, 0)" for t in threshold_grid()) + f" AS r{i}"
        for i, p in enumerate(names("p"))
    ]
    order = ["p0 >= p1 AS ge01", "p0 >= p2 AS ge02", "p1 >= p2 AS ge12"]
    cells = (
        rows.selectExpr("label_id", *reached, *order)
        .groupBy("label_id", "r0", "r1", "r2", "ge01", "ge02", "ge12")
        .agg(F.count("*").alias("n"))
    )
    none = "(r0 <= i0 AND r1 <= i1 AND r2 <= i2)"
    in0, in1, in2 = (f"(r{i} > i{i} OR {none})" for i in CLASSES)
    decision = (
        f"CASE WHEN {in0} AND (NOT {in1} OR ge01) AND (NOT {in2} OR ge02) THEN 0 "
        f"WHEN {in1} AND (NOT {in2} OR ge12) THEN 1 ELSE 2 END"
    )
    found = _candidates(cells, THRESHOLD_COUNT, 3, decision)
    return found.selectExpr(
        "grid_idx",
        f"{threshold_at('i0')} AS threshold_neg",
        f"{threshold_at('i1')} AS threshold_neu",
        f"{threshold_at('i2')} AS threshold_pos",
        "macro_f1",
    )


def best_candidate(found: DataFrame) -> DataFrame:
    """The highest macro F1; among equals the first in grid order."""
    return found.orderBy(F.desc("macro_f1"), F.asc("grid_idx")).limit(1)


# --------------------------------------------------------------------------- selection
def compare_strategies(validation: DataFrame, temperature: float, logits: str = "logits") -> DataFrame:
    """The best configuration of each strategy on the validation rows."""
    none = "CAST(NULL AS ARRAY<DOUBLE>)"
    decided = with_decision(validation, DecisionConfig(temperature=temperature), logits)
    argmax = macro_f1(decided).selectExpr(
        "0 AS place", "'argmax' AS strategy", f"{none} AS bias", f"{none} AS thresholds", "macro_f1"
    )
    bias = best_candidate(grid_class_bias(validation, temperature, logits)).selectExpr(
        "1 AS place", "'class_bias' AS strategy", "array(bias_neg, bias_neu, 0.0D) AS bias",
        f"{none} AS thresholds", "macro_f1",
    )
    thresholds = best_candidate(grid_thresholds(validation, temperature, logits)).selectExpr(
        "2 AS place", "'thresholds' AS strategy", f"{none} AS bias",
        "array(threshold_neg, threshold_neu, threshold_pos) AS thresholds", "macro_f1",
    )
    return argmax.unionByName(bias).unionByName(thresholds)


def select_strategy(compared: DataFrame) -> DataFrame:
    """The best strategy; among equals the earlier one."""
    return compared.orderBy(F.desc("macro_f1"), F.asc("place")).limit(1)


def heldout_gain(test: DataFrame, config: DecisionConfig, logits: str = "logits") -> DataFrame:
    """Macro F1 of the selected config and of plain argmax on test rows, in one pass."""
    winner, plain = Tally("winner_"), Tally("plain_")
    decided = with_decision(test.select("label_id", logits), config, logits, "winner")
    decided = with_decision(decided, DecisionConfig(), logits, "plain")
    tallied = decided.agg(
        *winner.aggregates("label_id", "winner"), *plain.aggregates("label_id", "plain")
    )
    scored = tallied.selectExpr(winner.macro_f1("test_macro_f1"), plain.macro_f1("baseline_test_macro_f1"))
    return scored.selectExpr("*", "test_macro_f1 - baseline_test_macro_f1 AS gain")


def calibrate(validation: DataFrame, test: DataFrame, logits: str = "logits") -> tuple[DecisionConfig, DataFrame]:
    """Fit and select on validation, evaluate once on test.

    Returns the selected config and a one-row report: temperature, strategy,
    parameters, validation and test scores.
    """
    temperature = fit_temperature(validation, logits)
    best = select_strategy(compare_strategies(validation, temperature, logits)).first()
    config = DecisionConfig(
        temperature=temperature,
        strategy=best.strategy,
        bias=tuple(best.bias) if best.bias else None,
        thresholds=tuple(best.thresholds) if best.thresholds else None,
    )
    listed = lambda v: f"array({', '.join(map(double, v))})" if v else "CAST(NULL AS ARRAY<DOUBLE>)"
    report = heldout_gain(test, config, logits).selectExpr(
        f"{double(temperature)} AS temperature",
        f"'{config.strategy}' AS strategy",
        f"named_struct('bias', {listed(config.bias)}, 'thresholds', {listed(config.thresholds)}) AS params",
        f"{double(best.macro_f1)} AS val_macro_f1",
        "test_macro_f1",
        "baseline_test_macro_f1",
        "gain",
    )
    return config, report
