"""Mixing two models: aligned probabilities, weight sweep, diagnostics, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.functions import double, quoted
from reviewflow.functions.decision import first_max, names, with_scores, with_softmax
from reviewflow.operators.metrics import Tally
from reviewflow.operators.rules import require

# The weight grid 0, 0.05, ..., 1.
WEIGHT_STEP, WEIGHT_COUNT = 0.05, 21

OWN, EXTERNAL = names("a"), names("b")


def aligned_probabilities(
    own: DataFrame, external: DataFrame, permutation: list[int], key: str = "row_key"
) -> DataFrame:
    """Both models' uncalibrated probabilities per row, in canonical class order.

    Each key must be in both tables exactly once; any other key ends the job. The
    check is part of the one aggregation that brings the two sides together.
    """
    a = with_softmax(with_scores(own.select(key, "label_id", "logits")), prefix="a")
    b = with_softmax(with_scores(external.select(key, "logits")), prefix="x")
    left = a.selectExpr(key, "label_id", *OWN, "1 AS _own", "0 AS _external")
    right = b.selectExpr(key, *[f"x{p} AS {n}" for p, n in zip(permutation, EXTERNAL)], "0 AS _own", "1 AS _external")
    values = ["label_id", *OWN, *EXTERNAL]
    both = left.unionByName(right, allowMissingColumns=True).groupBy(key).agg(
        F.sum("_own").alias("_own"), F.sum("_external").alias("_external"), *[F.max(v).alias(v) for v in values]
    )
    message = f"concat('row ', CAST({key} AS STRING), ': ', _own, ' own and ', _external, ' external scores')"
    return require(both, "_own != 1 OR _external != 1", message).select(key, *values)


def mix(weight: float) -> list[str]:
    w = double(weight)
    return [f"({w} * {x} + (1.0D - {w}) * {y})" for x, y in zip(OWN, EXTERNAL)]


def weight_sweep(aligned: DataFrame) -> DataFrame:
    """Macro F1 of each of the 21 weights.

    Along the weights a row's label changes at most twice, so the rows share
    few label sequences; these are counted first and expanded afterwards.
    """
    labels = ", ".join(f"CAST({first_max(*mix(i * WEIGHT_STEP))} AS STRING)" for i in range(WEIGHT_COUNT))
    counted = (
        aligned.selectExpr("label_id", f"concat({labels}) AS sequence")
        .groupBy("label_id", "sequence")
        .agg(F.count("*").alias("n"))
    )
    t = Tally()
    return (
        counted.selectExpr("*", f"explode(sequence(0, {WEIGHT_COUNT - 1})) AS grid_idx")
        .selectExpr("*", "CAST(substring(sequence, grid_idx + 1, 1) AS INT) AS pred")
        .groupBy("grid_idx")
        .agg(*t.aggregates("label_id", "pred", "n"))
        .selectExpr("grid_idx", f"grid_idx * {double(WEIGHT_STEP)} AS weight", t.macro_f1())
    )


def best_weight(swept: DataFrame) -> DataFrame:
    """The weight with the highest macro F1; among equals the lower weight."""
    return swept.orderBy(F.desc("macro_f1"), F.asc("grid_idx")).limit(1)


def _diagnostics() -> list[Column]:
    a, b = first_max(*OWN), first_max(*EXTERNAL)
    return [
        F.expr(f"avg(IF({a} != {b}, 1.0D, 0.0D)) AS disagreement_rate"),
        F.expr(f"avg(IF({a} != label_id AND {b} != label_id, 1.0D, 0.0D)) AS both_wrong_rate"),
    ]


def diagnostics(aligned: DataFrame) -> DataFrame:
    """Share of rows where the models differ and where both are wrong."""
    return aligned.agg(*_diagnostics())


def evaluate(
    validation: DataFrame, test: DataFrame, external_name: str, permutation: list[int]
) -> DataFrame:
    """Choose the weight on validation, evaluate on test: one nested report row.

    The test rows are read once for both models, the mix and the diagnostics. The
    report names the external model and the permutation of its classes.
    """
    order = ", ".join(map(str, permutation))
    swept = weight_sweep(validation).orderBy("grid_idx").collect()  # 21 rows
    best = max(swept, key=lambda r: (r.macro_f1, -r.grid_idx))
    own, external, mixed = Tally("own_"), Tally("external_"), Tally("ensemble_")
    decided = test.selectExpr(
        "*", f"{first_max(*OWN)} AS _own", f"{first_max(*EXTERNAL)} AS _external",
        f"{first_max(*mix(best.weight))} AS _mixed",
    )
    tallied = decided.agg(
        *own.aggregates("label_id", "_own"),
        *external.aggregates("label_id", "_external"),
        *mixed.aggregates("label_id", "_mixed"),
        *_diagnostics(),
    )

    def tested(t: Tally) -> str:
        return f"{t.macro_f1('test_macro_f1')}, struct({', '.join(t.class_f1(''))}) AS test_per_class_f1"

    sweep = ", ".join(
        f"named_struct('weight', {double(round(r.weight, 2))}, 'macro_f1', {double(r.macro_f1)})" for r in swept
    )
    gain = f"{mixed.macro(mixed.f1)} - {own.macro(own.f1)} AS gain_over_own"
    return tallied.selectExpr(
        f"struct({tested(own)}) AS own_model",
        f"struct({quoted(external_name)} AS name, array({order}) AS permutation, {tested(external)}) AS external_model",
        f"struct({double(best.weight)} AS best_weight_own, {double(best.macro_f1)} AS val_macro_f1, "
        f"{tested(mixed)}, {gain}) AS ensemble",
        f"struct(disagreement_rate, both_wrong_rate, array({sweep}) AS weight_sweep_val) AS diagnostics",
    )
