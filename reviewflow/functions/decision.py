"""Calibrated decisions over three class scores.

The functions add their columns in steps, each step a projection of its own:
written as one expression, every use of a score would repeat all that leads to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from reviewflow.functions import double
from reviewflow.schema import LABELS, NUM_LABELS, STRATEGIES

CLASSES = range(NUM_LABELS)


@dataclass(frozen=True)
class DecisionConfig:
    """Serving decision: a temperature and one of three strategies."""

    temperature: float = 1.0
    strategy: str = "argmax"
    bias: tuple[float, ...] | None = None
    thresholds: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        if not (math.isfinite(self.temperature) and self.temperature > 0):
            raise ValueError("temperature must be positive and finite")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        needed = {"class_bias": self.bias, "thresholds": self.thresholds}
        if self.strategy in needed and len(needed[self.strategy] or ()) != NUM_LABELS:
            raise ValueError(f"{self.strategy} needs {NUM_LABELS} values")


def first_max(a: str, b: str, c: str) -> str:
    """Index of the largest score; ties go to the lower index."""
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def names(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in CLASSES]


def with_scores(df: DataFrame, logits: str = "logits", temperature: float = 1.0, prefix: str = "_z") -> DataFrame:
    """Add the three scores ``logits / temperature``; any other number of logits is an error."""
    checked = (
        f"CASE WHEN {logits} IS NULL OR size({logits}) = {NUM_LABELS} THEN {logits} "
        f"ELSE raise_error(concat('expected {NUM_LABELS} logits, got ', size({logits}))) END AS _logits"
    )
    scale = "" if temperature == 1.0 else f" / {double(temperature)}"
    scores = [f"CAST(_logits[{i}] AS DOUBLE){scale} AS {n}" for i, n in enumerate(names(prefix))]
    return df.selectExpr("*", checked).selectExpr("*", *scores).drop("_logits")


def with_softmax(df: DataFrame, scores: str = "_z", prefix: str = "_p") -> DataFrame:
    """Add the probabilities of three score columns; shifted by the maximum to stay finite."""
    z = names(scores)
    top = df.selectExpr("*", f"greatest({', '.join(z)}) AS _top")
    raised = top.selectExpr("*", *[f"exp({x} - _top) AS _e{i}" for i, x in enumerate(z)])
    summed = raised.selectExpr("*", "_e0 + _e1 + _e2 AS _total")
    shares = summed.selectExpr("*", *[f"_e{i} / _total AS {n}" for i, n in enumerate(names(prefix))])
    return shares.drop("_top", "_total", "_e0", "_e1", "_e2")


def class_bias(z: list[str], bias) -> str:
    return first_max(*[f"({x} + {double(b)})" for x, b in zip(z, bias)])


def thresholded(p: list[str], thresholds) -> str:
    """Most probable class among those reaching their threshold, else the most probable."""
    passes = [f"{x} >= {double(t)}" for x, t in zip(p, thresholds)]
    masked = [f"IF({ok}, {x}, -1.0D)" for ok, x in zip(passes, p)]
    return f"CASE WHEN {' OR '.join(passes)} THEN {first_max(*masked)} ELSE {first_max(*p)} END"


def decision(config: DecisionConfig, z: list[str], p: list[str]) -> str:
    """Label id from calibrated scores and probabilities under the config's strategy."""
    if config.strategy == "class_bias":
        return class_bias(z, config.bias)
    if config.strategy == "thresholds":
        return thresholded(p, config.thresholds)
    return first_max(*z)


def with_decision(df: DataFrame, config: DecisionConfig, logits: str = "logits", out: str = "pred") -> DataFrame:
    """Add the decided label id."""
    df = with_scores(df, logits, config.temperature)
    if config.strategy == "thresholds":
        df = with_softmax(df)
    decided = df.selectExpr("*", f"{decision(config, names('_z'), names('_p'))} AS {out}")
    return decided.drop(*names("_z"), *names("_p"))


def label_name(label_id: str) -> str:
    return f"element_at(array({', '.join(repr(x) for x in LABELS)}), {label_id} + 1)"


def chosen_probability(probs: str, label_id: str) -> str:
    """Confidence: the probability of the chosen class, not the largest one."""
    cases = " ".join(f"WHEN {i} THEN {probs}.{name}" for i, name in enumerate(LABELS))
    return f"CASE {label_id} {cases} END"


def add_prediction(df: DataFrame, config: DecisionConfig, logits: str = "logits") -> DataFrame:
    """Add ``probabilities, label_id, sentiment, confidence`` next to the logits.

    The probabilities are calibrated but never biased, so the confidence of a
    biased decision can be lower than the largest probability.
    """
    df = with_softmax(with_scores(df, logits, config.temperature))
    z, p = names("_z"), names("_p")
    probs = ", ".join(f"'{n}', {x}" for x, n in zip(p, LABELS))
    decided = df.selectExpr(
        "*", f"named_struct({probs}) AS probabilities", f"{decision(config, z, p)} AS label_id"
    )
    return decided.selectExpr(
        "*",
        f"{label_name('label_id')} AS sentiment",
        f"{chosen_probability('probabilities', 'label_id')} AS confidence",
    ).drop(*z, *p)


def class_permutation(external_names: dict[int, str], to_label: dict[str, str]) -> list[int]:
    """External output position of each class in canonical order."""
    position = {to_label[name]: i for i, name in external_names.items()}
    return [position[label] for label in LABELS]
