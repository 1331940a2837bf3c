"""Classification metrics as conditional sums: one pass, one small shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.functions import double
from reviewflow.functions.decision import CLASSES
from reviewflow.schema import LABELS


def confusion(df: DataFrame, label: str = "label_id", predicted: str = "pred") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def _ratio(a: str, b: str) -> str:
    """``a / b`` with an empty denominator counting as zero."""
    return f"IF(({b}) > 0, CAST({a} AS DOUBLE) / ({b}), 0.0D)"


@dataclass(frozen=True)
class Tally:
    """Hits, true rows and predicted rows of each class, and the metrics they give.

    ``aggregates`` are computed with ``agg``; the other methods are expressions
    over their columns. Several models are tallied in one ``agg`` under
    different prefixes.
    """

    prefix: str = ""

    def aggregates(self, label: str, predicted: str, n: str = "1") -> list[Column]:
        conditions = {}
        for c in CLASSES:
            conditions[f"hit{c}"] = f"{label} = {c} AND {predicted} = {c}"
            conditions[f"true{c}"] = f"{label} = {c}"
            conditions[f"pred{c}"] = f"{predicted} = {c}"
        return [
            F.expr(f"coalesce(sum(CASE WHEN {cond} THEN {n} END), 0) AS {self.prefix}{name}")
            for name, cond in conditions.items()
        ]

    def _col(self, name: str, c: int) -> str:
        return f"{self.prefix}{name}{c}"

    def _seen(self, c: int) -> str:
        return f"({self._col('true', c)} + {self._col('pred', c)})"

    def precision(self, c: int) -> str:
        return _ratio(self._col("hit", c), self._col("pred", c))

    def recall(self, c: int) -> str:
        return _ratio(self._col("hit", c), self._col("true", c))

    def f1(self, c: int) -> str:
        return _ratio(f"(2 * {self._col('hit', c)})", self._seen(c))

    def support(self) -> str:
        return "(" + " + ".join(self._col("true", c) for c in CLASSES) + ")"

    def accuracy(self) -> str:
        hits = " + ".join(self._col("hit", c) for c in CLASSES)
        return f"CASE WHEN {self.support()} > 0 THEN CAST({hits} AS DOUBLE) / {self.support()} END"

    def macro(self, metric) -> str:
        """Mean over the classes present in truth or prediction."""
        total = " + ".join(f"IF({self._seen(c)} > 0, {metric(c)}, 0.0D)" for c in CLASSES)
        count = "(" + " + ".join(f"IF({self._seen(c)} > 0, 1, 0)" for c in CLASSES) + ")"
        return f"CASE WHEN {count} > 0 THEN ({total}) / {count} END"

    def weighted(self, metric) -> str:
        """Mean weighted by the true rows of each class."""
        total = " + ".join(f"{metric(c)} * {self._col('true', c)}" for c in CLASSES)
        return _ratio(f"({total})", self.support())

    def macro_f1(self, alias: str = "macro_f1") -> str:
        return f"{self.macro(self.f1)} AS {alias}"

    def class_f1(self, alias: str = "f1_") -> list[str]:
        return [f"{self.f1(c)} AS {alias}{LABELS[c]}" for c in CLASSES]


def macro_f1(df: DataFrame, label: str = "label_id", predicted: str = "pred") -> DataFrame:
    """One row with ``macro_f1``."""
    t = Tally()
    return df.agg(*t.aggregates(label, predicted)).selectExpr(t.macro_f1())


def eval_metrics(df: DataFrame, label: str = "label_id", predicted: str = "pred") -> DataFrame:
    """One row: macro F1, accuracy, macro precision and recall, F1 of each class."""
    t = Tally()
    return df.agg(*t.aggregates(label, predicted)).selectExpr(
        t.macro_f1(),
        f"{t.accuracy()} AS accuracy",
        f"{t.macro(t.precision)} AS macro_precision",
        f"{t.macro(t.recall)} AS macro_recall",
        *t.class_f1(),
    )


def per_class_report(df: DataFrame, label: str = "label_id", predicted: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support: three classes, then macro and weighted averages.

    A class without rows is listed with zeros and left out of the macro average.
    """
    t = Tally()

    def line(name: str, of, support: str) -> str:
        return (
            f"named_struct('class', '{name}', 'precision', {of(t.precision)}, 'recall', {of(t.recall)}, "
            f"'f1', {of(t.f1)}, 'support', {support})"
        )

    lines = [line(LABELS[c], lambda m, c=c: m(c), f"true{c}") for c in CLASSES]
    lines.append(line("macro avg", t.macro, t.support()))
    lines.append(line("weighted avg", t.weighted, t.support()))
    return df.agg(*t.aggregates(label, predicted)).selectExpr(f"inline(array({', '.join(lines)}))")


def weighted_cross_entropy(weights: dict[int, float], nll: str = "nll", label: str = "label_id") -> Column:
    """Class-weighted mean of a row loss, as one aggregate."""
    w = " ".join(f"WHEN {c} THEN {double(x)}" for c, x in weights.items())
    w = f"CASE {label} {w} END"
    return F.expr(f"sum({w} * {nll}) / sum({w})")
