"""Distributed batch scoring with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.functions.decision import DecisionConfig, add_prediction
from reviewflow.functions.text import is_nonblank
from reviewflow.schema import NUM_LABELS
from reviewflow.session import ship_package

BATCH_SIZE = 16


class Scorer(Protocol):
    """A loaded model: one row of three logits per text."""

    def logits(self, texts: Sequence[str]) -> np.ndarray: ...


_loaded: dict[str, Scorer] = {}


def _load(name: str, factory: Callable[[], Scorer]) -> Scorer:
    """One model per Python worker, kept across its tasks."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def score_texts(model: Scorer, texts: list[str], batch_size: int) -> np.ndarray:
    """Logits of texts in batches of similar length, in input order."""
    by_length = np.argsort([len(t) for t in texts], kind="stable")
    out = np.empty((len(texts), NUM_LABELS), dtype=np.float64)
    for start in range(0, len(texts), batch_size):
        chosen = by_length[start : start + batch_size]
        part = np.asarray(model.logits([texts[i] for i in chosen]), dtype=np.float64)
        if part.shape != (len(chosen), NUM_LABELS):
            raise RuntimeError(f"the model gave scores of shape {part.shape} for {len(chosen)} texts")
        out[chosen] = part
    return out


def scorer_udf(name: str, factory: Callable[[], Scorer], batch_size: int = BATCH_SIZE):
    """Column function from text to logits; a NULL text gives NULL.

    ``name`` must identify the model and its version. ``factory`` runs on the
    executors, once per Python worker.
    """
    if batch_size <= 0:
        raise ValueError(f"a batch needs at least one text, not {batch_size}")
    ship_package(SparkSession.active())

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            present = np.flatnonzero(texts.notna())
            rows: list = [None] * len(texts)
            if len(present):
                model = model or _load(name, factory)
                scored = score_texts(model, texts.iloc[present].tolist(), batch_size)
                for place, row in zip(present, scored):
                    rows[place] = row
            yield pd.Series(rows, dtype=object)

    return logits


def score(df: DataFrame, udf, text: str = "text", out: str = "logits") -> DataFrame:
    """Add logits; a blank text is an error."""
    blank = "raise_error('text to score must be a non-blank string')"
    return df.withColumn(out, udf(F.expr(f"CASE WHEN {is_nonblank(text)} THEN {text} ELSE {blank} END")))


def predict(df: DataFrame, udf, config: DecisionConfig, text: str = "text") -> DataFrame:
    """Score texts and add the decided prediction."""
    return add_prediction(score(df, udf, text), config)


def predict_events(parsed: DataFrame, udf, config: DecisionConfig) -> DataFrame:
    """Add ``prediction`` to parsed review records; rejected records get NULL."""
    scored = parsed.withColumn("logits", udf(F.col("event.text")))
    decided = add_prediction(scored, config)
    core = "struct(sentiment, label_id, confidence, probabilities)"
    return decided.selectExpr(*parsed.columns, f"CASE WHEN event IS NOT NULL THEN {core} END AS prediction")


class ConstantScorer:
    """The same logits for every text."""

    def __init__(self, values: Sequence[float] = (0.0, 0.0, 0.0)):
        self.values = np.asarray(values, dtype=np.float64)

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        return np.tile(self.values, (len(texts), 1))


class CueScorer:
    """Logits from the share of given characters in a text; a small stand-in model."""

    def __init__(self, cues: Sequence[str], scale: float):
        self.cues, self.scale = tuple(cues), float(scale)

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        return np.array(
            [[self.scale * text.count(cue) / len(text) for cue in self.cues] for text in texts]
        ).reshape(len(texts), len(self.cues))
