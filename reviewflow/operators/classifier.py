"""Class-weighted text classifier on Spark ML, usable as a scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.functions.decision import DecisionConfig, with_decision
from reviewflow.operators.corpus import class_weights
from reviewflow.operators.metrics import macro_f1


def train(
    train_rows: DataFrame,
    validation_rows: DataFrame,
    regularisation: tuple[float, ...] = (0.01, 0.1),
    features: int = 1 << 14,
    iterations: int = 20,
) -> PipelineModel:
    """Fit one model per strength with balanced class weights; keep the best on validation.

    Among equal macro F1 the first strength wins. The weights are three rows.
    ``features`` bounds the vocabulary: words that hash alike share a weight.
    ``iterations`` bounds the fit: each candidate's number of steps, and whether
    they ended before the bound, are kept in ``model.fits``.
    """
    weights = class_weights(train_rows).select("label_id", "weight").collect()
    by_class = F.create_map(*[F.lit(x) for r in weights for x in (r.label_id, r.weight)])
    weighted = train_rows.select(
        "text", F.col("label_id").cast("double").alias("label_id"), by_class[F.col("label_id")].alias("weight")
    )
    text = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[ \t\n\r]+"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
    ]).fit(weighted)
    rows = text.transform(weighted).select("features", "label_id", "weight").persist()
    best, best_f1, fits = None, -1.0, []
    try:
        for strength in regularisation:
            fitted = LogisticRegression(
                labelCol="label_id", weightCol="weight", family="multinomial",
                regParam=strength, maxIter=iterations,
            ).fit(rows)
            steps = fitted.summary.totalIterations
            fits.append({"strength": strength, "iterations": steps, "converged": steps < iterations})
            model = PipelineModel(stages=[*text.stages, fitted])
            f1 = macro_f1(with_decision(add_logits(model, validation_rows), DecisionConfig())).first().macro_f1 or 0.0
            if f1 > best_f1:
                best, best_f1 = model, f1
    finally:
        rows.unpersist()
    best.fits = fits
    return best


def add_logits(model: PipelineModel, df: DataFrame, out: str = "logits") -> DataFrame:
    """The model's three raw scores next to the rows; runs inside the JVM."""
    scored = model.transform(df.withColumn("_label", F.col("label_id")).drop("label_id"))
    return scored.withColumn(out, vector_to_array("rawPrediction")).select(
        *[c for c in df.columns if c != "label_id"], F.col("_label").alias("label_id"), out
    )
