"""Class folders, snapshots, CSV input, decision configs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.functions.decision import DecisionConfig
from reviewflow.functions.text import decode_lossy, is_nonblank, strip_text
from reviewflow.operators.history import path_exists
from reviewflow.schema import DECISION_CONFIG, LABEL_TO_ID, LABELS


def read_class_folders(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``neg|neu|pos/*.txt`` file: ``path, text, label, label_id``.

    Bytes that are not UTF-8 become replacement characters; the text is stripped.
    """
    base = folder.rstrip("/")
    present = [c for c in LABELS if path_exists(spark, f"{base}/{c}")]
    if not present:
        raise FileNotFoundError(f"{base} has none of the class folders {', '.join(LABELS)}")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.txt")
        .load([f"{base}/{c}" for c in present])
    )
    label = "regexp_extract(path, '/(neg|neu|pos)/[^/]*$', 1) AS label"
    ids = " ".join(f"WHEN '{name}' THEN {i}" for name, i in LABEL_TO_ID.items())
    rows = files.selectExpr("path", f"{strip_text(decode_lossy('content'))} AS text", label)
    rows = rows.selectExpr("*", f"CASE label {ids} END AS label_id")
    if rows.select("path").limit(1).isEmpty():
        raise FileNotFoundError(f"the class folders of {base} hold no text file")
    return rows


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A reproducible copy of a corpus, as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.format(fmt).save(path)


def snapshot(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet snapshot at ``path``; built and written first if it is missing."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        write_snapshot(build(), path)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str = "text STRING") -> DataFrame:
    """CSV with a header whose quoted texts may span lines."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", False)
        .schema(schema)
        .csv(path)
    )


def first_usable(df: DataFrame, order: str) -> DataFrame:
    """The first row in the given order whose text is not blank.

    Rows that are read in parallel have no order of their own, so one is
    required: a column, or ``monotonically_increasing_id()`` for the order of one file.
    """
    return df.where(is_nonblank("text")).orderBy(F.expr(order)).limit(1)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def read_decision_config(spark: SparkSession, path: str) -> DecisionConfig:
    """A decision config from one JSON object; report fields beside it are ignored."""
    rows = (
        spark.read.schema(DECISION_CONFIG + ", _bad STRING")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_bad")
        .json(path)
        .limit(2)
        .collect()
    )
    if len(rows) != 1 or rows[0]._bad is not None:
        raise ValueError(f"{path} must hold one JSON object")
    row = rows[0]
    if row.temperature is None or row.strategy is None:
        raise ValueError("temperature and strategy are required")
    values = lambda v: tuple(v) if v else None
    return DecisionConfig(
        temperature=row.temperature,
        strategy=row.strategy,
        bias=values(row.params.bias) if row.params else None,
        thresholds=values(row.params.thresholds) if row.params else None,
    )


def write_report(report: DataFrame, path: str) -> None:
    """A one-row nested report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)
