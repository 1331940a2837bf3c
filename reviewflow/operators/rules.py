"""Named rules: each yields its name when it is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]  # name, condition under which it is broken


def violations(rules: list[Rule]) -> str:
    """Names of the broken rules, in rule order. A NULL condition is not broken."""
    cases = ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in rules)
    return f"array_compact(array({cases}))"


def fence(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows, with the named columns computed exactly once.

    A filter on a computed column is normally moved below its projection, where
    its whole expression is repeated and evaluated again. Passing the columns
    through a generator of one row keeps filters above it, so a costly check
    (here: parsing the payload) is not run a second time per branch condition.
    """
    kept = [c for c in df.columns if c not in names]
    return df.selectExpr(*kept, f"inline(array(struct({', '.join(names)})))")


def split_valid(df: DataFrame, column: str = "violations") -> tuple[DataFrame, DataFrame]:
    """The rows without violations and the rows with some; together all rows."""
    return df.where(f"size({column}) = 0").drop(column), df.where(f"size({column}) > 0")


def with_side(df: DataFrame, column: str = "violations") -> DataFrame:
    """Name each row's side, ``valid`` or ``quarantine``, for one pass that writes or counts both."""
    return df.withColumn("side", F.expr(f"IF(size({column}) = 0, 'valid', 'quarantine')"))


def require(df: DataFrame, failed: str, message: str) -> DataFrame:
    """Fail-fast: the first row for which ``failed`` holds ends the job."""
    return df.where(f"CASE WHEN {failed} THEN CAST(raise_error({message}) AS BOOLEAN) ELSE true END")


def require_valid(df: DataFrame, column: str = "violations") -> DataFrame:
    """Fail-fast: the first invalid row ends the job with its rule names."""
    message = f"concat('contract violated: ', array_join({column}, ', '))"
    return require(df, f"size({column}) > 0", message).drop(column)
