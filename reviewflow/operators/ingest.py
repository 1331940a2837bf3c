"""Keyset reads and the cursor of an incremental pipeline."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import ClassVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewflow.operators.contracts import validate_reviews
from reviewflow.operators.rules import require_valid
from reviewflow.schema import SCHEMA_VERSION

PAGE_SIZE = 50


class CursorRegression(ValueError):
    """The cursor would move backwards."""


class CursorMismatch(RuntimeError):
    """The cursor belongs to another source or target."""


def normal_id(column: str = "review_id") -> Column:
    """An id as it is compared and published: in lower case."""
    return F.lower(F.col(column).cast("string"))


def after(reviews: DataFrame, cursor: str | None) -> DataFrame:
    """Reviews whose id, in lower case, is above the cursor.

    Every spelling of such an id is also above the cursor's upper-case spelling;
    that plain comparison reaches the scan.
    """
    if cursor is None:
        return reviews
    return reviews.where((F.col("review_id") > cursor.upper()) & (normal_id() > cursor.lower()))


def late(reviews: DataFrame, lookback: str, cursor: str, published: DataFrame | None = None) -> DataFrame:
    """Reviews above ``lookback`` up to the cursor that ``published`` (review_id) does not hold yet.

    Without ``published`` all of them are given, to be published again.
    """
    rows = after(reviews, lookback).where(normal_id() <= cursor.lower())
    if published is None:
        return rows
    known = after(published.select("review_id"), lookback).where(normal_id() <= cursor.lower())
    known = known.select(normal_id().alias("_known")).distinct()
    return rows.join(known, normal_id() == F.col("_known"), "left_anti")


def keyset_page(reviews: DataFrame, cursor: str | None, size: int = PAGE_SIZE) -> DataFrame:
    """The next ``size`` reviews above the cursor in order of the lower-case id."""
    if size <= 0:
        raise ValueError("page size must be positive")
    return after(reviews, cursor).orderBy(normal_id()).limit(size)


def valid_page(reviews: DataFrame, cursor: str | None, size: int = PAGE_SIZE) -> DataFrame:
    """The next page as validated reviews; an invalid row of the page ends the job."""
    return require_valid(validate_reviews(keyset_page(reviews, cursor, size)))


def advance_cursor(published: DataFrame, cursors: DataFrame, at: str) -> DataFrame:
    """Cursor rows after publishing: the highest id per pipeline, never lower than before.

    ``published`` has ``checkpoint_id, source_collection, target_topic,
    review_id``. It is reduced to one row per pipeline before the join.
    """
    keys = ["checkpoint_id", "source_collection", "target_topic"]
    moved = published.groupBy(*keys).agg(F.max(normal_id()).alias("new_id"))
    old = cursors.select(*keys, F.col("last_review_id").alias("old_id"))
    return moved.join(old, keys, "full").select(
        "checkpoint_id",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.greatest("new_id", "old_id").alias("last_review_id"),
        "source_collection",
        "target_topic",
        F.expr(f"{at} AS updated_at"),
    )


def next_offsets(records: DataFrame) -> DataFrame:
    """The offset to commit per topic partition: one past the highest seen."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


class CursorConflict(RuntimeError):
    """Another writer has moved the cursor meanwhile."""


@dataclass(frozen=True)
class CursorTable:
    """Cursors on shared storage, as numbered one-row files; the highest number counts.

    A save writes its row aside and renames it to the next number, which fails if
    that number exists: of two writers that start from the same number one
    succeeds, the other gets ``CursorConflict``. Loading lists one small folder and
    reads one file, however often the cursor has been saved; numbers further back
    than ``KEPT`` go. The rename must be atomic, as it is on HDFS.
    """

    spark: SparkSession
    path: str
    checkpoint_id: str
    source_collection: str
    target_topic: str

    KEPT: ClassVar[int] = 8

    def load(self) -> str | None:
        """The last published id, or None before the first save."""
        return self._latest()[1]

    def save(self, review_id: str, expected: str | None = "") -> str:
        """Record progress; moving backwards is an error.

        With ``expected`` (an id, or None for no cursor) the cursor is only moved from there.
        """
        normal = str(review_id).lower()
        if len(normal) != 24 or any(ch not in "0123456789abcdef" for ch in normal):
            raise ValueError("a cursor must be 24 hex digits")
        number, current = self._latest()
        if expected != "" and current != expected:
            raise CursorConflict(f"the cursor is at {current}, not at {expected}")
        if current is not None and normal < current:
            raise CursorRegression(f"{normal} lies below {current}, up to which reviews are published")
        if normal != current:
            self._create(number + 1, normal)
        return normal

    def _files(self):
        """(file system, folder) of this cursor's numbers."""
        name = hashlib.sha256(self.checkpoint_id.encode()).hexdigest()[:32]
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _numbers(self) -> list[int]:
        files, folder = self._files()
        if not files.exists(folder):
            return []
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._files()[1], name)

    def _latest(self) -> tuple[int, str | None]:
        numbers = self._numbers()
        if not numbers:
            return 0, None
        stream = self._files()[0].open(self._at(f"{numbers[-1]:012d}.json"))
        try:
            row = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if (row["source_collection"], row["target_topic"]) != (self.source_collection, self.target_topic):
            raise CursorMismatch(
                f"cursor {self.checkpoint_id!r} belongs to {row['source_collection']!r} -> {row['target_topic']!r}"
            )
        return numbers[-1], row["last_review_id"]

    def _create(self, number: int, review_id: str) -> None:
        row = {
            "checkpoint_id": self.checkpoint_id, "schema_version": SCHEMA_VERSION, "last_review_id": review_id,
            "source_collection": self.source_collection, "target_topic": self.target_topic,
            "updated_at": datetime.now(UTC).isoformat(),
        }
        files, folder = self._files()
        files.mkdirs(folder)
        aside, target = self._at(f".{uuid.uuid4().hex}"), self._at(f"{number:012d}.json")
        out = files.create(aside, False)
        out.write(json.dumps(row).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(aside), files.makeQualified(target), no_overwrite)
        except Py4JJavaError as error:
            files.delete(aside, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            raise CursorConflict(f"cursor {self.checkpoint_id!r} has been saved by another writer") from error
        numbers = self._numbers()
        if numbers[-1] != number:
            raise CursorConflict(f"cursor {self.checkpoint_id!r} has been saved by another writer")
        for old in numbers[: -self.KEPT]:
            files.delete(self._at(f"{old:012d}.json"), False)
