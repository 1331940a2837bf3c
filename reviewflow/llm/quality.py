"""Quality classifier: kernel ridge regression on document statistics, calibrated.

Random Fourier features ``sqrt(2/D) cos(Wx + b)`` approximate a Gaussian kernel
over standardised statistics of a text. The normal equations are sums over rows,
so each partition adds up its own matrix and Spark adds those cell by cell; the
driver solves one ``D + 1`` square system. An isotonic fit on rows the ridge has
not seen turns its scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import PIECE, buffers, mix, word_hashes
from reviewflow.session import ship_package, stored

FOLDS = 5
HELD_OUT, CALIBRATION = 0, 4  # remainders of the crc32 of doc_id
FIT_ROWS = 400_000  # labelled rows used at most, chosen by hash
FEATURES = 256
RIDGE = 1e-4  # times the number of rows
BANDWIDTH = 1.0  # times the root of the number of statistics
BINS = 2000  # of ridge scores for the isotonic fit
FIT_PARTS = 16
THRESHOLD = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "bang", "bar", "mark", "other", "high", "tail"]
STATISTICS = [*[f"share_{c}" for c in _CLASSES], "log_bytes", "log_words", "word_length", "distinct_words", "top_word",
              "distinct_pairs", "distinct_lines", "lines_per_word", "long_words", "mixed_bytes"]


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
    for name, members in (
        ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r"), ("line", b"\n"),
        ("stop", b".?;:"), ("comma", b",'\"-()"), ("bang", b"!"), ("bar", b"|<>{}[]/\\=_"), ("mark", b"#$%&*@^~+"),
        ("high", range(0xC0, 0x100)), ("tail", range(0x80, 0xC0)),
    ):
        table[list(members)] = _CLASSES.index(name)
    return table


_TABLE = _class_table()


def _distinct_share(values: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and of the most frequent one."""
    if not len(values):
        return 1.0, 0.0
    counts = np.unique(values, return_counts=True)[1]
    return len(counts) / len(values), counts.max() / len(values)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, over its whole length; a null is an empty text."""
    data, at = buffers(column)
    rows, width = len(at) - 1, len(_CLASSES)
    out = np.zeros((rows, len(STATISTICS)))
    words, first = word_hashes(column)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:], 5) if len(words) > 1 else np.zeros(0, np.uint64)
    for i in range(rows):
        lo, hi, a, b = int(at[i]), int(at[i + 1]), int(first[i]), int(first[i + 1])
        n, w = hi - lo, b - a
        counts, breaks = np.zeros(256, dtype=np.int64), 0
        for start in range(lo, hi, PIECE):
            counts += np.bincount(data[start : min(start + PIECE, hi)], minlength=256)
        shares = np.bincount(_TABLE, weights=counts, minlength=width) / max(n, 1)
        breaks = int(counts[10])
        lines = np.zeros(0, np.uint64)
        if breaks:
            raw = data[lo:hi].tobytes().split(b"\n")
            lines = np.array([hash(x) for x in raw if x.strip()], dtype=np.int64)
        used = counts[counts > 0] / max(n, 1)
        distinct, top = _distinct_share(words[a:b])
        out[i, :width] = shares
        out[i, width:] = (
            np.log1p(n), np.log1p(w), n / max(w, 1), distinct, top, _distinct_share(pairs[a : max(b - 1, a)])[0],
            _distinct_share(lines)[0], np.log1p(breaks) / np.log1p(w + 1), np.log1p(n / max(w, 1)),
            -float(np.sum(used * np.log(used))) if n else 0.0,
        )
    return out


def _vectors(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def _parts(batches, rows: int = 1024):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _stats(batches):
    for part in _parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), _vectors(statistics(part.column(1)))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _stats, "doc_id long, stats array<double>"
    )


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


@dataclass
class QualityModel:
    """Standardisation, random features, ridge weights and the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _normal_equations(model: QualityModel):
    """Rows (i, sums): row i of the partition's matrix, the last column its product with the labels."""

    def run(batches):
        size = len(model.phases) + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_matrix(batch.column(0))), np.asarray(batch.column(1), dtype=np.float64)
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), _vectors(total)], names=["i", "sums"])

    return run


def _scored(model: QualityModel, raw: bool = False):
    def run(batches):
        for batch in batches:
            value = (model.raw if raw else model.score)(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=["key", "value"])

    return run


def isotonic(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing curve through cells at rising ``x`` with ``total`` positives of ``weight`` rows."""
    blocks: list[list[float]] = []
    for at, w, t in zip(x, weight, total):
        blocks.append([at * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, seed: int = 29, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on labelled rows outside the held-out fold.

    ``labels`` has doc_id and quality (0 or 1); a null counts as no label, several
    labels of a document vote, and a tie is 1. Without any label the score is 0.5.
    """
    width = len(STATISTICS)
    moments = stats.agg(*[f(F.get("stats", F.lit(i))) for i in range(width) for f in (F.avg, F.stddev_pop)]).head()
    mean, spread = np.array([moments[0::2], moments[1::2]], dtype=object).astype(float)
    mean, spread = np.nan_to_num(mean), np.nan_to_num(spread)
    draw = np.random.default_rng(seed)
    model = QualityModel(
        mean, np.where(spread > 1e-9, spread, 1.0),
        draw.standard_normal((width, FEATURES)) / (BANDWIDTH * np.sqrt(width)), draw.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])),
    )
    votes = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label")).where(fold(F.col("doc_id")) != HELD_OUT)
    )
    known = stats.join(votes, "doc_id").select("doc_id", "stats", "label")
    known = stored(known, "quality-known")
    rows = known.count()
    if not rows:
        return model
    share = min(1.0, fit_rows / rows)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    train = known.where(fold(F.col("doc_id")) != CALIBRATION).coalesce(FIT_PARTS).select("stats", "label")
    cells = (
        train.mapInArrow(_normal_equations(model), "i int, sums array<double>")
        .select("i", F.posexplode("sums").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    )
    size = FEATURES + 1
    sums = np.zeros((size, size + 1))
    sums[cells["i"], cells["j"]] = cells["value"]
    count = max(sums[-1, -2], 1.0)
    model.weights = np.linalg.solve(sums[:, :-1] + RIDGE * count * np.eye(size), sums[:, -1])
    scores = known.where(fold(F.col("doc_id")) == CALIBRATION).select("label", "stats")
    binned = (
        scores.mapInArrow(_scored(model, raw=True), "key double, value double")
        .select(F.col("key").alias("label"), F.floor(F.least(F.greatest("value", F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).alias("bin"))
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").toPandas()
    )
    if len(binned):
        model.curve = isotonic((binned["bin"].to_numpy(float) + 0.5) / (BINS / 2), binned["n"].to_numpy(float), binned["good"].to_numpy(float))
    else:
        model.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text is an input of the score; empty and null texts are scored like
    any other. Rows that repeat a doc_id are scored each by its own text; a null
    doc_id is not held out and has no label. Other columns are not read.
    """
    stats = stored(document_statistics(docs), "quality-stats")
    model = fit(stats, labels)
    scored = stats.mapInArrow(_scored(model), "key long, value double")
    return scored.select(
        F.col("key").alias("doc_id"), F.coalesce(fold(F.col("key")) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("value").alias("score"), (F.col("value") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _keep(model: QualityModel, text: str):
    def run(batches):
        for part in _parts(batches):
            column = part.column(part.schema.get_field_index(text))
            yield part.filter(pa.array(model.score(statistics(column)) >= THRESHOLD))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject.

    The statistics are computed twice, to fit and to filter, so texts are never shuffled.
    """
    model = fit(stored(document_statistics(docs), "quality-stats"), labels)
    return docs.mapInArrow(_keep(model, "text"), docs.schema)
