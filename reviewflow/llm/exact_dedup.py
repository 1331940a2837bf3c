"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a text is a polynomial of its bytes modulo two primes, with
its length. Fingerprints of chunks combine by shifting: that of ``AB`` is that of
``A`` plus that of ``B`` times the base to the length of ``A``. So chunks are
hashed as rows of a matrix product, and the segments of a huge text are dealt to
several tasks and combined by a plain sum. Documents with equal fingerprints are
then compared chunk by chunk; a group in which a chunk differs is divided exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.session import discard, ship_package, stored

PRIMES = (2147483629, 2147483587)  # below 2**31
BASES = (1000003, 998244353)
CHUNK = 1024  # bytes hashed by one row of the product; sums stay below 2**53
SEGMENT = 1 << 20  # texts above this are dealt out in segments
COMPARED = 1 << 16  # bytes of a compared chunk
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

SUMS = "doc_id long, start long, n_bytes long, h1 long, h2 long, text_sha256 string"


class Polynomial:
    """Fingerprints of many byte strings at once."""

    def __init__(self, primes: tuple[int, int] = PRIMES):
        self.primes = primes
        columns = []
        for prime, base in zip(primes, BASES):
            columns.append([pow(base, i, prime) for i in range(CHUNK)])
        self.powers = np.array(columns, dtype=np.float64).T
        self.shifts = [np.ones(1, dtype=np.uint64) for _ in primes]

    def _shift(self, which: int, n: int) -> np.ndarray:
        """Powers of base ** CHUNK."""
        have, prime = self.shifts[which], self.primes[which]
        if len(have) < n:
            step, out = pow(BASES[which], CHUNK, prime), have.tolist()
            while len(out) < 2 * n:
                out.append(out[-1] * step % prime)
            self.shifts[which] = have = np.array(out, dtype=np.uint64)
        return have[:n]

    def of(self, texts: list[bytes], starts: list[int]) -> np.ndarray:
        """Per text its two hashes, shifted by its start in the whole text."""
        chunks = [-(-len(t) // CHUNK) for t in texts]
        padded = bytearray(sum(chunks) * CHUNK)
        at = 0
        for text, n in zip(texts, chunks):
            padded[at : at + len(text)] = text
            at += n * CHUNK
        rows = np.frombuffer(padded, dtype=np.uint8).reshape(-1, CHUNK).astype(np.float64) @ self.powers
        first = np.concatenate([[0], np.cumsum(chunks)]).astype(np.int64)
        number = np.arange(first[-1]) - np.repeat(first[:-1], chunks)
        out = np.zeros((2, len(texts)), dtype=np.uint64)
        for w, prime in enumerate(self.primes):
            part = rows[:, w].astype(np.uint64) % np.uint64(prime)
            if len(part):
                part = part * self._shift(w, int(max(chunks)))[number] % np.uint64(prime)
            # An empty text has no chunk; sums of differences leave it at zero.
            total = np.concatenate([[0], np.cumsum(part, dtype=np.uint64)]).astype(np.uint64)
            move = np.array([pow(BASES[w], s, prime) if s else 1 for s in starts], dtype=np.uint64)
            out[w] = (total[first[1:]] - total[first[:-1]]) % np.uint64(prime) * move % np.uint64(prime)
        return out


def _texts(column) -> Iterator[bytes]:
    for value in column:
        raw = value.as_buffer() if value.is_valid else None
        yield raw.to_pybytes().translate(LOWER) if raw is not None else b""


def _slices(rows: Iterator[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Runs of rows whose texts, the last of each, have about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hash_whole(primes):
    def run(batches):
        poly = Polynomial(primes)
        for batch in batches:
            for rows in _slices(zip(batch.column(0).to_pylist(), _texts(batch.column(1).cast(pa.large_binary())))):
                texts = [r[1] for r in rows]
                h = poly.of(texts, [0] * len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(h[0]), pa.array(h[1]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ], names=["doc_id", "start", "n_bytes", "h1", "h2", "text_sha256"])

    return run


def _cut(size: int):
    """Pieces of each text, lower-cased, with the digest of the whole."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            for i, text in enumerate(_texts(batch.column(batch.num_columns - 1).cast(pa.large_binary()))):
                digest = hashlib.sha256(text).hexdigest()
                for start in range(0, max(len(text), 1), size):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[i]], pa.int64()) for k in keys]
                        + [pa.array([start], pa.int64()), pa.array([digest]), pa.array([text[start : start + size]], pa.binary())],
                        names=[*batch.schema.names[:-1], "start", "text_sha256", "piece"],
                    )

    return run


def _gather(batches, limit: int = 1 << 22):
    """Joins the many one-row batches of a generator."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _hash_pieces(primes):
    def run(batches):
        poly = Polynomial(primes)
        for batch in batches:
            ids, starts, digests, pieces = (c.to_pylist() for c in batch.columns)
            h = poly.of(pieces, starts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(starts, pa.int64()),
                pa.array([len(p) for p in pieces], pa.int64()), pa.array(h[0]), pa.array(h[1]), pa.array(digests),
            ], names=["doc_id", "start", "n_bytes", "h1", "h2", "text_sha256"])

    return run


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, segment: int = SEGMENT) -> DataFrame:
    """doc_id, n_bytes, h1, h2, text_sha256 of each row's text with A-Z lower-cased; null is empty."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = rows.where(F.octet_length("text") <= segment).mapInArrow(_hash_whole(primes), SUMS)
    cut = _cut(segment)
    pieces = (
        rows.where(F.octet_length("text") > segment)
        .mapInArrow(lambda batches: _gather(cut(batches)), "doc_id long, start long, text_sha256 string, piece binary")
        .repartition("doc_id", "start")
        .mapInArrow(_hash_pieces(primes), SUMS)
        # Rows that share a doc_id are told apart by the digest, and copies of one row by their count.
        .groupBy("doc_id", "text_sha256")
        .agg(
            F.sum("n_bytes").alias("n_bytes"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"),
            F.sum(F.when(F.col("start") == 0, 1).otherwise(0)).alias("copies"),
        )
        .select(
            "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("start"),
            F.expr("n_bytes div copies").alias("n_bytes"),
            *[F.expr(f"pmod(h{i + 1} div copies, {p}L)").alias(f"h{i + 1}") for i, p in enumerate(primes)], "text_sha256",
        )
    )
    return short.unionByName(pieces).select("doc_id", "n_bytes", "h1", "h2", "text_sha256")


def dedup(docs: DataFrame, primes: tuple[int, int] = PRIMES, segment: int = SEGMENT) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest doc_id of a group stays. A null doc_id ranks below
    all others, and a group of only such rows keeps null. Rows that repeat a
    doc_id count each, and all rows with the largest doc_id are marked as kept.
    Other columns are not read. An empty table gives an empty result.
    """
    keys = ["n_bytes", "h1", "h2"]
    prints = stored(fingerprints(docs, primes, segment), "exact-prints")
    rows = prints.count()
    groups = prints.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    dealt = spread_join(prints, groups, keys, hot_keys(groups, keys, rows), F.col("doc_id"), "left")
    dealt = stored(dealt.select(*keys, "doc_id", "text_sha256", "keep_id", F.coalesce("n", F.lit(1)).alias("group_size")), "exact-groups")

    discard(prints)
    differ = stored(_differing(docs, dealt), "exact-differing")
    if not differ.isEmpty():
        dealt = _divide(docs, dealt, differ)
    return dealt.select(
        "doc_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        "group_size",
        (F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id"))).eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def _chunks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, doc_id, start, text_sha256, piece: the chunks of the members' texts.

    ``members`` holds doc_id and group_id. A doc_id that repeats may bring in a
    text of another group, which its own length and fingerprint tell apart later.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = _cut(COMPARED)
    return (
        rows.join(members.hint("shuffle_hash"), "doc_id")
        .select("doc_id", "group_id", "text")
        .mapInArrow(
            lambda batches: _gather(cut(batches)),
            "doc_id long, group_id long, start long, text_sha256 string, piece binary",
        )
    )


def _differing(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """Fingerprints (n_bytes, h1, h2) whose members are not all the same text.

    A group agrees when, at every chunk, the least and the greatest content are
    equal; both combine before the shuffle, so a large group costs one row a task.
    Rows without doc_id are compared by their fingerprint's digest alone.
    """
    keys = ["n_bytes", "h1", "h2"]
    shared = dealt.where("group_size > 1")
    members = shared.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(*keys).alias("group_id")).distinct()
    spread = (
        _chunks(docs, members)
        .groupBy("group_id", "start")
        .agg(F.min("piece").alias("least"), F.max("piece").alias("most"))
        .where("least <> most")
        .select("group_id")
    )
    named = shared.select(*keys, F.xxhash64(*keys).alias("group_id")).distinct()
    compared = named.join(spread.distinct(), "group_id", "left_semi").select(*keys)
    nameless = (
        shared.groupBy(*keys).agg(F.min("text_sha256").alias("least"), F.max("text_sha256").alias("most"))
        .where("least <> most").select(*keys)
    )
    return compared.union(nameless).distinct()


def _divide(docs: DataFrame, dealt: DataFrame, differ: DataFrame) -> DataFrame:
    """Regroup the members of the given fingerprints by their exact text."""
    keys = ["n_bytes", "h1", "h2"]
    # Members whose digests differ have different texts; the chunk comparison above
    # has shown which groups these are, so the digest divides only those.
    exact = (
        dealt.join(differ, keys, "left_semi").groupBy(*keys, "text_sha256")
        .agg(F.max("doc_id").alias("exact_id"), F.count("*").alias("exact_n"))
    )
    return (
        dealt.join(exact, [*keys, "text_sha256"], "left")
        .withColumn("keep_id", F.when(F.col("exact_n").isNotNull(), F.col("exact_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("exact_n", "group_size"))
        .drop("exact_id", "exact_n")
    )
