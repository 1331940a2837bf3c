"""Alignment of the tokens of two tokenizers by galloping intersection.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with
byte fallback) adds that space itself, so both spell the same bytes. The ends of
their tokens are two rising lists of byte offsets. The shorter list drives: each
of its ends is looked up in the longer one by steps of doubling width and then a
binary search between the last two. Common ends cut the tokens into groups, and
the ranks of two neighbouring ends give the tokens between them, which overlap.

Many texts are aligned at once: their lists lie one after another, and all driving
ends take the same step together. Every ``STRIDE``-th end gallops from the start
of its text, those between from the rank of that end.

Each text is tokenized once. The ids are written to a table, two bytes a token for
vocabularies of up to 65,536, from which the links are counted over all texts. The
counts, bounded by the vocabularies and not by the texts, go back to the workers in
slices of at most PAIRS pairs, a pass over the ids for each; B's ids are never split
over slices. A task holds RUN bytes of text and their tokens, or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.words import buffers
from reviewflow.session import ship_package, stored

TOKENIZERS = "/opt/tokenizers"
MODEL_A, MODEL_B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"
RUN = 1 << 20  # bytes of text, or of its ids, taken together by a task
PAIRS = 1 << 22  # linked id pairs that a worker looks up at a time
STRIDE = 16
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_SHIFT = 20  # a pair's key is b << _SHIFT | a
_LONGEST = 1 << 20  # letters of a text that tiktoken splits
# Fixed value: how the byte-level tokenizer splits a text before it merges bytes.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _climb(long: np.ndarray, values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each value how many of a rising list are smaller, by galloping from a rank that is not too high.

    No value exceeds the last of the list.
    """
    low, step = low.copy(), 1
    high = low.copy()
    live = np.flatnonzero(long[high] < values)
    while len(live):
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, len(long) - 1)
        step *= 2
        live = live[long[high[live]] < values[live]]
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        less = long[middle] < values[live]
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
        live = live[low[live] < high[live]]
    return low


def _drive(short: np.ndarray, start: np.ndarray, long: np.ndarray):
    """(rank, common, first) of each driving end; ``start`` is where its text begins in the longer list.

    The tokens ``first`` to ``rank`` of the longer list overlap the driving token.
    """
    anchors = _climb(long, short[::STRIDE], start[::STRIDE])
    rank = _climb(long, short, np.maximum(np.repeat(anchors, STRIDE)[: len(short)], start))
    common = long[rank] == short
    first = start.copy()
    first[1:] = np.maximum(first[1:], rank[:-1] + common[:-1])
    return rank, common, first


def _align(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray):
    """((A, B) last tokens of the groups in order, (A, B) tokens that overlap) of texts laid one after another.

    ``first_a`` and ``first_b`` give where each text's tokens begin, and last their number.
    """
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    by_b = n_b < n_a
    groups, links = [], []
    for turned in (False, True):
        texts = by_b == turned
        n, short, long, first_long = (n_b, ends_b, ends_a, first_a) if turned else (n_a, ends_a, ends_b, first_b)
        driver = np.flatnonzero(np.repeat(texts, n))
        if not len(driver):
            continue
        rank, common, first = _drive(short[driver], np.repeat(first_long[:-1][texts], n[texts]), long)
        sizes = rank - first + 1
        other = np.arange(sizes.sum()) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        group, link = (driver[common], rank[common]), (np.repeat(driver, sizes), other)
        groups.append(group[::-1] if turned else group)
        links.append(link[::-1] if turned else link)
    if not groups:
        none = np.zeros(0, np.int64)
        return (none, none), (none, none)
    (ga, gb), (la, lb) = ([np.concatenate(x) for x in zip(*part)] for part in (groups, links))
    return (np.sort(ga), np.sort(gb)), (la, lb)


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(groups, links): after how many tokens of A and of B each group ends; places of A and B tokens that overlap.

    Both lists end with the length of the text.
    """
    first = [np.array([0, len(x)]) for x in (ends_a, ends_b)]
    (ga, gb), (la, lb) = _align(np.array(ends_a, np.int64), first[0], np.array(ends_b, np.int64), first[1])
    return list(zip((ga + 1).tolist(), (gb + 1).tolist())), list(zip(la.tolist(), lb.tolist()))


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _steady() -> np.ndarray:
    """Code points whose general category every version of Unicode agrees on, so that both splitters do."""
    old = unicodedata.ucd_3_2_0
    out = [unicodedata.category(c) == old.category(c) not in ("Cc", "Cn", "Cs", "Co") for c in map(chr, range(0x10000))]
    out[0x09] = out[0x0A] = out[0x0D] = True
    return np.array([*out, False])


class Aligner:
    """Both tokenizers and the bytes of their tokens; one per worker."""

    def __init__(self, file_a: str, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the task its core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(file_a), SentencePieceProcessor(model_proto=file_b)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        letters = _byte_letters()
        vocabulary = self.a.get_vocab()
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            bytes_a[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.spelt = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (bytes_a, bytes_b)]
        self.kinds = [np.dtype(np.uint16 if len(x) <= 1 << 16 else np.uint32) for x in (bytes_a, bytes_b)]
        # An id as text with what may follow it in a list of groups.
        self.words = pa.array([f"{i}{s}".encode() for i in range(max(len(bytes_a), len(bytes_b))) for s in ",|;"], pa.large_binary())
        special = set(self.a.get_added_tokens_decoder())
        self.quick = self._ranked({b: i for i, b in enumerate(bytes_a) if b and i not in special}, file_a)
        self.steady = _steady()
        self.table = None

    def _ranked(self, ranks: dict[bytes, int], file_a: str):
        """The same tokenizer by ranks of byte strings, where ids follow the order of merges; else None."""
        import tiktoken

        told = json.loads(file_a)
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        made = [told["model"]["vocab"].get(x + y) for x, y in merges]
        plain = told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or told["normalizer"] or None in made or any(x >= y for x, y in zip(made, made[1:])):
            return None
        if len(ranks) != len(made) + 256 or min(made) < 256 or not all(bytes([i]) in ranks for i in range(256)):
            return None
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, text: str) -> list[int]:
        # Splitters may differ on letters that are new in Unicode; the file's own tokenizer reads those texts.
        if self.quick and len(text) <= _LONGEST:
            if self.steady[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x10000)].all():
                return self.quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str]) -> tuple[list[bytes | None], list[bytes | None]]:
        """The packed ids of each text by A and by B, None where the text does not come back from both."""
        lists = [[self._ids_a(" " + t) for t in texts], self.b.encode(texts, num_threads=1)]
        want = [(" " + t).encode() for t in texts]
        packed, good = [], [True] * len(texts)
        for ids, spelt, kind in zip(lists, self.spelt, self.kinds):
            ids = [np.array(x, kind) for x in ids]
            every = np.concatenate(ids)
            data, at = buffers(spelt.take(pa.array(every)))
            at = at[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
            data = memoryview(np.ascontiguousarray(data))
            good = [g and data[a:b] == w for g, a, b, w in zip(good, at, at[1:], want)]
            packed.append([x.tobytes() for x in ids])
        return tuple([x if g else None for x, g in zip(part, good)] for part in packed)

    def read(self, column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's begin and last end, byte offsets of their ends) of packed ids."""
        data, at = buffers(column)
        kind = self.kinds[side]
        ids = np.frombuffer(np.ascontiguousarray(data[at[0] : at[-1]]).tobytes(), kind)
        return ids.astype(np.int64), (at - at[0]) // kind.itemsize, np.cumsum(self.sizes[side][ids])

    def lines(self, ids_a, ids_b, groups, first_a, first_b) -> list[memoryview]:
        """The groups of each text as in ``align_texts``."""
        if not len(ids_a):
            return [memoryview(b"")] * (len(first_a) - 1)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[groups[0]] = last_b[groups[1]] = 1
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        # Before a token stand those of its side, and of the other one those of earlier groups or, for B, also of its own.
        order[np.arange(len(ids_a)) + np.concatenate([[0], groups[1] + 1])[np.cumsum(last_a) - last_a]] = ids_a * 3 + last_a
        order[np.arange(len(ids_b)) + (groups[0] + 1)[np.cumsum(last_b) - last_b]] = ids_b * 3 + 2 * last_b
        data, at = buffers(self.words.take(pa.array(order)))
        at, data = at[first_a + first_b].tolist(), memoryview(np.ascontiguousarray(data))
        return [data[a : max(b - 1, a)] for a, b in zip(at, at[1:])]


_aligners: dict[int, Aligner] = {}


def _aligner(number: int, shared) -> Aligner:
    """One per worker and pair of vocabularies, kept between tasks."""
    if number not in _aligners:
        _aligners.clear()
        _aligners[number] = Aligner(*shared.value)
    return _aligners[number]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about RUN bytes in their last column."""
    for batch in batches:
        sizes = np.diff(buffers(batch.column(batch.num_columns - 1))[1])
        run = np.cumsum(sizes) // RUN
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _tokenize(number: int, shared):
    def run(batches):
        aligner = _aligner(number, shared)
        for part in _runs(batches):
            texts = part.column(1).to_pylist()
            full = [i for i, t in enumerate(texts) if t]
            packed = aligner.tokens([texts[i] for i in full]) if full else ([], [])
            sides = []
            for found in packed:
                side = [None] * len(texts)
                for i, ids in zip(full, found):
                    side[i] = ids
                sides.append(pa.array(side, pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), *sides], names=["key", "a", "b"])

    return run


def _aligned(aligner: Aligner, a: pa.Array, b: pa.Array):
    ids_a, first_a, ends_a = aligner.read(a, 0)
    ids_b, first_b, ends_b = aligner.read(b, 1)
    groups, (link_a, link_b) = _align(ends_a, first_a, ends_b, first_b)
    return ids_a, first_a, ids_b, first_b, groups, link_a, ids_b[link_b] << _SHIFT | ids_a[link_a]


def _count_links(number: int, shared):
    def run(batches):
        aligner = _aligner(number, shared)
        for part in _runs(batches):
            keys, n = np.unique(_aligned(aligner, part.column(0), part.column(1))[-1], return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([
                    pa.array((keys & (1 << _SHIFT) - 1).astype(np.int32)), pa.array((keys >> _SHIFT).astype(np.int32)), pa.array(n.astype(np.int64))
                ], names=["a", "b", "n"])

    return run


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _sum_up(number: int, shared, table, texts: bool):
    def run(batches):
        aligner = _aligner(number, shared)
        keys, counts, best = table.value
        for part in _runs(batches):
            ids_a, first_a, ids_b, first_b, groups, link_a, link = _aligned(aligner, part.column(1), part.column(2))
            distinct = pa.array(link).dictionary_encode()
            pairs = distinct.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n, top = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            n[hit], top[hit] = counts[at[hit]], best[at[hit]]
            index = distinct.indices.to_numpy()
            # Links are summed by their A token, as they come in no order of texts.
            per_a = [np.bincount(link_a, minlength=len(ids_a)), np.zeros(len(ids_a), np.int64), np.zeros(len(ids_a), np.int64)]
            order = np.argsort(link_a, kind="stable")
            ends = np.cumsum(per_a[0])
            for out, value in zip(per_a[1:], (top, n)):
                out[:] = np.diff(np.concatenate([[0], np.cumsum(value[index[order]])])[np.concatenate([[0], ends])])
            sums = [np.diff(first_a), np.diff(first_b), np.diff(np.searchsorted(groups[0], first_a)), *[_per_text(x, first_a) for x in per_a]]
            lines = aligner.lines(ids_a, ids_b, groups, first_a, first_b)
            digests = [hashlib.sha256(x).hexdigest() if len(x) else "" for x in lines]
            columns = [part.column(0), *[pa.array(x.astype(np.int64)) for x in sums], pa.array(digests, pa.string())]
            names = ["key", *SUMS, "groups_sha256"]
            if texts:
                columns, names = [*columns, pa.array([str(x, "ascii") for x in lines], pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _share(spark, model_a: str, model_b: str):
    ship_package(spark)
    with open(model_a, encoding="utf-8") as a, open(model_b, "rb") as b:
        shared = spark.sparkContext.broadcast((a.read(), b.read()))  # bounded by the vocabulary files
    return shared._jbroadcast.id(), shared


def _ids(docs: DataFrame, key: str, text: str, number: int, shared) -> DataFrame:
    """key and the packed ids of both sides of every row, written once."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return stored(rows.mapInArrow(_tokenize(number, shared), f"key {rows.schema['key'].dataType.simpleString()}, a binary, b binary"), "token-ids")


def _pairs(ids: DataFrame, number: int, shared) -> DataFrame:
    counted = ids.select("a", "b").mapInArrow(_count_links(number, shared), "a int, b int, n long")
    counted = stored(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "link-counts")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    # One row per id of B: bounded by its vocabulary.
    return counted.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B) -> DataFrame:
    """a, b, n, best: how many links hold an id pair in all texts, and whether no A id has more with that B id."""
    number, shared = _share(docs.sparkSession, model_a, model_b)
    return _pairs(_ids(docs, text, text, number, shared), number, shared)


def _slices(pairs: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of B ids with at most ``limit`` pairs each, or one id."""
    sizes = sorted((r["b"], r["n"]) for r in pairs.groupBy("b").agg(F.count("*").alias("n")).collect())
    out, size = [], 0
    for b, n in sizes:
        if not out or size + n > limit:
            out.append([b, b])
            size = 0
        out[-1][1] = b
        size += n
    return [(a, b) for a, b in out] or [(0, 0)]


def align_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B,
    groups: bool = False, pairs_at_once: int = PAIRS,
) -> DataFrame:
    """Per row: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    ``groups`` lists the ids of A and B of each group in order, ``a1,a2|b1;a3|b2``.
    ``n_best`` are the links whose id pair no other A id exceeds with that B id,
    ``count_sum`` adds up how often each link's pair is linked in all rows.

    A text that is null, empty or does not come back from both tokenizers' tokens
    (as one with U+2581) has zeros and an empty digest, and adds to no count.
    Repeated rows each count; keys may be null and of any type; other columns are
    not read. No rows give no rows.
    """
    spark = docs.sparkSession
    number, shared = _share(spark, model_a, model_b)
    ids = _ids(docs, key, text, number, shared)
    pairs = _pairs(ids, number, shared)
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    schema = f"key {kind}, {', '.join(f'{n} long' for n in SUMS)}, groups_sha256 string" + (", groups string" if groups else "")
    passes, slices = [], _slices(pairs, pairs_at_once)
    for low, high in slices:
        part = pairs.where(F.col("b").between(low, high)).toPandas()
        keys = part["b"].to_numpy(np.int64) << _SHIFT | part["a"].to_numpy(np.int64)
        order = np.argsort(keys)
        table = spark.sparkContext.broadcast((keys[order], part["n"].to_numpy(np.int64)[order], part["best"].to_numpy(bool)[order]))
        passes.append(ids.mapInArrow(_sum_up(number, shared, table, groups), schema))
    found = passes[0]
    if len(passes) > 1:
        # Rows equal in all but the sums are copies, and have equal sums.
        for other in passes[1:]:
            found = found.unionByName(other)
        found = found.groupBy(*names).agg(
            *[F.sum(n).alias(n) for n in ("n_best", "count_sum")], (F.count("*") / len(passes)).cast("int").alias("copies")
        ).select(*names, *[F.expr(f"{n} div copies").alias(n) for n in ("n_best", "count_sum")], F.explode(F.expr("sequence(1, copies)")))
    return found.select(F.col("key").alias(key), *SUMS, *names[5:])
