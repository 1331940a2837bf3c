"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word is a suffix pointer: the start of the words that follow it in its
piece, five at most. Pointers are routed by their leading words, up to the first
word that is not hot or makes no hot pair with the one before, so that a route
holds whole partitions of the sorted pointers and stays small whatever the text.
In a route the pointers are divided by three-way partitions, word after word: the
size of an equal partition is the count of the words all its pointers share, and a
partition below the least count is given up. Words below the least count end a pointer, as no candidate holds one, and
so do pairs of words below it, which are counted by their hashes before.

A word or a pair of words counts as hot when it occurs more often than a route should
hold. What pointers say of a phrase of hot pairs alone is spread over routes, so it is
added up afterwards; all other counts are complete within their route.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.llm.words import _pieces, buffers, mix, word_hashes
from reviewflow.session import ship_package, stored

DEPTH = 5  # words of the longest phrase
MIN_COUNT = 100
BEST = 2000  # phrases reported per language
RUN = 1 << 21  # bytes of text taken together by a task; its arrays take some twenty times as much
ROUTE = 1 << 17  # pointers of a route, and occurrences above which a word or a pair is hot
BLOCK = 1 << 17  # pointers handed on together, at route ends
BITS = 1 << 25  # of a bitmap of words: 4 MB, whatever the data

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True

LEXICON = "lang string, word string, hash long, n long"
# Lists of numbers are packed, as wide as the greatest needs; each word is followed by a space.
POINTERS = "route int, langs array<string>, lang_of binary, words string, ids binary, done binary, n binary"
PHRASES = "lang string, phrase string, n long"


@dataclass
class Tokens:
    """The words of some texts in order: their number among ``langs`` and ``words``, and their piece."""

    ids: np.ndarray
    piece: np.ndarray
    langs: pa.Array
    words: pa.Array

    @property
    def hashes(self) -> np.ndarray:
        """A hash per pair of language and word, the same in every task."""
        names = self.langs.dictionary_encode()
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names.dictionary.to_pylist()]
        return mix(word_hashes(self.words)[0] + np.array(seeds, dtype=np.uint64)[names.indices.to_numpy()])


def _numbered(langs: pa.Array, words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Equal pairs get equal numbers; the number of each pair, and the pairs in order of their numbers."""
    lang, word = langs.dictionary_encode(), words.dictionary_encode()
    width = max(len(word.dictionary), 1)
    pairs = pa.array(lang.indices.to_numpy().astype(np.int64) * width + word.indices.to_numpy()).dictionary_encode()
    keys = pairs.dictionary.to_numpy()
    return pairs.indices.to_numpy(), lang.dictionary.take(pa.array(keys // width)), word.dictionary.take(pa.array(keys % width))


def tokens(langs: pa.Array, texts: pa.Array) -> Tokens:
    """The lower-cased words of ``texts``, of which each has a language."""
    data, at = buffers(texts)
    at, data = at - at[0], _LOWER[data[at[0] : at[-1]]]
    found, starts, pieces, breaks = [pa.array([], pa.binary())], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lo, hi in _pieces(data, at):
        part = data[lo:hi]
        word = ~_APART[part]
        edge = np.zeros(len(part) + 1, dtype=bool)
        edge[at[(at >= lo) & (at <= hi)] - lo] = True
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        first, last = np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1
        passed = np.cumsum(_BREAK[part])
        if len(first):
            # Words and the gaps between them by turns; every other one is a word.
            ends = np.empty(2 * len(first), dtype=np.int32)
            ends[0::2], ends[1::2] = first, last
            both = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(part)])
            found.append(both.take(pa.array(np.arange(0, len(ends), 2))))
            starts.append(first + lo)
            pieces.append(breaks + passed[first])
        breaks += int(passed[-1]) if len(passed) else 0
    words = pa.concat_arrays(found).cast(pa.string())
    text = np.searchsorted(at, np.concatenate(starts), "right") - 1
    ids, names, words = _numbered(langs.take(pa.array(text)), words)
    return Tokens(ids, np.concatenate(pieces) + text, names, words)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in batches:
        sizes = np.diff(buffers(batch.column(1))[1])
        run = np.cumsum(sizes) // RUN
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(sizes)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield tokens(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LEXICON; a row without word counts all words of a language."""
    for run in _runs(batches):
        if not len(run.ids):
            continue
        n = np.bincount(run.ids, minlength=len(run.words))
        yield pa.RecordBatch.from_arrays([run.langs, run.words, pa.array(run.hashes.view(np.int64)), pa.array(n)], names=["lang", "word", "hash", "n"])
        langs = run.langs.dictionary_encode()
        whole = np.bincount(langs.indices.to_numpy(), n, len(langs.dictionary)).astype(np.int64)
        k = len(whole)
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary, pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(whole)], names=["lang", "word", "hash", "n"]
        )


def _joined(run: Tokens, known: np.ndarray) -> np.ndarray:
    """Whether each word but the last is known and followed by a known one in its piece."""
    return known[run.ids[:-1]] & known[run.ids[1:]] & (run.piece[:-1] == run.piece[1:])


def _pair_hashes(run: Tokens, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits for each pair of a word and the next one; equal ones only add to a count."""
    return mix(hashes[run.ids[at]] * _STEP + hashes[run.ids[at + 1]]) >> _U(16)


def _count_pairs(shared):
    """(hash, n) of the pairs of frequent words of each run."""

    def run(batches):
        for run in _runs(batches):
            hashes = run.hashes
            at = np.flatnonzero(_joined(run, _set_in(shared.value[0], hashes)))
            found, n = np.unique(_pair_hashes(run, hashes, at), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return run


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with those of the words' hashes set."""
    bit = F.col("hash").bitwiseAND(BITS - 1)
    cells = words.select(F.shiftright(bit, 6).alias("cell"), F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITS >> 6, dtype=np.int64)
    out[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _set_in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & _U(BITS - 1)
    return bitmap.view(np.uint64)[at >> _U(6)] >> (at & _U(63)) & _U(1) == 1


def _packed(run: Tokens, route: np.ndarray, begin: np.ndarray, ids: np.ndarray, done: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of POINTERS of pointers in order of their routes, which begin at ``begin``."""
    ends = np.append(begin, len(route))
    # The words of each route, numbered from 0 in the order in which they come.
    flat = ids.ravel()
    inside = flat >= 0
    group = np.repeat(np.arange(len(begin)), np.diff(ends) * DEPTH)[inside]
    pairs = pa.array(group * len(run.words) + flat[inside]).dictionary_encode()
    keys = pairs.dictionary.to_numpy()
    starts = np.searchsorted(keys // len(run.words), np.arange(len(begin) + 1))
    local = np.full(len(flat), -1, dtype=np.int32)
    local[inside] = pairs.indices.to_numpy() - starts[group]
    used = pa.array(keys % len(run.words))
    # The languages of each route likewise.
    langs = run.langs.take(used).dictionary_encode()
    group = np.repeat(np.arange(len(begin)), np.diff(starts))
    pairs = pa.array(group * len(langs.dictionary) + langs.indices.to_numpy()).dictionary_encode()
    keys = pairs.dictionary.to_numpy()
    of = np.searchsorted(keys // len(langs.dictionary), np.arange(len(begin) + 1))
    names = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), langs.dictionary.take(pa.array(keys % len(langs.dictionary))))
    data, at = buffers(pc.binary_join_element_wise(run.words.take(used), "", " "))
    words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(at[starts].astype(np.int32)), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([
        pa.array(route[begin].astype(np.int32)), names, _bytes(pairs.indices.to_numpy() - of[group], starts), words,
        _bytes(local, ends * DEPTH), _bytes(done, ends), _bytes(counts, ends),
    ], names=["route", "langs", "lang_of", "words", "ids", "done", "n"])


def _bytes(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Numbers from -1 up, cut at ``at``, as bytes of the least of three widths."""
    kind = next(k for k in (np.int8, np.int16, np.int32) if values.max() <= np.iinfo(k).max)
    offsets = (at * np.dtype(kind).itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(kind))])


def _numbers(rows: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The numbers of packed lists of known sizes, one after another."""
    return np.concatenate([np.frombuffer(x, f"i{len(x) // n}").astype(np.int32) for x, n in zip(rows, sizes.tolist())])


def _route(shared, routes: int, pairs=None):
    """Suffix pointers by route, equal ones of a run counted together: rows of POINTERS.

    ``ids`` holds DEPTH places in ``words`` per pointer, -1 past its end, and
    ``done`` how many leading words have decided its route. ``pairs`` has a bitmap of
    the pairs of words that a pointer may hold, and one of the hot pairs.
    """

    def run(batches):
        frequent, hot = shared.value
        for run in _runs(batches):
            hashes = run.hashes
            known, common = _set_in(frequent, hashes), _set_in(hot, hashes)
            n = len(run.ids)
            ids = np.full((n, DEPTH), -1, dtype=np.int32)
            valid = known[run.ids]
            ids[:, 0][valid] = run.ids[valid]
            follows = _joined(run, known)
            leads = np.append(common[run.ids[:-1]] & common[run.ids[1:]] & follows, False)
            if pairs is not None:
                at = np.flatnonzero(follows)
                both = _pair_hashes(run, hashes, at)
                follows[at], leads[at] = _set_in(pairs.value[0], both), leads[at] & _set_in(pairs.value[1], both)
            for j in range(1, min(DEPTH, n)):
                valid[: n - j] &= follows[j - 1 :]
                valid[n - j :] = False
                at = np.flatnonzero(valid)
                ids[at, j] = run.ids[at + j]
            at = np.flatnonzero(ids[:, 1] >= 0)
            ids = ids[at]
            if not len(ids):
                continue
            lead, whole = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64)
            done, undecided = np.zeros(len(ids), np.int8), np.ones(len(ids), dtype=bool)
            hashes = np.append(hashes, _U(0))  # place -1: the end
            for j in range(DEPTH):
                whole = mix(whole * _STEP + hashes[ids[:, j]])
                done += undecided
                lead = np.where(undecided, whole, lead)
                # A place past the end of the pointer decides like a word that is not hot.
                undecided &= (ids[:, j] >= 0) & (leads[np.minimum(at + j - 1, n - 1)] if j else common[ids[:, 0]])
            route = (lead % _U(routes)).astype(np.int64)
            key = (route.astype(np.uint64) << _U(32)) | (whole >> _U(32))
            order = np.argsort(key)
            ids, key = ids[order], key[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]).any(axis=1)])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(key)))
            ids, route, done, counts = ids[first], route[order][first], done[order][first], counts.astype(np.int32)
            del lead, whole, undecided, valid, key, order, new, first
            begin = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))
            for some in np.split(begin, np.flatnonzero(np.diff(begin // BLOCK)) + 1):
                lo, hi = int(some[0]), int(np.append(begin, len(route))[np.searchsorted(begin, some[-1]) + 1])
                yield _packed(run, route[lo:hi], some - lo, ids[lo:hi], done[lo:hi], counts[lo:hi])

    return run


def equal_partitions(ids: np.ndarray, weights: np.ndarray, done: np.ndarray, least: int):
    """Multikey three-way quicksort: (row, depth, count) of every equal partition that counts.

    Each round divides all open partitions at once by the next word of one of
    their pointers into less, equal and greater; equal ones go on with the word
    after it. ``row`` is a pointer of the partition, ``depth`` the number of words
    its pointers share, ``count`` their weight. A partition below ``least`` is
    given up, unless other routes may hold more of it (``done`` > depth).
    """
    rows, part, depth = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), np.zeros(1, dtype=np.int64)
    found = []
    while len(rows):
        at = depth[part]
        word = ids[rows, at]
        holder = np.empty(len(depth), dtype=np.int64)
        holder[part] = rows
        pivot = ids[holder, depth]
        cell = part * 3 + np.sign(word - pivot[part]) + 1
        size = np.bincount(cell, weights[rows], 3 * len(depth)).reshape(-1, 3)
        open_ = np.bincount(cell, done[rows] > at + 1, 3 * len(depth)).reshape(-1, 3) > 0
        alive = (size >= least) | ((size > 0) & open_)
        alive[:, 1] &= pivot >= 0
        hit = alive[:, 1] & (depth > 0)
        found.append((holder[hit], depth[hit] + 1, size[hit, 1].astype(np.int64)))
        alive[:, 1] &= depth + 1 < DEPTH
        number = np.cumsum(alive.ravel()) - 1
        stays = alive.ravel()[cell]
        rows, part = rows[stays], number[cell[stays]]
        depth = (depth[:, None] + np.array([0, 1, 0]))[alive]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _mine(least: int):
    """The phrases of a route, those of hot pairs alone with the part of their count it holds."""

    def run(table: pa.Table) -> pa.Table:
        lists = {name: table.column(name).to_pylist() for name in ("langs", "lang_of", "words", "ids", "done", "n")}
        sizes = np.array([x.count(" ") for x in lists["words"]])
        pointers = np.array([len(x) for x in lists["done"]])
        of = np.array([len(x) for x in lists["langs"]])
        langs = pa.array([x for row in lists["langs"] for x in row], pa.string())
        langs = langs.take(pa.array(_numbers(lists["lang_of"], sizes) + np.repeat(np.cumsum(of) - of, sizes)))
        number, langs, words = _numbered(langs, pa.array("".join(lists["words"])[:-1].split(" "), pa.string()))
        ids = _numbers(lists["ids"], pointers * DEPTH).reshape(-1, DEPTH)
        begin = np.repeat(np.cumsum(sizes) - sizes, pointers)
        ids = np.where(ids >= 0, number[np.maximum(ids, 0) + begin[:, None]], -1).astype(np.int32)
        weights, done = _numbers(lists["n"], pointers), _numbers(lists["done"], pointers)
        row, depth, count = equal_partitions(ids, weights, done, least)
        names, lang = words.to_pylist(), langs.take(pa.array(ids[row, 0]))
        phrases = [" ".join([names[i] for i in r[:d]]) for r, d in zip(ids[row].tolist(), depth.tolist())]
        return pa.table({"lang": lang, "phrase": pa.array(phrases, pa.string()), "n": pa.array(count, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, least: int = MIN_COUNT, route: int = ROUTE) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): lang, phrase, n of all phrases of 1 to DEPTH words with n >= least; lang, n of all words."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    lexicon = rows.mapInArrow(_count, LEXICON).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    lexicon = stored(lexicon.where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    single = lexicon.where("word IS NOT NULL")
    totals = lexicon.where("word IS NULL").select("lang", "n")
    whole = totals.agg(F.sum("n")).head()[0] or 0
    shared = spark.sparkContext.broadcast((_bitmap(single), _bitmap(single.where(F.col("n") > route))))
    pairs = rows.mapInArrow(_count_pairs(shared), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.where(F.col("n") >= least), "phrase-pairs")
    pairs = spark.sparkContext.broadcast((_bitmap(pairs), _bitmap(pairs.where(F.col("n") > route))))
    pointers = rows.mapInArrow(_route(shared, min(-(-whole // route), 2**31 - 1) or 1, pairs), POINTERS)
    mined = pointers.groupBy("route").applyInArrow(_mine(least), PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    counts = single.select("lang", F.col("word").alias("phrase"), "n").unionByName(mined.where(F.col("n") >= least))
    return stored(counts, "phrase-counts"), totals


def collocations(docs: DataFrame, least: int = MIN_COUNT, best: int = BEST, route: int = ROUTE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``best`` phrases.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
    pieces into words at spaces and tabs. A phrase has 2 to 5 words of one piece
    and occurs ``a >= least`` times in its language (null: ``und``). Cut after its
    first words, the parts occur l and r times, of n words in all, and the cut
    scores floor(1000 * a * n / (l * r)); the lowest score counts, at ties that of
    the shortest first part. A phrase inside a longer one that occurs as often is
    left out. Phrases rank by score and a, falling, then by their UTF-8 bytes.

    Repeated rows count each; null and empty texts have no words; without phrases
    the result is empty. Only ``lang`` and ``text`` are read.
    """
    counts, totals = phrase_counts(docs, least, route)
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)

    def part(of: str) -> str:
        return f"array_join({of}, ' ')"

    cuts = phrases.select("lang", "phrase", "a", F.explode(F.expr(f"""flatten(transform(sequence(1, size(w) - 1), k -> array(
        named_struct('k', k, 'first', true, 'part', {part('slice(w, 1, k)')}),
        named_struct('k', k, 'first', false, 'part', {part('slice(w, k + 1, size(w) - k)')}))))""")).alias("c"))
    cuts = stored(cuts.select("lang", "phrase", "a", "c.*"), "phrase-cuts")
    of_part = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    uses = cuts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    cuts_hot = hot_keys(uses, ["lang", "part"], cuts.count(), "uses")
    joined = stored(spread_join(cuts, of_part, ["lang", "part"], cuts_hot, F.col("phrase")), "phrase-parts")
    # Counts fall as phrases grow, so only a phrase one word longer has to be looked at.
    inside = joined.where("f = a AND instr(part, ' ') > 0").select("lang", F.col("part").alias("phrase")).distinct()
    sides = joined.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r")
    )
    # 1000 * a * n needs up to 38 digits, l * r fewer.
    score = F.expr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0)))"
                   " div (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    lowest = (
        sides.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
        .join(inside, ["lang", "phrase"], "left_anti")
    )
    order = "ORDER BY score DESC, a DESC, phrase"
    # Ranked within parts of a language first, so that no task ranks all its phrases.
    left = counts.count()
    while left > 100 * best:
        parts = -(-left // (100 * best))
        ranks = F.expr(f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase, {parts}), {parts}) {order})")
        lowest, left = lowest.withColumn("_rank", ranks).where(F.col("_rank") <= best).drop("_rank"), parts * best
    ranked = lowest.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS BIGINT)")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
