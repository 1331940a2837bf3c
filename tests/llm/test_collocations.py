"""Phrase collocations against a plain version."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewflow.llm import collocations
from reviewflow.llm.common import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, n long, route int, k int"


def plain(rows, least, best):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    counts = {k: v for k, v in counts.items() if v >= least}
    inside = set()
    for (lang, long), f in counts.items():
        for size in range(2, len(long)):
            for i in range(len(long) - size + 1):
                if f >= counts[lang, long[i : i + size]]:
                    inside.add((lang, long[i : i + size]))
    out = []
    for lang in totals:
        found = []
        for (of, p), a in counts.items():
            if of != lang or len(p) < 2 or (of, p) in inside:
                continue
            cuts = []
            for k in range(1, len(p)):
                l, r = counts[lang, p[:k]], counts[lang, p[k:]]
                cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def result(docs, **options):
    return sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())


@pytest.mark.parametrize("route, best", [(5, 40), (40, 3), (1 << 17, 2000)])
def test_phrases_equal_the_plain_version(spark, route, best):
    draw = random.Random(route)
    words = ["the", "The", "of", "of", "a", "é", "日本", "x" * 50, "news", "\x00", "c++", "b c"]
    rows = []
    for i in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "!"]) for _ in range(draw.randrange(60)))
        rows.append((i, text, draw.choice(["en", "en", "de", None, ""]), "p", 1, 2, 3))
    # A hot passage in a third of the rows, repeated rows, odd texts.
    rows += [(i, "once more the of a the of a news, the the the the the the", "en", "p", 1, 2, 3) for i in range(150)]
    rows += [(7, "again and again and again", None, "p", 1, 2, 3)] * 10
    rows += [(8, None, "en", "p", 1, 2, 3), (9, "", "en", "p", 1, 2, 3), (None, "of a", "fr", None, 1, 2, 3), (10, " \t..\n", "fr", None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = result(docs, least=5, route=route, best=best)
    assert got == plain([(r[2], r[1]) for r in rows], 5, best)


def test_long_texts_are_read_whole(spark, monkeypatch):
    text = " ".join(f"w{i % 3}" if i % 50 else f"stop{i}. end" for i in range(120_000)) + " " + "y" * 400_000 + " w0 w1"
    docs = spark.createDataFrame([(1, text, "en", "p", 1, 2, 3), (2, text.upper(), "en", "p", 1, 2, 3)], SCHEMA)
    assert result(docs, least=100, route=1000) == plain([("en", text), ("en", text)], 100, 2000)


def test_phrases_of_no_rows(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, None, None, "p", 1, 2, 3)], SCHEMA)) == []


def test_partitions_are_the_counts():
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 4, (3000, 5)).astype(np.int32)
    ends = draw.integers(2, 6, 3000)
    ids[np.arange(5)[None, :] >= ends[:, None]] = -1
    weights = draw.integers(1, 4, 3000)
    row, depth, count = collocations.equal_partitions(ids, weights, np.ones(3000, np.int8), 20)
    want = Counter()
    for pointer, w, end in zip(ids.tolist(), weights.tolist(), ends.tolist()):
        for d in range(2, end + 1):
            want[tuple(pointer[:d])] += w
    got = {tuple(ids[r, :d].tolist()): c for r, d, c in zip(row.tolist(), depth.tolist(), count.tolist())}
    assert len(got) == len(row) and got == {k: v for k, v in want.items() if v >= 20}


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    rows = [("en", "a", big), ("en", "b", big // 7), ("en", "a b", big // 9)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: (counts, totals))
    (row,) = collocations.collocations(counts).collect()
    a, l, r = big // 9, big, big // 7
    assert (row.a, row.l, row.r, row.score) == (a, l, r, 1000 * a * 9 * 10**12 // (l * r))


def test_hot_words_bound_a_route(spark, sf_small):
    """No route holds more pointers of one phrase than a route's share allows."""
    docs = documents(spark, sf_small)
    some, totals = collocations.phrase_counts(docs, 20, 200)
    all_, _ = collocations.phrase_counts(docs, 20, 1 << 30)
    assert some.count() == all_.count() == some.intersect(all_).count()
    assert totals.agg(F.sum("n")).head()[0] > 10_000


def test_blocks_of_routes_hold_the_same_pointers(monkeypatch):
    every = np.full(collocations.BITS >> 6, -1, dtype=np.int64)
    shared = SimpleNamespace(value=(every, np.zeros_like(every)))
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i)) for i in range(60)]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    rows, parts = [], []
    for block in (1, 50, 1 << 20):
        monkeypatch.setattr(collocations, "BLOCK", block)
        made = list(collocations._route(shared, 40)([batch]))
        parts.append(len(made))
        rows.append([row for part in made for row in part.to_pylist()])
    assert rows[0] == rows[1] == rows[2] and parts[0] == len(rows[0]) > parts[1] > parts[2] == 1


def test_pairs_below_the_least_count_end_a_pointer(spark, monkeypatch):
    draw, routed = random.Random(4), []
    rows = [(i, " ".join(draw.choice([f"w{k}" for k in range(200)]) for _ in range(100)) + " so it goes", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    old = type(docs).groupBy

    def seen(frame, *by):
        if by == ("route",):
            routed.append(frame.agg(F.sum(F.length("done"))).head()[0])
        return old(frame, *by)

    monkeypatch.setattr(type(docs), "groupBy", seen)
    got = result(docs, least=100, route=1000)
    assert got == plain([(r[2], r[1]) for r in rows], 100, 2000) and got
    assert routed[0] < 1000


@pytest.mark.parametrize("step", ["words", "pairs", "pointers"])
def test_a_task_holds_the_arrays_of_a_small_part_of_its_texts(step):
    """Two tasks share an executor's memory with its heap."""
    every = np.full(collocations.BITS >> 6, -1, dtype=np.int64)
    shared = SimpleNamespace(value=(every, np.zeros_like(every)))
    draw = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[draw.integers(0, 5000, 400)]) for _ in range(4500)]
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    assert batch.nbytes > 1 << 23
    work = {"words": collocations._count, "pairs": collocations._count_pairs(shared), "pointers": collocations._route(shared, 40)}[step]
    pairs = 0
    tracemalloc.start()
    for made in work([batch]):
        pairs += sum(made.column(1).to_numpy()) if step == "pairs" else 0
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20
    assert pairs == (4500 * 399 if step == "pairs" else 0)


def test_phrases_of_hot_words_come_from_one_route(spark, monkeypatch):
    """Only hot pairs are spread over routes: rows made do not grow with the routes."""
    draw, made = random.Random(6), []
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(100)) + ". so it goes", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    old = type(docs).groupBy

    def seen(frame, *by):
        if by == ("lang", "phrase"):
            made.append(frame.count())
        return old(frame, *by)

    monkeypatch.setattr(type(docs), "groupBy", seen)
    for route in (1000, 400):  # below the count of a word, then of the pairs too
        counts, _ = collocations.phrase_counts(docs, 40, route)
        found = {(r.lang, r.phrase): r.n for r in counts.collect()}
        want = Counter(tuple(p[i : i + k]) for _, text, _ in rows for p in (x.split() for x in text.split(".")) for k in range(1, 6) for i in range(len(p) - k + 1))
        assert found == {("en", " ".join(p)): n for p, n in want.items() if n >= 40}
    phrases = sum(n >= 40 and len(p) > 1 for p, n in want.items())
    assert made[0] == phrases < made[1]
