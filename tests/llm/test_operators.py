"""The training-data operators against plain versions and on odd inputs."""

import hashlib
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import database, difference
from reviewflow.llm import (
    chat,
    exact_dedup,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    secret_scan,
    spans,
    unigram,
)
from reviewflow.llm.common import documents, hot_keys, spread_join
from reviewflow.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, token long, _salt int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, LONG), (7, LONG), (8, "ONE Two"), (9, "a b c d e f g"),
    (10, "a b c d e f g"), (11, "a b c d e f g h"), (12, "Ünïcode ünïcode 日本語 😀 ok"), (None, "no id"), (None, None),
    (13, "same id, one text"), (13, "same id, other text"), (14, "twice"), (14, "twice"), (15, "x" * 300_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 4}", 7, "k", 1, 2) for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf_small):
    rows = documents(spark, sf_small).select("doc_id", "text", "source").collect()
    return [tuple(r) for r in rows]


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- the registered queries with SQL ------------------------------------------------


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_matches_sql(spark, sf_mid, name):
    assert difference(entry.queries()[name](spark, sf_mid), database(sf_mid), entry.oracle_sql()[name]) is None


def test_every_dealt_operator_has_a_query():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names


# -- helpers -----------------------------------------------------------------------


def test_spread_join_deals_out_hot_keys(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    hot = hot_keys(right, ["k"], 20_000)
    assert [(r.k, r._salts) for r in hot.collect()] == [(7, 334)]
    joined = spread_join(left, right, ["k"], hot, F.col("id"))
    assert joined.count() == 20_000
    assert {r.most for r in joined.where("k = 7").collect()} == {19998}
    outer = spread_join(left, right.where("k <> 11"), ["k"], hot, F.col("id"), "left")
    assert [r.id for r in outer.where("most IS NULL").collect()] == [11]


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    random.Random(1).shuffle(links)
    got = components(spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in links], "a long, b long")).collect()
    want = {n: 0 for n in range(61)} | {n: 100 for n in range(100, 140)} | {n: 200 for n in range(200, 209)}
    assert {r.node: r.component_id for r in got} == want and len(got) == len(want)


def test_components_of_stars_take_one_step(spark, monkeypatch):
    written = []
    monkeypatch.setitem(components.__globals__, "stored", lambda df, what, old=components.__globals__["stored"]: written.append(what) or old(df, what))
    links = [(10 * i, 10 * i + j) for i in range(30) for j in range(1, 2 + i % 4)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component_id for r in got} == {n: n // 10 * 10 for link in links for n in link}
    assert written == ["links", "large-star"]


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- 1 line dedup -------------------------------------------------------------------


def test_lines_on_many_sites_stay_once(spark):
    rows = [(i, f"own {i}\n  shared line\t\nalso\n\nalso", f"s{i % 4}") for i in range(1, 9)] + [(9, None, None), (10, "shared line", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("old"))
    got = table(line_dedup.remove_boilerplate(docs, min_sites=4))
    assert got[1].text == "own 1\n  shared line\t\nalso\n" and got[1].n_removed == 1
    assert got[5].text == "own 5\n" and (got[5].n_lines, got[5].n_removed) == (5, 3)
    assert got[9].text is None and got[9].n_lines == 0 and got[10].text == ""
    few = table(line_dedup.remove_boilerplate(docs, min_sites=6))
    assert all(r.n_removed == 0 for r in few.values())  # 'shared line' is on five sites, null included


def test_sketches_and_exact_counts_agree_at_the_threshold(spark):
    lines = [(d, f"line {k}", f"site{s}") for k in range(30, 50) for d, s in enumerate(range(k))]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(lines)], "doc_id long, text string, source string")
    got = line_dedup.boilerplate(line_dedup.line_occurrences(docs), min_sites=40).collect()
    assert sorted(r.n for r in got) == list(range(40, 50))


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [(i, f"own {i}\neverywhere", f"s{i}") for i in range(6)]
    rows += [(50, "a\neverywhere\nc", "t"), (50, "d\nonly here\nf", "t"), (50, "everywhere\ng", "t"), (50, "everywhere\ng", "t")]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=4)
    assert sorted((r.text, r.n_removed) for r in got.where("doc_id = 50").collect()) == [("a\nc", 1), ("d\nonly here\nf", 0), ("g", 1), ("g", 1)]


def test_line_dedup_of_odd_rows(odd, none):
    got = line_dedup.remove_boilerplate(odd, min_sites=2)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == odd.count()
    assert line_dedup.remove_boilerplate(none).count() == 0


# -- 2 n-gram join ------------------------------------------------------------------


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_links_equal_all_pairs(spark, small, size, percent):
    random_ = random.Random(size)
    rows = [(d, t) for d, t, _ in small]
    for i in range(60):  # near copies at all distances
        words = rows[i % 7][1].split()[:200]
        for _ in range(i % 12):
            words[random_.randrange(len(words))] = f"new{random_.randrange(9)}"
        rows.append((10_000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, size, percent).collect()}
    assert got == brute.linked(rows, size, percent)


def test_links_with_frequent_tokens_and_a_large_group(spark):
    random_ = random.Random(3)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(common)
        for _ in range(i % 6):
            words[random_.randrange(len(words))] = f"n{random_.randrange(400)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(common[:60] + [f"own{i}w{j}" for j in range(60)])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    assert got == brute.linked(rows, 4, 85)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_sets_that_link_share_a_signature(percent):
    none, random_ = np.zeros(0, np.int64), np.random.default_rng(percent)
    orders, linked = ngram_join.Orders((none, none), (none, none)), 0
    for _ in range(3000):
        n = int(random_.integers(1, 160))
        a = np.unique(random_.integers(0, 1 << 62, n).astype(np.uint64))
        lost = random_.integers(0, n * (100 - percent) // 100 + 1)
        more = random_.integers(0, n * (100 - percent) // percent - lost + 1) if lost * percent <= n * (100 - percent) else 0
        b = np.unique(np.concatenate([random_.permutation(a)[lost:], random_.integers(0, 1 << 62, max(int(more), 0)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or not len(b):
            continue
        linked += 1
        of = [orders.signatures(x, np.zeros(len(x), np.int64), percent) for x in (a, b)]
        assert len(np.intersect1d(*of)), (n, lost, more)
    assert linked > 500


def test_documents_that_share_a_rare_passage_do_not_meet(spark):
    rows = [(i, " ".join([f"own{i}w{j}" for j in range(150)] + [f"rare{j}" for j in range(6)])) for i in range(60)]
    texts = spark.createDataFrame(rows, "doc long, text string")
    index = texts.mapInArrow(ngram_join._index(4, 85, ngram_join.frequent_tokens(texts, 4)), ngram_join.INDEX)
    assert ngram_join._members(ngram_join.stored(index, "index")).count() < 30


def test_signatures_are_shuffled_as_two_numbers(spark):
    ids = [0, 1, 65535, 65536, -1, -65537, (1 << 63) - 1, -(1 << 63), 1 << 40]
    rows = [(d, 3, None, [7 << 20, -(5 << 30), 9 * d + 1 << 16 if abs(d) < 1 << 45 else 3], [], [], [], []) for d in ids]
    members = []

    def kept(df, what):
        members.append(df)
        return df

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join, "stored", kept)
        found = ngram_join._members(spark.createDataFrame(rows, ngram_join.INDEX)).collect()
    assert {r.doc for r in found} == set(ids) and {r.n for r in found} == {3}
    plan = members[0]._jdf.queryExecution().executedPlan().toString()
    signatures = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ("signature" in line or "packed" in line)]
    assert len(signatures) == len([x for x in signatures if "shiftrightunsigned(packed" in x]) >= 1, plan


def test_sketches_differ_in_no_more_bits_than_the_sets_in_tokens():
    random_ = np.random.default_rng(5)
    for n in (0, 1, 40, 300, 5000):
        a = random_.integers(0, 1 << 62, n).astype(np.uint64)
        for lost, more in ((0, 0), (n // 9, 0), (n // 5, n // 7 + 1), (n, n)):
            b = np.concatenate([a[lost:], random_.integers(0, 1 << 62, more).astype(np.uint64)])
            bits = int(np.bitwise_count(ngram_join.sketch(np.unique(a)) ^ ngram_join.sketch(np.unique(b))).sum())
            assert bits <= len(np.setxor1d(a, b)) and (bits or not lost + more)


def test_a_large_group_of_unlike_documents_makes_few_pairs(spark, monkeypatch):
    random_ = random.Random(8)
    common, rows, made = [f"c{i}" for i in range(150)], [], []
    for i in range(240):  # many share a signature, few link
        words = list(common)
        for at in random_.sample(range(150), 12 if i % 6 else 2):
            words[at] = f"n{i}w{at}"
        rows.append((i, " ".join(words)))

    def counted(pairs, met, new=ngram_join._new):
        made.append(pairs.count())
        return new(pairs, met)

    monkeypatch.setattr(ngram_join, "_new", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    assert got == brute.linked(rows, 4, 85)
    assert max(made) < 10 * len(rows), made


def test_wide_sketches_fold_to_half():
    random_ = np.random.default_rng(6)
    for n in (1, 64, 65, 200, 3000):
        tokens = random_.integers(0, 1 << 62, n).astype(np.uint64)
        wide = ngram_join.wide_sketch(tokens)
        assert n <= 64 * len(wide) < max(2 * n, 65)
        assert len(wide) == 1 or (wide[: len(wide) // 2] ^ wide[len(wide) // 2 :] == ngram_join.sketch(tokens, len(wide) // 2)).all()


def test_only_documents_of_pairs_that_may_link_are_shuffled(spark, monkeypatch):
    random_, rows, sides, passed = random.Random(9), [], [], []
    for i in range(300):  # long texts; 40 are in pairs, of which every other one is not quite alike
        words = [f"t{i}w{j}" for j in range(1500)]
        if 0 < i < 40 and i % 2:
            words = rows[-1][1].split()
            for at in random_.sample(range(1500), 90 if i % 4 == 1 else 20):
                words[at] = f"n{i}w{at}"
        rows.append((i, " ".join(words)))

    def joined(left, right, *more, old=ngram_join.spread_join):
        sides.append(right.count())
        return old(left, right, *more)

    def filtered(*args, old=ngram_join._filtered):
        out = old(*args)
        passed.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "spread_join", joined)
    monkeypatch.setattr(ngram_join, "_filtered", filtered)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs).collect()}
    assert got == brute.linked(rows, 4, 85) and sum(i != c for i, (_, c) in got.items()) == 10
    assert max(sides) <= 40 and sum(passed) <= 12, (sides, passed)


def test_texts_are_indexed_in_small_slices():
    none = np.zeros(0, np.int64)
    batch = pa.record_batch([pa.array(range(3000)), pa.array([f"a b c d e {i}" for i in range(3000)])], names=["doc", "text"])
    sizes = [b.num_rows for b in ngram_join._index(4, 85, ngram_join.Orders((none, none), (none, none)))([batch])]
    assert sum(sizes) == 3000 and max(sizes) <= 512


def test_links_of_odd_rows(odd, none):
    got = ngram_join.link_documents(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert [by[d].n_shingles for d in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert by[7].component_id == 6 and by[8].component_id == 5 and by[10].component_id == 9 and by[11].component_id == 11
    assert by[None].component_id is None and by[1].component_id == 1
    assert ngram_join.link_documents(none).collect() == []


# -- 3 mixing -----------------------------------------------------------------------


def test_mix_meets_its_targets_and_repeats(spark, sf_mid, sf_small):
    docs = documents(spark, sf_mid).withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 1000
    want = brute.targets({s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}})
    for source, target in want.items():
        rows = [r for r in got if r.source == source]
        assert math.isclose(rows[0].target, target, rel_tol=1e-9) and rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(brute.WORD.findall(texts[r.doc_id])) and r.taken <= 2 * r.size for r in got)


def test_mix_rounds_through_a_tree_without_bias(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("only").alias("source"))
    got = mixing.mix(docs, weights=(1,), share=0.7, bucket=16, fan_in=4).collect()
    assert abs(sum(r.taken for r in got) - 6300) <= 3 and {r.copies for r in got} == {0, 1}
    halves = [sum(r.copies for r in got if r.doc_id < 1500), sum(r.copies for r in got if r.doc_id >= 1500)]
    assert all(abs(h - 1050) < 120 for h in halves)


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken == r.copies * r.size for r in got)
    assert sum(r.source is None for r in got) > 0
    assert mixing.mix(none).collect() == []


# -- 4 fingerprints -----------------------------------------------------------------


def test_fingerprints_estimate_likeness(spark, small):
    rows = [(d, t) for d, t, _ in small]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, after, texts = table(fingerprints.fingerprints(docs)), brute.edited(rows), dict(rows)
    ids = sorted(texts, reverse=True)
    errors = []
    for i, d in enumerate(ids):
        assert got[d].edited_sha256 == hashlib.sha256(after[d].encode()).hexdigest() and got[d].n_chars == len(texts[d])
        errors.append(got[d].near_edited - brute.jaccard(texts[d], after[d], 5))
        errors.append(got[d].near_next - brute.jaccard(texts[d], texts[ids[(i + 1) % len(ids)]], 5))
    assert max(map(abs, errors)) < 0.16 and abs(np.mean(errors)) < 0.01
    prints = {}
    for d in ids:
        assert prints.setdefault(texts[d], got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_of_short_texts_fill_all_bins(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 40}" for j in range(n)) for i, n in enumerate([1, 4, 5, 6, 9, 20, 40, 90])]
    rows = spark.createDataFrame([(t, t + " more words at the end") for t in texts], "a string, b string")
    made = fingerprints.fingerprint(rows, {"x": "a", "y": "b"}).select(
        "a", "b", fingerprints.likeness(F.col("x"), F.col("y")).alias("near"), fingerprints.as_text(F.col("x")).alias("x")
    ).collect()
    assert all(len(r.x) == fingerprints.BINS for r in made)
    assert all(abs(r.near - brute.jaccard(r.a, r.b, 5)) < 0.2 for r in made[1:])


def test_fingerprints_shuffle_the_texts_once(spark, small, monkeypatch):
    plans, stored = [], fingerprints.stored

    def seen(df, name, *rest):
        if name == "fingerprints":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, *rest)

    monkeypatch.setattr(fingerprints, "stored", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fingerprints.fingerprints(spark.createDataFrame(small, "doc_id long, text string, source string")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plans[0]


def test_fingerprints_of_odd_rows(odd, none):
    rows = fingerprints.fingerprints(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    # Descending ids, then digests; rows without an id come last, and after the last the first.
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    line = sorted(((d is not None, d or 0, digest(t or ""), d, t or "") for d, t in ODD), reverse=True)
    texts = [x[-1] for x in line]
    want = []
    for (*_, d, t), after in zip(line, texts[1:] + texts[:1]):
        k = len(t) // 3
        want.append((str(d), len(t), digest(t[: len(t) - k] + after[:k])))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(want)
    got = {r.doc_id: r for r in rows}
    assert got[1].fingerprint == "" == got[3].fingerprint and got[6].fingerprint == got[7].fingerprint
    assert got[7].near_next == 1.0 and got[3].near_next == 1.0
    twice = [r for r in rows if r.doc_id == 14]
    assert len({r.fingerprint for r in twice}) == 1 and max(r.near_next for r in twice) == 1.0
    assert fingerprints.fingerprints(none).count() == 0
    one = odd.where("doc_id = 9")
    assert fingerprints.fingerprints(one).head().near_next == 1.0


# -- 5 chat -------------------------------------------------------------------------


def test_every_participant_becomes_the_assistant(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"),
        (None, 0, "ann", "x"), (None, 0, "ann", "x"), (None, 1, "system", "y"), (None, 1, None, "z"), (2, 0, "system", "alone"),
        (3, None, "ann", "last"), (3, 5, "ann", "first"), (3, None, "ann", "last"), (4, 0, "", ""), (4, 1, "a<|b", "t"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit(1))
    turns = turns.withColumn("n_turns", F.lit("x"))
    found = chat.perspectives(turns).collect()
    got = {(r.conv_id, r.speaker): r for r in found}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "ann"), (4, ""), (4, "a<|b")}
    assert got[1, "bob"].text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi <\\|im_end|><|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\n?<|im_end|>\n"
    )
    ann = got[1, "ann"]
    assert [ann.text[a:b] for a, b in zip(ann.mask_starts, ann.mask_ends)] == ["Hi <\\|im_end|><|im_end|>"]
    assert got[1, "bob"].n_turns == 5 and got[1, "bob"].trained_chars == 2 * len("<|im_end|>")
    last = got[3, "ann"]
    assert [last.text[a:b] for a, b in zip(last.mask_starts, last.mask_ends)] == [x + "<|im_end|>" for x in ("first", "last", "last")]
    assert "user name=a<\\|b\n" in got[4, ""].text
    # Rows without an id belong to no other row.
    alone = [r for r in found if r.conv_id is None]
    assert [(r.n_turns, r.text, r.mask_starts, r.mask_ends) for r in alone] == [
        (1, "<|im_start|>assistant\nx<|im_end|>\n", [22], [33])
    ] * 2


def test_long_dialogues_are_whole(spark, none):
    turns = spark.range(5000).selectExpr("'c' AS conv_id", "id AS turn", "if(id % 2 = 0, 'a', 'b') AS role", "string(id) AS text")
    got = chat.perspectives(turns.repartition(7)).collect()
    assert sorted((r.conv_id, r.speaker, r.n_turns) for r in got) == [("c", "a", 5000), ("c", "b", 5000)]
    for r in got:
        said = [r.text[a:b] for a, b in zip(r.mask_starts, r.mask_ends)]
        assert said == [f"{i}<|im_end|>" for i in range(r.speaker == "b", 5000, 2)]
        assert r.trained_chars == sum(map(len, said))
    assert chat.perspectives(turns.where("false")).collect() == []
    unnamed = spark.range(100_000).selectExpr("string(null) AS conv_id", "id AS turn", "'a' AS role", "'x' AS text")
    assert chat.perspectives(unnamed).agg(F.count("*"), F.max("n_turns")).head() == (100_000, 1)


# -- 6 SentencePiece ------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load()


@pytest.fixture(scope="module")
def reference(vocabulary):
    """The same pieces and scores as a unigram model of the public library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(unigram.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        piece.score = vocabulary.scores[i]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_encoding_is_the_best_segmentation(vocabulary, reference, small):
    encoder = unigram.Encoder(vocabulary)
    texts = [t for _, t, _ in small[:80]] + ["", "a", "  two  spaces ", "日本語😀\n\n\ttab", "\x00\x7f", "x" * 500, "é" * 300]
    for text, found in zip(texts, encoder.encode_all(texts)):
        got, want = np.frombuffer(found, np.int32).tolist(), reference.encode(text)
        assert encoder.decode(got) == text and encoder.encode(text) == found
        if got != want:  # equal scores may be told apart by rounding
            total = lambda ids: sum(vocabulary.scores[i] if i not in vocabulary.byte_ids else 0 for i in ids)
            assert math.isclose(total(got), total(want), rel_tol=1e-5)
            assert encoder.decode(want) == text


def test_a_vocabulary_with_markers_inside_is_one_unit():
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "a▁b", "▁a", "ab"]
    scores = [0.0] * 257 + [-3.0, -3.0, -3.0, -1.0, -2.0, -4.0]
    v = unigram.Vocabulary(pieces, scores, list(range(1, 257)), set(range(257)))
    assert v.words is None
    e = unigram.Encoder(v)
    assert [pieces[i] for i in np.frombuffer(e.encode("a b"), np.int32)] == ["▁", "a▁b"]
    assert [pieces[i] for i in np.frombuffer(e.encode("ü"), np.int32)] == ["▁", "<0xC3>", "<0xBC>"]
    assert e.decode([1, 256, 258]) == "\x00�a"


def test_double_array_holds_exactly_its_keys():
    keys = sorted({bytes(random.Random(i).choices(b"ab\x00\xff", k=1 + i % 6)) for i in range(300)})
    trie = unigram.DoubleArray(keys)

    def lookup(word):
        state = 0
        for c in word:
            step = trie.base[state] + c + 1
            if step >= len(trie.check) or trie.check[step] != state:
                return None
            state = step
        leaf = trie.base[state]
        return -trie.base[leaf] - 1 if leaf < len(trie.check) and trie.check[leaf] == state and trie.base[leaf] < 0 else None

    assert [lookup(k) for k in keys] == list(range(len(keys)))
    assert all(lookup(k + b"ab\x00\xffz") is None for k in keys)


def test_encoding_of_odd_rows(odd, none):
    got = unigram.encode(odd)
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    back = sorted((str(r.doc_id), r.text) for r in unigram.decode(got).collect())
    assert back == sorted((str(d), t or "") for d, t in ODD)
    assert unigram.encode(none).collect() == []


# -- 7 personal data ------------------------------------------------------------------

PRIVATE = [
    "write to a.b+c@x-y.example.org, or a@b.c.d%e@f.g and @x.y z@ q@w", "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.02.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111222222", "+1 (555) 123-4567. +49 30 12 +1234567890123456 +12",
    "日本 a@b.cd 😀 +44 20 7946 0958\n10.0.0.1", "x" * 5000 + "@y.z " + "9" * 4000, "a@b.c" * 700, "1.1.1.1 " * 1500, None, "",
]


def test_base_spans_of_personal_data(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    got = pii.find(docs.withColumn("kind", F.lit("x"))).select("doc_id", spans.listed(F.col("base"), list(pii.KINDS)).alias("s")).collect()
    for r in got:
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(PRIVATE[r.doc_id])), PRIVATE[r.doc_id]


def test_cards_of_single_digits_alone_in_a_text(spark):
    texts = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "a 4 1-1 1-1 1-1 1-1 1-1 1-1 1-1 1 b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert [tuple(b) for b in r.base] == brute.pii(texts[r.doc_id]) != []


def test_personal_data_of_a_whole_table(spark, sf_mid):
    texts = {r.doc_id: r.text for r in documents(spark, sf_mid).collect()}
    for r in entry.queries()["op7_pii"](spark, sf_mid).collect():
        want = brute.pii(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_boosted_trees_add_what_looks_and_stands_like_the_base(spark):
    random_ = random.Random(4)
    number = lambda: f"({random_.randrange(200, 999)}) 555-{random_.randrange(1000, 9999)}"
    rows = [(i, f"please call me at +1 {number()} today") for i in range(400)]
    rows += [(1000 + i, f"order {random_.randrange(10**11, 10**12)} of lot {i}.{i % 7}.{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = pii.proposals(docs).cache()
    trees = pii.fit(proposed)
    assert trees.trees and trees.thresholds
    scored = proposed.select("doc_id", F.explode("wide").alias("w")).select("doc_id", trees.score(F.col("w.f")).alias("p"), "w.kind")
    means = {r.good: r.p for r in scored.where("kind = 'phone'").groupBy((F.col("doc_id") < 1000).alias("good")).agg(F.max("p").alias("p")).collect()}
    assert means[True] > 0.8 > 0.5 > means.get(False, 0.0)
    assert all(r.added == [] for r in pii.find(docs).where("doc_id >= 1000").collect())
    proposed.unpersist()


def _iban(account):
    return f"DE{98 - int(account + '131400') % 97:02d}{account}"


def test_kinds_beyond_the_base_are_selected_by_evidence(spark):
    random_, rows, want = random.Random(6), [], {}
    n = lambda k: "".join(random_.choice("0123456789") for _ in range(k))

    def add(before, span, after, kind):
        if kind:
            want[len(rows)] = (kind, len(before), len(before) + len(span))
        rows.append((len(rows), before + span + after))

    for i in range(400):
        add("my ssn is ", f"{random_.randrange(100, 600)}-{random_.randrange(10, 99)}-{random_.randrange(1000, 9999)}", " ok", "national_id")
        add("part no ", f"9{n(2)}-{n(2)}-{n(4)}", " in stock", None)
        add("my iban is ", _iban(f"1{n(17)}"), " thanks", "iban")
        add("serial ", f"XQ{n(2)}{n(12)}", " thanks", None)
        add("write to ", f"joe{i} (at) site{i % 9} (dot) org", "", "email")
        add("the call is at ", f"(0{random_.randrange(30, 90)}) {random_.randrange(1000, 9999)} {random_.randrange(1000, 9999)}", ", bye", "phone")
        add("dims ", f"1{n(1)} 1{n(2)} 1{n(2)} 1{n(2)}", " mm", None)
        add("host ", f"10[.]{i % 250}[.]0[.]{i % 200}", " is up", "ip")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.added] for r in pii.find(docs).collect()}
    for kind in ("national_id", "iban", "email", "phone", "ip"):
        found = [w in got[i] for i, w in want.items() if w[0] == kind]
        assert sum(found) >= 0.95 * len(found), (kind, sum(found), len(found))
    assert not any(got[i] for i in got if i not in want)


def test_thresholds_of_rare_kinds_and_small_tables(spark):
    rows = [(i, f"lot {i % 10}.{i % 7}.{i % 3} and card 4{i:015d}") for i in range(2400)]
    rows += [(10_000 + i, f"write to joe{i} (at) site{i % 9} (dot) org") for i in range(20)]
    large = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = pii.proposals(large).cache()
    assert "email" in pii.fit(proposed, sample=300).thresholds
    proposed.unpersist()
    got = [len(r.added) for r in pii.find(large).where("doc_id >= 10000").collect()]
    assert got == [1] * 20
    small = [len(r.added) for r in pii.find(large.where("doc_id >= 10000")).collect()]
    assert small == [1] * 20


def test_evidence_of_a_kind(spark):
    good = {
        "email": ["a.b (at) c [dot] de", "x@y.org"], "ip": ["1.2.3.4", "10[.]0 (dot) 0.255"], "card": ["4222222222222", "4111 1111 1111 1111"],
        "phone": ["(212) 555-1234", "030 1234 5678", "0044 20 7946 0958"], "national_id": ["123-45-6789"],
        "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    }
    bad = {
        "email": ["a..b (at) c.de", "a@b.1"], "ip": ["1.2.3", "1.2.3.256"], "card": ["4222222222223", "9111 1111 1111 1111"],
        "phone": ["01.02.2024 12", "145.116.239.51", "112 113 1145"], "national_id": ["000-12-3456", "666-12-3456", "123-00-6789", "123-45-0000"],
        "iban": ["GB82 WEST 1234 5698 7654 33", "XX00 0000 0000"],
    }
    for kind in pii.KINDS:
        for texts, label in ((good, True), (bad, False)):
            rows = spark.createDataFrame([(t,) for t in texts[kind]], "t string").select("t", pii._evidence(kind, F.col("t")).alias("e")).collect()
            assert all(r.e is label for r in rows), rows


def test_redaction(spark):
    row = spark.createDataFrame([("mail a@b.cd or 1.2.3.4!", [("ip", 15, 22), ("email", 5, 11), ("card", 8, 11)])],
                                "t string, s array<struct<kind:string,start:int,end:int>>")
    assert row.select(pii.redact(F.col("t"), F.col("s"))).head()[0] == "mail [email] or [ip]!"


def test_personal_data_of_odd_rows(odd, none):
    assert pii.find(odd).count() == len(ODD)
    assert pii.find(none).collect() == []


# -- 8 quality ------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark, sf_mid):
    got = entry.queries()["op8_quality"](spark, sf_mid)
    labels = spark.read.parquet(f"{sf_mid}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93 and len(rows) > 40
    kept = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(kept) > 0.97
    assert got.count() == 1000 and got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0
    assert got.where("held_out <> (crc32(string(doc_id)) % 5 = 0)").count() == 0


def test_isotonic_curve_rises_and_averages():
    x, y = quality.isotonic(np.arange(5.0), np.array([1, 1, 2, 1, 1.0]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and np.isclose(y[1], 1 / 3)


def test_partition_sums_equal_one_ridge_fit(spark, sf_small):
    stats = quality.document_statistics(documents(spark, sf_small)).cache()
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    model = quality.fit(stats, labels)
    votes = {r.doc_id: float(r.quality) for r in labels.collect()}
    import zlib

    train = [r for r in stats.collect() if r.doc_id in votes and zlib.crc32(str(r.doc_id).encode()) % 5 in (1, 2, 3)]
    z = model.features(np.array([r.stats for r in train]))
    y = np.array([votes[r.doc_id] for r in train])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ want, z @ model.weights, atol=1e-6)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (9, 0), (99, 1)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in quality.score(odd, labels.where("false")).collect())
    assert quality.score(none, labels).collect() == []
    assert quality.keep_good(odd, labels.where("false")).count() == len(ODD)
    assert quality.keep_good(none, labels).columns == none.columns


# -- 9 secrets ------------------------------------------------------------------------

SECRET = [
    "password = 'abcdefgh1' PassWD:short token=\"abcdefgh\"; api_key=12345678 apikey: x.y/z+w=", "AKIA0123456789ABCD and AKIA12 AKIAAKIAAKIAAKIA",
    "0123456789abcdef0123456789abcdef and 0123456789abcdef0123456789abcde DEADBEEF" + "a" * 40, "secret" + " " * 30 + "= longenough token",
    "日本 token=12345678 😀", "tokentoken=abcdefghi secret:secret=abcdefgh", None, "",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
]


def test_base_spans_of_secrets(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRET)], "doc_id long, text string").withColumn("blob", F.lit(1))
    base = secret_scan.scan(docs, rules=secret_scan.BASE)
    for r in base.select("doc_id", spans.listed(F.col("findings"), ["assign", "access", "hex"]).alias("s")).collect():
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.secrets(SECRET[r.doc_id])), SECRET[r.doc_id]
    more = table(secret_scan.scan(docs))
    assert [f.kind for f in more[8].findings] == ["pem"]


def test_secrets_of_a_whole_table(spark, sf_mid):
    texts = {r.doc_id: r.text for r in documents(spark, sf_mid).collect()}
    for r in entry.queries()["op9_secret_scan"](spark, sf_mid).collect():
        want = brute.secrets(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]


def test_the_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "none")], "doc_id long, text string")
    first, rest = secret_scan.BASE[:1], secret_scan.BASE
    assert {r.doc_id: len(r.findings) for r in secret_scan.scan(docs, path, first).collect()} == {1: 1, 2: 1, 3: 0}
    assert spark.read.parquet(path).count() == 2
    secret_scan.scan(docs, path, first)
    assert spark.read.parquet(path).count() == 2  # nothing unseen
    grown = docs.union(spark.createDataFrame([(4, "AKIA0123456789ABCD")], docs.schema))
    got = {r.doc_id: [f.kind for f in r.findings] for r in secret_scan.scan(grown, path, rest).collect()}
    assert got == {1: ["assign"], 2: ["assign"], 3: [], 4: ["access"]}
    rows = spark.read.parquet(path).collect()
    pairs = [(r.blob, rule) for r in rows for rule in r.rules]
    assert len(pairs) == len(set(pairs)) == 9


def test_secrets_of_odd_rows(odd, none):
    assert secret_scan.scan(odd).count() == len(ODD)
    assert secret_scan.scan(none).collect() == []


# -- 10 exact dedup ---------------------------------------------------------------------


def _exact(rows):
    fold = lambda t: (t or "").translate(brute.ASCII_LOWER)
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    out = []
    for d, t in rows:
        ids = groups[fold(t)]
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("primes", "segment"), [(exact_dedup.PRIMES, 1 << 20), ((7, 11), 1 << 20), (exact_dedup.PRIMES, 1000)])
def test_exact_groups(spark, odd, small, primes, segment):
    """Also with so small primes that unlike texts share fingerprints, and with texts cut into segments."""
    rows = ODD + [(20_000 + i, t) for i, (_, t, _) in enumerate(small[:60])] + [(30_000 + i, f"{i:03d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs, primes, segment).collect()]
    assert sorted(got, key=str) == _exact(rows)


def test_fingerprints_combine(spark):
    poly = exact_dedup.Polynomial()
    text = bytes(random.Random(2).choices(range(256), k=5000))
    whole = poly.of([text], [0])[:, 0]
    for cut in (1, 1023, 1024, 3000):
        parts = poly.of([text[:cut], text[cut:]], [0, cut])
        assert [int(p.sum()) % prime for p, prime in zip(parts, exact_dedup.PRIMES)] == whole.tolist()


def test_exact_dedup_of_no_rows(none):
    assert exact_dedup.dedup(none).collect() == []


# -- the pipeline -----------------------------------------------------------------------


def test_pipeline_stages(spark, sf_mid):
    import corpus_pipeline

    docs = documents(spark, sf_mid)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf_mid).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = before, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    before, after = kept["near copies"]
    parts = brute.linked([(d, t) for d, t, _ in before], 5, 80)
    assert sorted(d for d, _, _ in after) == sorted(d for d, (_, c) in parts.items() if c == d)
    before, after = kept["line dedup"]
    sites = {}
    for d, t, s in before:
        for no, line in enumerate(t.split("\n")):
            sites.setdefault(line.strip(" \t\r"), []).append((d, no, s))
    common = {k: min((d, no) for d, no, _ in v) for k, v in sites.items() if k and len({s for *_, s in v}) >= line_dedup.MIN_SITES}
    want = {}
    for d, t, _ in before:
        lines = [x for no, x in enumerate(t.split("\n")) if common.get(x.strip(" \t\r"), (d, no)) == (d, no)]
        if len(lines) == t.count("\n") + 1 or brute.WORD.search("\n".join(lines)):
            want[d] = "\n".join(lines)
    assert {d: t for d, t, _ in after} == want
    before, after = kept["mixing"]
    assert {d for d, _, _ in after} <= {d for d, _, _ in before} and len(after) > len(before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_mid).collect()
    assert len(last) == len(after) and all(r.round_trip for r in last)


def test_pipeline_of_an_empty_table(spark, none, sf_small):
    import corpus_pipeline

    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_small).count() == 0
