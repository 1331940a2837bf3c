"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from reviewflow.llm import alignment
from reviewflow.llm.common import documents

A = Tokenizer.from_file(alignment.MODEL_A)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=alignment.MODEL_B)
LETTERS = alignment._byte_letters()
SCHEMA = "doc_id long, text string, a int, b int, n long, best boolean, key string, n_links string"


def spelt(text):
    """(ids, bytes) of the tokens of both, None where a text does not come back."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    of_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in a]
    of_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    return (a, of_a, b, of_b) if b"".join(of_a) == whole == b"".join(of_b) else None


def ranges(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows):
    """Rows of the contract, by comparing byte ranges."""
    per_doc, counts = [], Counter()
    for key, text in rows:
        found = spelt(text) if text else None
        if not found:
            per_doc.append((key, None))
            continue
        a, of_a, b, of_b = found
        ra, rb = ranges(of_a), ranges(of_b)
        links, low = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[low][1] <= s:
                low += 1
            j = low
            while j < len(rb) and rb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, i, j = [], 0, 0
        for end in common:
            ga, gb = [], []
            while i < len(ra) and ra[i][1] <= end:
                ga.append(str(a[i]))
                i += 1
            while j < len(rb) and rb[j][1] <= end:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        counts.update(links)
        per_doc.append((key, (len(a), len(b), groups, links)))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for key, found in per_doc:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        out.append((
            key, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(docs, **options):
    return sorted((tuple(r) for r in alignment.align_texts(docs, **options).collect()), key=str)


ODD = [
    "one", "two  words ", " lead", "  ", " ", "\n", "a\n b", "a\n  b \n", "tab\tand\r\n", "naïve café é  à la", "日本語 のテキスト。 ok", "😀 😀😀", "x  y　 z",
    "mark ▁ in text", "▁", "<|endoftext|> and <s> </s> <unk>", "it's we'll  they 've", "nul \x00 byte", "x" * 5000, "ab " * 4000, "1234567 89 0", "  q \u0085 r",
    "é combining", "ﬁ ligature ½", "don't.Stop  !!", "ｆｕｌｌ width", "  ogham ﻿ bom",
]


def test_odd_texts_equal_whole_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (90, ""), (91, None), (92, "one"), (92, "one"), (None, "one two one")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3, True, "k", "n") for k, t in rows], SCHEMA).repartition(5)
    want = plain(rows)
    assert result(docs) == want
    # The pair counts in many slices, with copies of rows.
    assert result(docs, pairs_at_once=40) == want
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_documents_equal_whole_texts(spark, sf_small):
    docs = documents(spark, sf_small).where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 100 and result(docs) == plain(rows)


def test_textual_keys_and_groups(spark):
    docs = spark.createDataFrame([("x", "some words here")], "name string, body string")
    (row,) = alignment.align_texts(docs, "name", "body", groups=True).collect()
    assert row.name == "x" and hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert len(row.groups.split(";")) == row.n_groups


def aligner():
    with open(alignment.MODEL_A, encoding="utf-8") as a, open(alignment.MODEL_B, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def test_runs_of_many_texts(monkeypatch):
    draw, both = random.Random(3), aligner()
    monkeypatch.setattr(alignment, "_aligner", lambda number, shared: both)
    texts = [draw.choice(ODD) + " ".join(draw.choice(ODD)[:9] for _ in range(draw.randrange(40))) for _ in range(200)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    sizes = []
    for run in (1, 500, 1 << 20):
        monkeypatch.setattr(alignment, "RUN", run)
        ids = pa.Table.from_batches(alignment._tokenize(0, None)([batch])).combine_chunks().to_batches()
        counts = Counter()
        for part in alignment._count_links(0, None)([x.select(["a", "b"]) for x in ids]):
            for row in part.to_pylist():
                counts[row["b"] << alignment._SHIFT | row["a"]] += row["n"]
        keys = np.array(sorted(counts), np.int64)
        most = Counter()
        for k, n in counts.items():
            most[k >> alignment._SHIFT] = max(most[k >> alignment._SHIFT], n)
        n = np.array([counts[k] for k in keys.tolist()], np.int64)
        best = np.array([counts[k] == most[k >> alignment._SHIFT] for k in keys.tolist()])
        table = SimpleNamespace(value=(keys, n, best))
        parts = list(alignment._sum_up(0, None, table, False)(ids))
        sizes.append(len(parts))
        got = [tuple(r[c] for c in ("key", *alignment.SUMS, "groups_sha256")) for part in parts for r in part.to_pylist()]
        assert sorted(got, key=str) == plain(list(enumerate(texts)))
    assert sizes[0] > sizes[1] > sizes[2] == 1


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 400), max_size=60), st.sets(st.integers(1, 400), max_size=60))
def test_alignment_of_any_ends(a, b):
    a, b = sorted(a | {401}), sorted(b | {401})
    groups, links = alignment.align(a, b)
    ra, rb = list(zip([0, *a], a)), list(zip([0, *b], b))
    assert sorted(links) == [(i, j) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
    assert groups == [(a.index(e) + 1, b.index(e) + 1) for e in a if e in set(b)]


def test_ids_by_ranks_equal_the_tokenizers():
    draw, both = random.Random(5), aligner()
    assert both.quick is not None
    signs = ["a", "the", "é", " ", " ", "  ", "\n", "\t", "'s", "'", "7", "!", "日", "\u2003", "\u3000", "\xa0", "ﬁ", "😀", "\x1c", "_", "Ｘ", "\u180e", "\u200b", "ⅷ", "²"]
    for _ in range(2000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(1, 40)))
        assert both._ids_a(" " + text) == A.encode(" " + text, add_special_tokens=False).ids
    every = "".join(chr(c) + draw.choice(" a1!\n") for c in range(0x10000) if both.steady[c])
    assert both.quick.encode_ordinary(every) == A.encode(every, add_special_tokens=False).ids


def test_link_counts(spark):
    docs = spark.createDataFrame([(1, "abc abc"), (2, "abc"), (3, None)], "doc_id long, text string")
    rows = alignment.link_counts(docs).collect()
    assert sum(r.n for r in rows) == sum(r.n_links for r in alignment.align_texts(docs).collect())
    assert {r.best for r in rows} <= {True, False} and docs.where(F.col("text").isNull()).count() == 1
