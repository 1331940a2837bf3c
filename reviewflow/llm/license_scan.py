"""License scans by ordered signature rules.

A text is read as its lower-case words. Rules (``license_rules``) are patterns over
them, each gated by keywords: a text that lacks them is not matched against the
rule, and most texts hold no keyword at all. Detections that overlap are resolved
in order of priority, then length: one that lies inside a detection already
accepted, or around it, is dropped. A few base phrases are counted apart from the
rules and always stay.

Every text is scanned on its own, in the task that has read it; nothing is
shuffled, and what is broadcast with the code are the rules alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.license_rules import BASE, RULES, Rule
from reviewflow.llm.words import buffers
from reviewflow.session import ship_package

RUN = 1 << 22  # bytes of text lower-cased together
BASE_STRENGTH = 0.9
DETECTIONS = "array<struct<rule:string,label:string,start:int,end:int>>"
COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[0x00:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

Detection = tuple[int, int, Rule]  # first word, word after the last, rule


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[list[bytes], list[tuple[Rule, re.Pattern, list[list[int]]]]]:
    """The keywords, and each rule with its pattern and its gates as places among the keywords."""
    keywords = sorted({k for r in rules for gate in r.gates for k in gate})
    place = {k: i for i, k in enumerate(keywords)}
    ready = [(r, _pattern(r.pattern), [[place[k] for k in gate] for gate in r.gates]) for r in rules]
    return [k.encode() for k in keywords], ready


def _pattern(words: str) -> re.Pattern:
    return re.compile(f" (?:{words})(?= )".encode())


_BASE = [(label, _pattern(phrase), [w.encode() for w in phrase.split()]) for phrase, label in BASE.items()]


def resolve(found: list[Detection]) -> list[Detection]:
    """The detections that stay, by first word.

    They are taken by priority, length (both falling), first word and order of the
    rules; one inside or around an accepted one is dropped. Those that overlap in
    part both stay.
    """
    kept: dict[int, list[int]] = {}  # ends of accepted detections by their start
    out, longest = [], max((e - s for s, e, _ in found), default=0)
    for s, e, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0])):
        near = ((a, b) for a in range(s - longest, e) for b in kept.get(a, ()))
        if any((a <= s and e <= b) or (s <= a and b <= e) for a, b in near):
            continue
        kept.setdefault(s, []).append(e)
        out.append((s, e, rule))
    return sorted(out, key=lambda d: (d[0], d[1]))


def detect(low: bytes, rules: tuple[Rule, ...]) -> tuple[list[tuple[int, str]], list[Detection]]:
    """(base places: first word and label; resolved detections) of a lower-cased text."""
    keywords, ready = _compiled(rules)
    present = [k in low for k in keywords]
    due = [(r, p) for r, p, gates in ready if any(all(present[k] for k in gate) for gate in gates)]
    base = [(label, p) for label, p, words in _BASE if all(w in low for w in words)]
    if not due and not base:
        return [], []
    line = b" " + b" ".join(_WORDS.findall(low)) + b" "
    gaps = None
    places, found = [], []
    for target, patterns in ((places, base), (found, due)):
        for what, pattern in patterns:
            hits = [m.span() for m in pattern.finditer(line)]
            if not hits:
                continue
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
            for s, e in np.searchsorted(gaps, np.array(hits)).tolist():
                target.append((s, what) if target is places else (s, e, what))
    return sorted(places), resolve(found)


def score(strengths: dict[str, float]) -> float:
    """How sure it is that some license is stated: 1 less the product of what each label leaves open."""
    left = 1.0
    for label in sorted(strengths):
        left *= 1.0 - strengths[label]
    return 1.0 - left


def _row(low: bytes, rules: tuple[Rule, ...]) -> tuple:
    places, found = detect(low, rules)
    strengths: dict[str, float] = {}
    for label in [label for _, label in places]:
        strengths[label] = BASE_STRENGTH
    for _, _, rule in found:
        strengths[rule.label] = max(strengths.get(rule.label, 0.0), rule.strength)
    starts = [s for s, _ in places]
    return (
        len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})),
        ",".join(sorted(strengths)), score(strengths),
        [{"rule": r.name, "label": r.label, "start": s, "end": e} for s, e, r in found],
    )


def _scan(rules: tuple[Rule, ...], detections: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    spans = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ["key", *[c.split()[0] for c in COLUMNS.split(", ")], *(["detections"] if detections else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(buffers(batch.column(1))[1])
            part = np.cumsum(sizes) // RUN
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    yield rows(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    def rows(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, at = buffers(texts)
        at, data = at - at[0], _LOWER[data[at[0] : at[-1]]]
        word = _WORD[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = at[:-1][np.diff(at) > 0]  # a text's first byte goes on with no word
        first[edges] = word[edges]
        before = np.concatenate([[0], np.cumsum(first)])
        n_words = before[at[1:]] - before[at[:-1]]
        found = [_row(data[s:e].tobytes(), rules) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
        extra = [pa.array([f[6] for f in found], spans)] if detections else []
        return pa.RecordBatch.from_arrays([keys, pa.array(n_words, pa.int64()), *columns, *extra], names=names)

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, detections: bool = False) -> DataFrame:
    """Per row: the key, n_words, n_base, first_word, last_word, base_labels, labels, score and, if asked for, detections.

    Words are longest runs of a-z, 0-9 and signs beyond ASCII, after A-Z has been
    lower-cased. ``n_base`` counts the places of all base phrases, ``first_word`` and
    ``last_word`` are their least and greatest first word (from 0; null without any).
    ``labels`` holds the base labels and those of the rules' detections, distinct,
    sorted and joined with commas; ``score`` is 0 without and nears 1 with certain
    ones. ``detections`` gives rule, label and words (end exclusive) by first word.

    A null text is an empty one: no word, no label, score 0. Every row has its result,
    repeated ones too; keys may be null and of any type; other columns are not read.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, {COLUMNS}" + (f", detections {DETECTIONS}" if detections else "")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(rules, detections), schema).withColumnRenamed("key", key)
