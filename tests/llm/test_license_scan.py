"""License scans against a plain version: all rules on all texts, base phrases by comparing words."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewflow.llm import license_scan
from reviewflow.llm.common import documents
from reviewflow.llm.license_rules import BASE, NAMES, RULES, TEXTS, Rule

SCHEMA = "doc_id long, text string, key string, labels string, score int, n_words string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    base = []
    for phrase, label in BASE.items():
        of = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(of)] == of]
    line = "".join(" " + w for w in words) + " "
    found = []
    for no, rule in enumerate(RULES):
        for m in re.finditer(f" (?:{rule.pattern})(?= )", line):
            s = line[: m.start()].count(" ")
            found.append((-rule.priority, -m.group().count(" "), s, no, s + m.group().count(" "), rule))
    kept = []
    for _, _, s, _, e, rule in sorted(found, key=lambda f: f[:4]):
        if not any((a <= s and e <= b) or (s <= a and b <= e) for a, b, _ in kept):
            kept.append((s, e, rule))
    best = {label: license_scan.BASE_STRENGTH for _, label in base}
    for _, _, rule in kept:
        best[rule.label] = max(best.get(rule.label, 0), rule.strength)
    left = 1.0
    for label in sorted(best):
        left *= 1.0 - best[label]
    starts = [i for i, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
        ",".join(sorted(best)), 1.0 - left,
    )


ODD = [
    "", None, " ", "Under the MIT License", "under the mit license under THE mit-license.", "cc by nc cc by-nc", "xcc by nc", "cc by nc2",
    "Apache License, Version 2.0", "apache license version 20", "éunder the mit license", "under the mit licenseé", "under\nthe\tmit/license!",
    "cc by nc", "SPDX-License-Identifier: GPL-3.0-or-later", "İ under the mit license", "cc by nc " * 3000, "word " * 20000 + "under the mit license",
]


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, ODD[3]), (3, ODD[3]), (3, ODD[3])]
    docs = spark.createDataFrame([(k, t, "k", "l", 1, "n") for k, t in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=str)
    assert got == sorted(((k, *plain(t)) for k, t in rows), key=str)
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark, sf_mid):
    docs = documents(spark, sf_mid)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    licensed = [k for k, t in texts.items() if "licen" in lowered(t)]
    others = [k for k in sorted(texts) if len(texts[k] or "") < 5000][:300]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(docs).collect()}
    assert len(got) == len(texts) and len(licensed) > 5
    for k in {*licensed, *others}:
        assert got[k] == plain(texts[k])
    # Other documents have no label but that of a reserved right.
    for k in set(texts) - set(licensed):
        assert got[k][5] == ("all-rights-reserved" if "all rights reserved" in lowered(texts[k]) else "")


STATED = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc,cc-by-nc-sa",  # the base phrase stays
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "licensed under either of Apache License, Version 2.0 or MIT license at your option": "apache-2,mit",
    "// SPDX-License-Identifier: LGPL-2.1-only": "lgpl-2.1",
    "see https://www.gnu.org/licenses/gpl-3.0.en.html": "gpl-3",
    "Distributed under the terms of the GNU Lesser General Public License v3 or later": "lgpl-3",
    "distributed under the Foo Bar Company License": "unknown",
    "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "This file is subject to the Mozilla Public License": "mpl",
    "Copyright 2020 Someone. All rights reserved.": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
    "Available under the BSD 3-Clause License": "bsd-3",
    "simplified license terms, the BSD": "",
    "published by the Apache Software Foundation": "",
    "Ich fahre mit dem Rad, mit Lizenz": "",
    "The license plate was stolen under the bridge; copyright law is dull": "",
}


@pytest.mark.parametrize("text", STATED)
def test_stated_licenses(text):
    assert license_scan._row(lowered(text).encode(), RULES)[4] == STATED[text]


def test_rules_are_whole():
    assert len({r.name for r in RULES}) == len(RULES) > 300
    assert len(NAMES) < 200 and len(TEXTS) < 200
    for rule in RULES:
        assert rule.gates and all(gate for gate in rule.gates) and 0 < rule.strength < 1


def test_gates_hold_for_what_rules_match():
    """Texts made from the patterns themselves pass the gates of the rule that they match."""
    draw = random.Random(3)
    for rule in RULES:
        hits = 0
        for _ in range(60):
            text = made(rule.pattern, draw)
            if license_scan._pattern(rule.pattern).search(f" {text} ".encode()):
                hits += 1
                assert any(all(k in text for k in gate) for gate in rule.gates), (rule.name, text)
        assert hits > 20, rule.name


def made(pattern, draw):
    """A text that the pattern matches, by a walk over its parse."""
    import re._parser as parser

    def walk(items):
        out = ""
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "NOT_LITERAL":
                out += "w"
            elif op == "IN":
                kind, value = arg[0]
                out += "w" if str(kind) == "NEGATE" else chr(value if str(kind) == "LITERAL" else value[0])
            elif op == "BRANCH":
                out += walk(draw.choice(arg[1]))
            elif op == "SUBPATTERN":
                out += walk(arg[-1])
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                out += "".join(walk(inner) for _ in range(draw.randint(low, min(int(high), low + 2))))
            else:
                raise AssertionError(op)
        return out

    return walk(parser.parse(pattern))


spans = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.integers(1, 3)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(spans)
def test_resolution(parts):
    found = [(s, s + n, Rule(f"r{p}", "x", "", (), p, 0.5)) for s, n, p in parts]
    kept = license_scan.resolve(found)
    nested = lambda x, y: (x[0] <= y[0] and y[1] <= x[1]) or (y[0] <= x[0] and x[1] <= y[1])
    for i, x in enumerate(kept):
        assert not any(nested(x, y) for y in kept[i + 1 :])
    for x in found:
        better = [y for y in kept if nested(x, y)]
        assert any((y[2].priority, y[1] - y[0]) >= (x[2].priority, x[1] - x[0]) for y in better)


def test_textual_keys_and_detections(spark):
    docs = spark.createDataFrame([("x", "So: licensed under the GPL v2 or later!")], "name string, body string")
    (row,) = license_scan.scan(docs, "name", "body", detections=True).collect()
    assert row.name == "x" and [(d.rule, d.start, d.end) for d in row.detections] == [("notice:gpl-2", 1, 8)]
