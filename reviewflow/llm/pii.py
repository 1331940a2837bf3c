"""Personal data: proposed spans, scored by boosted trees, selected by calibrated thresholds.

Generators propose spans with high recall, which may overlap. A span of the base
patterns that passes its check is personal data for certain and always stays.
For each kind trees are boosted on a bounded sample of proposals. A proposal's label is its
evidence: the rules that numbers and addresses of its kind obey, such as check
digits and numbering plans, or that it lies within a base span of its kind. The
features are others, of format and context, and hold none of these rules. A
proposal outside the base is selected when its score reaches its kind's
threshold, the least at which the calibration rows show the required precision.
The trees become CASE expressions, so scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewflow.llm import spans
from reviewflow.session import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "iban")
SAMPLE = 20_000  # proposals used for fitting, an equal part for each kind, chosen by hash
PRECISION = 0.98
ROUNDS, DEPTH, STEP = 6, 3, 0.3

# Fixed patterns of the base. Possessive quantifiers, look-behinds and the least
# number of digits only save work: they change no match that passes its check.
LOCAL = r"A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators beyond the base; their spans may overlap it and each other.
AT = r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?"
DOT = r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?"
WIDE_PATTERNS = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++{AT}[A-Za-z0-9-]++"
             r"(?:\x20?(?:\.|[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}])\x20?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,4}}+(?:(?:\.|{DOT})[0-9]{{1,4}}+)++",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Words that speak for a kind when they stand before a span.
CUES = {
    "email": "mail|contact|write|reply", "ip": r"\bip|host|server|address", "card": "card|visa|credit|pay",
    "phone": "tel|phone|call|fax|mobile|cell", "national_id": "ssn|social|insurance|national", "iban": "iban|account|bank",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string has a valid check digit."""
    def add(total, i):
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether every part between dots is a number of at most 255."""
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return F.when(F.length(bare) > 3, F.lit(False)).when(bare == "", F.lit(True)).otherwise(bare.cast("int") <= 255)

    return F.forall(F.split(text, r"\."), small)


def _passes(kind: str, text: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(text))
    if kind == "ip":
        return _octets(text)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _plain(text: Column) -> Column:
    """``text`` with written-out at signs and dots as signs."""
    return F.regexp_replace(F.regexp_replace(text, AT, "@"), rf"{DOT}|\x20?\.\x20?", ".")


# An address whose host ends in a name, without empty parts.
_ADDRESS = (r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*"
            r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$")
# International numbers; national ones with a trunk zero; North American ones.
_DIALLED = r"^(?:00[1-9][0-9]{7,12}|0[1-9][0-9]{8,9}|1?[2-9][0-9]{2}[2-9][0-9]{6})$"
_DATE = r"^(?:[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9])(?![0-9])"
_QUAD = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"
_SSN = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"


def _mod97(text: Column) -> Column:
    """Whether the check digits of an account number are right."""
    bare = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))

    def add(rest, c):
        letter = F.ascii(c) - 55
        return F.when(c >= "A", rest * 100 + letter).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1)


def _evidence(kind: str, text: Column) -> Column:
    """Whether a proposal obeys the rules of its kind."""
    digits = _digits(text)
    if kind == "email":
        return _plain(text).rlike(_ADDRESS)
    if kind == "ip":
        plain = _plain(text)
        return (F.size(F.split(plain, r"\.")) == 4) & _octets(plain)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19) & digits.rlike("^[2-6]"), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        abroad = F.startswith(text, F.lit("+")) & digits.rlike("^[1-9][0-9]{9,14}$")
        return abroad | (digits.rlike(_DIALLED) & ~text.rlike(_DATE) & ~text.rlike(_QUAD))
    if kind == "national_id":
        return text.rlike(_SSN)
    return _mod97(text)


FEATURES = [*[f"is_{k}" for k in KINDS], "length", "letters", "groups", "dots", "spaces", "hyphens",
            "cue", "glued_before", "glued_after", "at_line_start"]


def _features(kind: str, s: Column) -> list[Column]:
    text = s["text"]
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return [
        *[F.lit(float(k == kind)) for k in KINDS], F.least(F.length(text), F.lit(64)),
        F.least(F.length(F.regexp_replace(text, "[^A-Za-z]", "")), F.lit(40)),
        F.least(F.size(F.split(text, "[^A-Za-z0-9]+")), F.lit(12)), F.least(count("."), F.lit(8)), F.least(count(" "), F.lit(8)),
        F.least(count("-"), F.lit(8)),
        F.lower(s["before"]).rlike(CUES[kind]).cast("int"), s["before"].rlike("[A-Za-z0-9]$").cast("int"),
        s["after"].rlike("^[A-Za-z0-9]").cast("int"), (s["before"] == "").cast("int"),
    ]


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda s: _passes(kind, s["text"]))


def _described(name: str, kind: str) -> Column:
    def label(s):
        if kind not in BASE:
            return _evidence(kind, s["text"])
        return _evidence(kind, s["text"]) | F.exists(f"base_{kind}", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))

    return F.transform(name, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        F.array(*[c.cast("double") for c in _features(kind, s)]).alias("f"), label(s).cast("double").alias("label"),
    ))


def proposals(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base (kind, start, end) and wide (kind, start, end, f, label), all of its proposals.

    ``f`` are the features, ``label`` is 1 where there is evidence. A null text has none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("number", F.col("text").rlike("[0-9][ .-]?[0-9]"))
    has = lambda *texts: F.expr(" OR ".join(f"contains(text, '{t}')" for t in texts))
    number = F.col("number")
    dotted = F.col("text").rlike(r"[0-9](?:\.|\x20?[\[({])")
    gates = {
        "email": has("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": number, "phone": has("+"),
        "wide_email": has("at)", "at]", "at}", "AT)", "AT]", "AT}", "@)", "@]", "@}", " )", " ]", " }"),
        "wide_ip": dotted, "wide_card": number, "wide_phone": number,
        "wide_national_id": F.col("text").rlike("[0-9]-[0-9]"), "wide_iban": F.col("text").rlike("[A-Z]{2}[0-9]{2}"),
    }
    patterns = {k: (p, gates[k]) for k, p in BASE_PATTERNS.items()}
    patterns |= {f"wide_{k}": (p, gates[f"wide_{k}"]) for k, p in WIDE_PATTERNS.items()}
    found = spans.find(rows, "text", patterns)
    found = found.withColumns({f"base_{k}": _checked(k) for k in BASE})
    wide = []
    for kind in KINDS:
        for name in (f"wide_{kind}", kind):
            if name in patterns:
                wide.append(_described(name, kind))
    return found.select(
        "doc_id", F.concat(*[spans.labelled(F.col(f"base_{k}"), k) for k in BASE]).alias("base"), F.concat(*wide).alias("wide")
    )


@dataclass
class Trees:
    """Boosted trees of all kinds as nested tests, and the threshold of each kind (none: nothing is added)."""

    trees: list[tuple[float, object]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, f: Column) -> Column:
        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * self._value(root, f)
        return 1 / (1 + F.exp(-2 * total))

    def _value(self, node, f: Column) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, low, high = node
        return F.when(F.get(f, F.lit(feature)) <= threshold, self._value(low, f)).otherwise(self._value(high, f))


def _read_tree(node):
    """A fitted tree's node as (feature, threshold, low, high) or its prediction."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _read_tree(node.leftChild()), _read_tree(node.rightChild())


def _threshold(cells: list, precision: float) -> float | None:
    """The least score from which on the counted ``cells`` hold the share ``precision`` of good ones."""
    found, n, good = None, 0, 0
    for cell in sorted({c.cell for c in cells}, reverse=True):
        n += sum(c.n for c in cells if c.cell == cell)
        good += sum(c.good for c in cells if c.cell == cell)
        if good >= precision * n:
            found = cell / 200
    return found


def fit(proposed: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Trees:
    """Boost on at most about ``sample`` proposals, as many of each kind; a fifth of the documents calibrates.

    All proposals of that fifth are counted, whatever the sample. A kind with none
    of them takes the threshold at which those of all kinds together are precise.
    """
    rows = proposed.select("doc_id", F.explode("wide").alias("w")).select(
        "doc_id", "w.kind", "w.f", "w.label",
        F.pmod(F.xxhash64("doc_id", "w.start", "w.kind"), F.lit(1 << 30)).alias("draw"),
        (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).alias("calibrates"),
    )
    rows = stored(rows, "pii-proposals")
    counts = {r.kind: r.n for r in rows.where("NOT calibrates").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    drawn = F.lit(False)
    for kind, n in counts.items():
        drawn = drawn | ((F.col("kind") == kind) & (F.col("draw") < int(min(1.0, sample / len(KINDS) / n) * (1 << 30))))
    train = rows.where(~F.col("calibrates") & drawn).coalesce(4).select("kind", "label", array_to_vector("f").alias("features"))
    train = stored(train, "pii-train")
    seen = {r.kind: r for r in train.groupBy("kind").agg(F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    trees = Trees()
    for kind in (k for k in KINDS if k in seen):
        found = [(1.0, 2 * seen[kind].low - 1)]  # nothing to tell apart: one leaf
        if seen[kind].low < seen[kind].high:
            model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=5).fit(train.where(F.col("kind") == kind))
            found = [(w, _read_tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]
        trees.trees += [(w, (FEATURES.index(f"is_{kind}"), 0.5, 0.0, root)) for w, root in found]
    cells = (
        rows.where("calibrates").withColumn("cell", F.floor(trees.score(F.col("f")) * 200))
        .groupBy("kind", "cell").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    )
    together = _threshold(cells, precision)
    for kind in seen:
        own = [c for c in cells if c.kind == kind]
        least = _threshold(own, precision) if own else together
        if least is not None:
            trees.thresholds[kind] = least
    return trees


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, base and added, arrays of (kind, start, end).

    ``base`` are the base matches that pass their checks, ``added`` the selected
    proposals that overlap none of them. Offsets are code points, ends exclusive.
    Null and empty texts have no spans; identical rows each have theirs; null ids
    are kept; other columns are not read. A kind whose proposals in
    the calibrating documents have no evidence adds nothing, nor does a table
    without calibrating documents.
    """
    proposed = stored(proposals(docs), "pii-candidates")
    trees = fit(proposed)
    added = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if trees.thresholds:
        least = F.create_map(*[F.lit(x) for item in trees.thresholds.items() for x in item])
        chosen = F.filter("wide", lambda w: F.coalesce(trees.score(w["f"]) >= F.element_at(least, w["kind"]), F.lit(False)))
        proposed = proposed.withColumn("chosen", chosen)
        free = F.filter("chosen", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        added = F.array_distinct(F.transform(free, lambda w: F.struct(w["kind"].alias("kind"), w["start"].alias("start"), w["end"].alias("end"))))
    return proposed.select("doc_id", "base", added.alias("added"))


def redact(text: Column, found: Column) -> Column:
    """``text`` with each span (kind, start, end) replaced by its kind in brackets.

    Of overlapping spans the one that starts first, then the longest, is written;
    the other's rest is removed with it.
    """
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def write(state, s):
        gap = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        name = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], -s["back"]).alias("at"), F.concat(state["out"], gap, name).alias("out"))

    return F.aggregate(ordered, start, write, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
