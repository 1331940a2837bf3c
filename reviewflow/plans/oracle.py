"""DuckDB SQL giving the expected result of each registered query.

Written independently of the operators: grids are evaluated directly, ranks are
plain window functions, the temperature is a chain of Newton steps, and what a
broken record must yield follows from its source instead of from parsing it.
"""

from __future__ import annotations

from reviewflow.plans import views
from reviewflow.plans.queries import CLASS_LOSS_WEIGHTS, CUES, CUE_SCALE, CURSOR, LOOKUP_ROW, SECOND_CUES, TEMPERATURES

T = f"{views.TEMPERATURE!r}::DOUBLE"
NAMES = ("neg", "neu", "pos")


def dbl(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def stamp(x: str) -> str:
    """ISO text with the fraction only when it is not zero."""
    return (
        f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN microsecond({x}) % 1000000 = 0 THEN '' ELSE strftime({x}, '.%f') END || 'Z'"
    )


def case(column: str, values: dict[str, str], other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {other} END"


def largest(*x: str) -> str:
    """Position of the first largest value."""
    values = "[" + ", ".join(x) + "]"
    return f"(list_position({values}, list_max({values})) - 1)::INTEGER"


def named(label: str) -> str:
    return f"(['neg', 'neu', 'pos'])[{label} + 1]"


def nested(*ctes: tuple[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n" + final


# --------------------------------------------------------------------------- views
REVIEWS = ("reviews", """
SELECT d.doc_id, lpad(printf('%x', d.doc_id), 24, '0') AS review_id, d.text, d.source AS movie_id,
       e.ts AS created_at
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id""")

CORPUS = ("corpus", r"""
SELECT d.doc_id,
       regexp_replace(d.text, '^[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS text,
       CASE WHEN toxic = 1 THEN 'neg' WHEN quality = 0 THEN 'neu' ELSE 'pos' END AS label,
       CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label_id
FROM documents d JOIN labels l USING (doc_id)""")


def logits(name: str, first: int, lift: float) -> tuple[str, str]:
    dims = ", ".join(
        f"embedding[{first + i + 1}]::DOUBLE * 16::DOUBLE + "
        f"CASE WHEN label % 3 = {i} THEN {dbl(lift)} ELSE 0::DOUBLE END AS z{i}"
        for i in range(3)
    )
    return name, f"SELECT vec_id AS row_key, label % 3 AS label_id, label, {dims} FROM embeddings"


A, B = logits("la", 0, 3.0), logits("lb", 3, 1.5)


def softmax(name: str, source: str, t: str = "1::DOUBLE") -> list[tuple[str, str]]:
    """CTEs adding calibrated scores ``s0..s2`` and probabilities ``p0..p2``."""
    scaled = ", ".join(f"z{i} / {t} AS s{i}" for i in range(3))
    e = ", ".join(f"exp(s{i} - greatest(s0, s1, s2)) AS e{i}" for i in range(3))
    p = ", ".join(f"e{i} / (e0 + e1 + e2) AS p{i}" for i in range(3))
    return [
        (f"{name}_s", f"SELECT *, {scaled} FROM {source}"),
        (f"{name}_e", f"SELECT *, {e} FROM {name}_s"),
        (name, f"SELECT *, {p} FROM {name}_e"),
    ]


def biased() -> str:
    return largest(*[f"s{i} + {dbl(b)}" for i, b in enumerate(views.CLASS_BIAS.bias)])


def passing() -> str:
    masked = [f"CASE WHEN p{i} >= {dbl(t)} THEN p{i} ELSE -1::DOUBLE END" for i, t in enumerate(views.THRESHOLDS.thresholds)]
    anyone = " OR ".join(f"p{i} >= {dbl(t)}" for i, t in enumerate(views.THRESHOLDS.thresholds))
    return f"CASE WHEN {anyone} THEN {largest(*masked)} ELSE {largest('p0', 'p1', 'p2')} END"


def decided(label: str) -> str:
    return nested(
        A, *softmax("c", "la", T), ("d", f"SELECT *, {label} AS lab FROM c"),
        final=f"SELECT row_key, lab AS label_id, {named('lab')} AS sentiment, "
              "round([p0, p1, p2][lab + 1], 9) AS confidence FROM d",
    )


def r9(x: str, name: str) -> str:
    return f"round({x}, 9) AS {name}"


MODEL_NAME = views.MODEL_A.name
PREDICTED = f"TIMESTAMP '{views.PREDICTED_AT[:-1].replace('T', ' ')}'"


def history_of(name: str, source: str, version: str, run: str, delay: str) -> list[tuple[str, str]]:
    return [
        *softmax(f"{name}_c", source, T),
        (f"{name}_d", f"SELECT *, {biased()} AS lab, lpad(printf('%x', row_key), 24, '0') AS rid FROM {name}_c"),
        (name, f"""
SELECT sha256('review:' || rid || chr(0) || '{MODEL_NAME}' || chr(0) || '{version}') AS prediction_id,
       1::SMALLINT AS schema_version, 'review:' || rid AS source_event_id, rid AS review_id,
       NULL::VARCHAR AS movie_id, NULL::VARCHAR AS source_created_at, {named('lab')} AS sentiment,
       lab::SMALLINT AS label_id, [p0, p1, p2][lab + 1] AS confidence, p0 AS probability_neg,
       p1 AS probability_neu, p2 AS probability_pos, '{MODEL_NAME}' AS model_name,
       '{version}' AS model_version, {run} AS model_run_id, e.ts AS predicted_at,
       e.ts + to_seconds({delay}) AS stored_at
FROM {name}_d JOIN events e ON e.event_id = row_key"""),
    ]


HISTORY = [
    A, B, *history_of("h1", "la", "1", "'run-a'", "60"),
    *history_of("h2", "lb", "2", "NULL::VARCHAR", "lab * 60"),
    ("history", "SELECT * FROM h1 UNION ALL SELECT * FROM h2"),
]
FLAT = (
    "prediction_id, schema_version, source_event_id, review_id, movie_id, source_created_at, sentiment, "
    f"label_id, {r9('confidence', 'confidence')}, "
    + ", ".join(r9(f"probability_{n}", f"probability_{n}") for n in NAMES)
    + f", model_name, model_version, model_run_id, {stamp('predicted_at')} AS predicted_at, "
    f"{stamp('stored_at')} AS stored_at"
)
LATEST = ("latest", """
SELECT * FROM history QUALIFY row_number() OVER (
  PARTITION BY review_id ORDER BY predicted_at DESC, stored_at DESC, prediction_id DESC) = 1""")

# --------------------------------------------------------------------------- records
EVENT_JSON = (
    "to_json({{'schema_version': 1, 'event_id': 'review:' || review_id, 'review_id': review_id, "
    "'movie_id': movie_id, 'text': text, 'source_created_at': {created}, 'emitted_at': '{emitted}'}})::VARCHAR"
).format(created=stamp("created_at"), emitted=views.EMITTED_AT)

FAULTY = ("faulty", f"SELECT *, {case('movie_id', {k: repr(v) for k, v in views.EVENT_FAULTS.items()}, repr('none'))} AS fault FROM reviews")

# What each fault must yield: error type, broken rules.
EVENT_ERRORS = {
    "null_value": ("ValueError", ""),
    "cut_json": ("ValidationError", "json_object"),
    "json_array": ("ValidationError", "json_object"),
    "bad_utf8": ("ValidationError", "json_object"),
    "version_text": ("ValidationError", "schema_version"),
    "version_two": ("ValidationError", "schema_version"),
    "unknown_field": ("ValidationError", "unknown_field"),
    "blank_text": ("ValidationError", "text"),
    "foreign_event_id": ("ValidationError", "event_id_matches"),
    "naive_time": ("ValidationError", "emitted_at"),
    "other_key": ("ValueError", ""),
    "null_key": ("ValueError", ""),
    "bad_utf8_key": ("UnicodeDecodeError", ""),
    "newline_review_id": ("ValidationError", "review_id"),
    "trailing_text": ("ValidationError", "json_object"),
}
ERROR_TYPE = case("fault", {k: f"'{v[0]}'" for k, v in EVENT_ERRORS.items()}, "NULL")
BROKEN = case("fault", {k: f"'{v[1]}'" for k, v in EVENT_ERRORS.items()}, "''")
POSITION = "(doc_id % 3)::INTEGER AS partition, doc_id // 3 AS \"offset\""
ERROR_MESSAGE = (
    "CASE WHEN fault = 'null_value' THEN 'message value is null' "
    "WHEN broken != '' THEN 'contract violated: ' || replace(broken, ',', ', ') "
    "WHEN fault = 'bad_utf8_key' THEN 'key is not valid UTF-8' "
    "WHEN error_type IS NOT NULL THEN 'key does not match review_id' END"
)
KEY = (
    "CASE fault WHEN 'other_key' THEN encode('review:' || review_id) WHEN 'bad_utf8_key' THEN '\\xC3\\x28'::BLOB "
    "WHEN 'null_key' THEN NULL ELSE encode(review_id) END"
)


def sent_json() -> str:
    """The payload text as sent, with its fault."""
    sent_id = "CASE fault WHEN 'upper_review_id' THEN upper(review_id) WHEN 'newline_review_id' THEN review_id || chr(10) ELSE review_id END"
    event_id = "CASE fault WHEN 'foreign_event_id' THEN 'review:' || repeat('f', 24) ELSE 'review:' || review_id END"
    text = "CASE fault WHEN 'blank_text' THEN chr(160) || chr(12288) ELSE text END"
    emitted = (
        "CASE fault WHEN 'naive_time' THEN '2026-01-01T00:00:00' "
        f"WHEN 'offset_time' THEN '2026-01-01T03:00:00+03:00' ELSE '{views.EMITTED_AT}' END"
    )
    body = (
        f"to_json({{'event_id': {event_id}, 'review_id': {sent_id}, 'movie_id': movie_id, 'text': {text}, "
        f"'source_created_at': {stamp('created_at')}, 'emitted_at': {emitted}}})::VARCHAR"
    )
    version = "CASE fault WHEN 'version_text' THEN '\"1\"' WHEN 'version_two' THEN '2' WHEN 'version_decimal' THEN '1.0' ELSE '1' END"
    return (
        "CASE WHEN fault = 'json_array' THEN '[' ELSE '' END || '{\"schema_version\":' || "
        f"{version} || ',' || CASE WHEN fault = 'unknown_field' THEN '\"extra\":true,' ELSE '' END || "
        f"CASE WHEN fault = 'cut_json' THEN '' ELSE substr({body}, 2) END || "
        "CASE fault WHEN 'json_array' THEN ']' WHEN 'trailing_text' THEN 'x' ELSE '' END"
    )


RECORDS = [
    REVIEWS, FAULTY,
    ("records", f"SELECT *, {KEY} AS key, {ERROR_TYPE} AS error_type, {BROKEN} AS broken, "
                f"CASE WHEN fault = 'null_value' THEN NULL ELSE encode({sent_json()}) || "
                "CASE WHEN fault = 'bad_utf8' THEN '\\xFF'::BLOB ELSE ''::BLOB END END AS value FROM faulty"),
    ("errors", f"SELECT *, {ERROR_MESSAGE} AS error_message FROM records"),
]
KEY_BASE64 = "CASE WHEN octet_length(key) > 0 THEN base64(key) END"
PAYLOAD = "coalesce(base64(value), '')"
PREDICTION_ID = f"sha256('review:' || review_id || chr(0) || '{MODEL_NAME}' || chr(0) || '1')"
CORE = "'sentiment': 'pos', 'label_id': 2, 'confidence': 0.8::DOUBLE, 'probabilities': {'neg': 0.1::DOUBLE, 'neu': 0.1::DOUBLE, 'pos': 0.8::DOUBLE}"
PREDICTION_JSON = (
    f"to_json({{{CORE}, 'schema_version': 1, 'prediction_id': {PREDICTION_ID}, "
    "'source_event_id': 'review:' || review_id, 'review_id': review_id, 'movie_id': movie_id, "
    f"'source_created_at': {stamp('created_at')}, "
    f"'model': {{'name': '{MODEL_NAME}', 'version': '1', 'run_id': 'run-a'}}, "
    f"'predicted_at': '{views.PREDICTED_AT}'}})::VARCHAR"
)
DEAD_JSON = (
    "'{\"schema_version\":1,\"worker\":\"sentiment-inference\",\"source_topic\":\"reviews.v1\",\"source_partition\":' || "
    "(doc_id % 3) || ',\"source_offset\":' || (doc_id // 3) || "
    f"coalesce(',\"key_base64\":\"' || {KEY_BASE64} || '\"', '') || ',\"payload_base64\":\"' || {PAYLOAD} || "
    "'\",\"error_type\":\"' || error_type || '\",\"error_message\":\"' || error_message || "
    f"'\",\"failed_at\":\"{views.PREDICTED_AT}\"}}'"
)
VALID = "error_type IS NULL"
PREDICTION_ERRORS = {
    "null_value": ("ValueError", ""),
    "label_mismatch": ("ValidationError", "label_mapping,confidence_matches"),
    "sum_off": ("ValidationError", "probability_sum"),
    "confidence_off": ("ValidationError", "confidence_matches"),
    "label_text": ("ValidationError", "label_id"),
    "model_extra": ("ValidationError", "unknown_model_field"),
    "blank_run": ("ValidationError", "model_run_id"),
    "other_prediction_id": ("ValidationError", "prediction_id"),
    "naive_time": ("ValidationError", "predicted_at"),
    "probability_text": ("ValidationError", "probabilities"),
    "other_key": ("ValueError", ""),
    "probability_missing": ("ValidationError", "probabilities"),
}
PREDICTION_FAULT = case("movie_id", {k: repr(v) for k, v in views.PREDICTION_FAULTS.items()}, "'none'")

# --------------------------------------------------------------------------- split
def split_of(source: str, key: str, extra: str = "") -> list[tuple[str, str]]:
    """CTEs ending in ``parts``: every row with its split, by plain ranks."""

    def share(name: str, previous: str, total: str, weight: str) -> list[tuple[str, str]]:
        return [
            (f"{name}_t", f"SELECT *, ({total})::BIGINT AS {name}_total, (sum({weight}) OVER ())::BIGINT AS {name}_sum FROM {previous}"),
            (f"{name}_f", f"SELECT *, {name}_total * {weight} // {name}_sum AS fl_{name}, {name}_total * {weight} % {name}_sum AS rest_{name} FROM {name}_t"),
            (f"{name}_s", f"SELECT *, fl_{name} + CASE WHEN row_number() OVER (ORDER BY rest_{name} DESC, label_id) "
                          f"<= {name}_total - sum(fl_{name}) OVER () THEN 1 ELSE 0 END AS {name} FROM {name}_f"),
        ]

    return [
        ("ranked", f"SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY md5('42:' || {key})) AS rk FROM {source}"),
        ("sizes", f"SELECT label_id, count(*) AS size FROM {source} GROUP BY label_id"),
        *share("held", "sizes", "(sum(size) OVER () * 3 + 9) // 10", "size"),
        *share("test", "held_s", "(sum(held) OVER () + 1) // 2", "held"),
        ("parts", "SELECT r.*, CASE WHEN rk <= size - held THEN 'train' WHEN rk <= size - test THEN 'val' "
                  "ELSE 'test' END AS split FROM ranked r JOIN test_s USING (label_id)"),
    ]


def f1_of(tp: str, true: str, pred: str) -> str:
    return f"CASE WHEN {true} + {pred} > 0 THEN 2 * {tp}::DOUBLE / ({true} + {pred}) ELSE 0::DOUBLE END"


def sums(label: str, pred: str) -> str:
    return ", ".join(
        f"count(*) FILTER ({label} = {c} AND {pred} = {c}) AS tp{c}, count(*) FILTER ({label} = {c}) AS t{c}, "
        f"count(*) FILTER ({pred} = {c}) AS q{c}"
        for c in range(3)
    )


F1 = [f1_of(f"tp{c}", f"t{c}", f"q{c}") for c in range(3)]
PRECISION = [f"CASE WHEN q{c} > 0 THEN tp{c}::DOUBLE / q{c} ELSE 0::DOUBLE END" for c in range(3)]
RECALL = [f"CASE WHEN t{c} > 0 THEN tp{c}::DOUBLE / t{c} ELSE 0::DOUBLE END" for c in range(3)]


def macro(values: list[str]) -> str:
    present = " + ".join(f"CASE WHEN t{c} + q{c} > 0 THEN 1 ELSE 0 END" for c in range(3))
    total = " + ".join(f"CASE WHEN t{c} + q{c} > 0 THEN {v} ELSE 0::DOUBLE END" for c, v in enumerate(values))
    return f"(({total}) / ({present}))"


def weighted(values: list[str]) -> str:
    return "((" + " + ".join(f"{v} * t{c}" for c, v in enumerate(values)) + ") / (t0 + t1 + t2))"


PREDICTED_ROWS = [A, *softmax("c", "la", T), ("d", f"SELECT *, {biased()} AS pred FROM c")]
TALLIED = [*PREDICTED_ROWS, ("s", f"SELECT {sums('label_id', 'pred')} FROM d")]
LOSS = "greatest(s0, s1, s2) + ln(exp(s0 - greatest(s0, s1, s2)) + exp(s1 - greatest(s0, s1, s2)) + exp(s2 - greatest(s0, s1, s2))) - [s0, s1, s2][label_id + 1]"


def newton(source: str, steps: int = 14) -> list[tuple[str, str]]:
    """CTEs b0, b1, ...: Newton steps for the inverse temperature; the last is ``fit``."""
    out = [("b0", "SELECT 1::DOUBLE AS b")]
    for i in range(steps):
        e = ", ".join(f"exp(b * z{c} - greatest(b * z0, b * z1, b * z2)) AS e{c}" for c in range(3))
        m1 = "(e0 * z0 + e1 * z1 + e2 * z2) / (e0 + e1 + e2)"
        m2 = "(e0 * z0 * z0 + e1 * z1 * z1 + e2 * z2 * z2) / (e0 + e1 + e2)"
        out.append((f"b{i + 1}", f"""
SELECT any_value(b) - avg(m1 - [z0, z1, z2][label_id + 1]) / avg(m2 - m1 * m1) AS b
FROM (SELECT *, {m1} AS m1, {m2} AS m2 FROM (SELECT *, {e} FROM {source}, b{i}))"""))
    out.append(("fit", f"SELECT 1 / b AS t FROM b{steps}"))
    return out


BIAS_GRID = "(SELECT i.range AS i, j.range AS j, i.range * 17 + j.range AS grid_idx, -2::DOUBLE + i.range * 0.25::DOUBLE AS bn, -2::DOUBLE + j.range * 0.25::DOUBLE AS bu FROM range(17) i, range(17) j)"
_step = repr((0.20 + 0.05) - 0.20)
THRESHOLD_GRID = (
    "(SELECT i.range * 169 + j.range * 13 + k.range AS grid_idx, "
    + ", ".join(f"0.2::DOUBLE + {v}.range * {_step}::DOUBLE AS t{c}" for c, v in enumerate("ijk"))
    + " FROM range(13) i, range(13) j, range(13) k)"
)


def bias_search(source: str) -> list[tuple[str, str]]:
    pred = largest("s0 + bn", "s1 + bu", "s2")
    return [
        ("bias_s", f"SELECT grid_idx, bn, bu, {sums('label_id', 'pred')} FROM (SELECT label_id, g.*, {pred} AS pred FROM {source}, {BIAS_GRID} g) GROUP BY ALL"),
        ("bias_f", f"SELECT grid_idx, bn, bu, {macro(F1)} AS f FROM bias_s"),
    ]


def threshold_search(source: str) -> list[tuple[str, str]]:
    masked = [f"CASE WHEN p{c} >= g.t{c} THEN p{c} ELSE -1::DOUBLE END" for c in range(3)]
    some = " OR ".join(f"p{c} >= g.t{c}" for c in range(3))
    pred = f"CASE WHEN {some} THEN {largest(*masked)} ELSE {largest('p0', 'p1', 'p2')} END"
    return [
        ("thr_s", f"SELECT grid_idx, h0, h1, h2, {sums('label_id', 'pred')} FROM (SELECT label_id, grid_idx, g.t0 AS h0, g.t1 AS h1, g.t2 AS h2, {pred} AS pred FROM {source}, {THRESHOLD_GRID} g) GROUP BY ALL"),
        ("thr_f", f"SELECT grid_idx, h0, h1, h2, {macro(F1)} AS f FROM thr_s"),
    ]


def strategies(source: str) -> list[tuple[str, str]]:
    """CTEs ending in ``compared``: the best of each strategy on scored rows."""
    return [
        ("arg_s", f"SELECT {sums('label_id', 'pred')} FROM (SELECT label_id, {largest('s0', 's1', 's2')} AS pred FROM {source})"),
        *bias_search(source),
        *threshold_search(source),
        ("compared", f"""
SELECT 0 AS place, 'argmax' AS strategy, NULL::DOUBLE AS b0, NULL::DOUBLE AS b1, NULL::DOUBLE AS h0, NULL::DOUBLE AS h1, NULL::DOUBLE AS h2, {macro(F1)} AS f FROM arg_s
UNION ALL (SELECT 1, 'class_bias', bn, bu, NULL, NULL, NULL, f FROM bias_f ORDER BY f DESC, grid_idx LIMIT 1)
UNION ALL (SELECT 2, 'thresholds', NULL, NULL, h0, h1, h2, f FROM thr_f ORDER BY f DESC, grid_idx LIMIT 1)"""),
    ]


SPLIT_A = [A, *split_of("la", "row_key"), ("val", "SELECT * FROM parts WHERE split = 'val'"),
           ("tst", "SELECT * FROM parts WHERE split = 'test'")]


def aligned() -> list[tuple[str, str]]:
    return [
        A, B, *softmax("pa", "la"), *softmax("pb", "lb"),
        ("al", "SELECT a.row_key, a.label_id, a.p0 AS a0, a.p1 AS a1, a.p2 AS a2, b.p0 AS b0, b.p1 AS b1, b.p2 AS b2 FROM pa a JOIN pb b USING (row_key)"),
    ]


WEIGHTS = "(SELECT range AS grid_idx, range * 0.05::DOUBLE AS w FROM range(21))"
MIXED = [f"w * a{c} + (1 - w) * b{c}" for c in range(3)]


def sweep(source: str) -> list[tuple[str, str]]:
    return [
        ("sw_s", f"SELECT grid_idx, w, {sums('label_id', 'pred')} FROM (SELECT label_id, grid_idx, w, {largest(*MIXED)} AS pred FROM {source}, {WEIGHTS}) GROUP BY ALL"),
        ("sw", f"SELECT grid_idx, w, {macro(F1)} AS f FROM sw_s"),
    ]


OWN_PRED, EXT_PRED = largest("a0", "a1", "a2"), largest("b0", "b1", "b2")
DISAGREE = f"avg(CASE WHEN {OWN_PRED} != {EXT_PRED} THEN 1::DOUBLE ELSE 0 END)"
BOTH_WRONG = f"avg(CASE WHEN {OWN_PRED} != label_id AND {EXT_PRED} != label_id THEN 1::DOUBLE ELSE 0 END)"

# --------------------------------------------------------------------------- scoring
def cue_scores(source: str) -> list[tuple[str, str]]:
    z = ", ".join(
        f"{dbl(CUE_SCALE)} * (length(text) - length(replace(text, '{c}', ''))) / length(text)::DOUBLE AS z{i}"
        for i, c in enumerate(CUES)
    )
    return [("cue", f"SELECT *, {z} FROM {source}"), *softmax("c", "cue", T),
            ("d", f"SELECT *, {biased()} AS lab FROM c")]


DOC_FAULT = case("movie_id", {k: repr(v) for k, v in views.DOCUMENT_FAULTS.items()}, "'none'")
TOKENS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda t: t != '')"


def cut(limit: int, head: int, tail: int) -> str:
    return f"CASE WHEN len(t) > {limit} THEN list_concat(t[1:{head}], t[len(t) - {tail - 1}:len(t)]) ELSE t END"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    p9 = ", ".join(r9(f"p{i}", f"p_{n}") for i, n in enumerate(NAMES))
    sql["softmax_probs"] = nested(A, *softmax("c", "la", T), final=f"SELECT row_key, {p9} FROM c")
    sql["decide_argmax"] = decided(largest("s0", "s1", "s2"))
    sql["decide_class_bias"] = decided(biased())
    sql["decide_thresholds"] = decided(passing())
    sql["prediction_id"] = nested(REVIEWS, final=(
        f"SELECT review_id, 'review:' || review_id AS event_id, {PREDICTION_ID} AS prediction_id FROM reviews"))
    sql["review_events"] = nested(REVIEWS, final=(
        "SELECT 1 AS schema_version, 'review:' || review_id AS event_id, review_id, movie_id, md5(text) AS text_md5, "
        f"{stamp('created_at')} AS source_created_at, '{views.EMITTED_AT}' AS emitted_at FROM reviews"))
    sql["prediction_events"] = nested(REVIEWS, final=(
        "SELECT 'pos' AS sentiment, 2 AS label_id, 0.8::DOUBLE AS confidence, 0.1::DOUBLE AS p_neg, 0.1::DOUBLE AS p_neu, "
        f"0.8::DOUBLE AS p_pos, 1 AS schema_version, {PREDICTION_ID} AS prediction_id, 'review:' || review_id AS source_event_id, "
        f"review_id, movie_id, {stamp('created_at')} AS source_created_at, '{MODEL_NAME}' AS model_name, "
        f"'1' AS model_version, 'run-a' AS model_run_id, '{views.PREDICTED_AT}' AS predicted_at FROM reviews"))
    sql["history_rows"] = nested(*HISTORY, final=f"SELECT {FLAT} FROM history")
    sql["latest_prediction"] = nested(*HISTORY, LATEST, final=f"SELECT {FLAT} FROM latest")
    sql["sentiment_summary"] = nested(*HISTORY, LATEST, final=(
        "SELECT sentiment, count(*) AS reviews, round(avg(confidence), 9) AS mean_confidence FROM latest GROUP BY sentiment"))
    sql["event_envelope"] = nested(REVIEWS, final=(
        f"SELECT review_id AS key, md5({EVENT_JSON}) AS value_md5, 'reviews.v1' AS topic, 'content-type' AS header_1, "
        "'application/json' AS header_1_value, 'schema-version' AS header_2, '1' AS header_2_value FROM reviews"))
    sql["route_by_topic"] = nested(*RECORDS, final=(
        f"SELECT CASE WHEN {VALID} THEN 'predictions.v1' ELSE 'reviews.dlq.v1' END AS topic, {POSITION}, "
        f"base64(key) AS key_base64, md5(CASE WHEN {VALID} THEN {PREDICTION_JSON} ELSE {DEAD_JSON} END) AS value_md5 FROM errors"))
    sql["dead_letters"] = nested(*RECORDS, final=(
        "SELECT 1 AS schema_version, 'sentiment-inference' AS worker, 'reviews.v1' AS source_topic, "
        f"(doc_id % 3)::INTEGER AS source_partition, doc_id // 3 AS source_offset, {KEY_BASE64} AS key_base64, "
        f"md5({PAYLOAD}) AS payload_md5, error_type, error_message, '{views.PREDICTED_AT}' AS failed_at "
        f"FROM errors WHERE NOT ({VALID})"))
    wall = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')"
    sql["validate_review"] = nested(REVIEWS, ("f", f"SELECT *, {DOC_FAULT} AS fault FROM reviews"), final=(
        "SELECT CASE fault WHEN 'short_id' THEN review_id[1:23] WHEN 'newline_id' THEN review_id || chr(10) ELSE review_id END AS review_id, "
        "md5(CASE fault WHEN 'unicode_blank_text' THEN chr(160) || ' ' || chr(28) || chr(12288) "
        "WHEN 'ascii_blank_text' THEN ' ' || chr(9) || chr(10) ELSE text END) AS text_md5, "
        "CASE fault WHEN 'tab_movie' THEN chr(9) WHEN 'null_movie' THEN NULL ELSE movie_id END AS movie_id, "
        f"CASE fault WHEN 'naive_time' THEN NULL WHEN 'offset_time' THEN {stamp('(created_at - INTERVAL 210 MINUTE)')} "
        f"ELSE {stamp('created_at')} END AS created_at, "
        "CASE fault WHEN 'short_id' THEN 'review_id' WHEN 'newline_id' THEN 'review_id' WHEN 'unicode_blank_text' THEN 'text' "
        "WHEN 'ascii_blank_text' THEN 'text' WHEN 'tab_movie' THEN 'movie_id' WHEN 'naive_time' THEN 'created_at' ELSE '' END AS violations FROM f"))
    sql["validate_store_document"] = nested(REVIEWS, ("f", f"SELECT *, {DOC_FAULT} AS fault FROM reviews"), final=(
        "SELECT doc_id, CASE fault WHEN 'short_id' THEN '_id' WHEN 'newline_id' THEN '_id' WHEN 'ascii_blank_text' THEN 'text' "
        "WHEN 'tab_movie' THEN 'movie_id' ELSE '' END AS violations FROM f"))
    ok = lambda x: f"CASE WHEN {VALID} THEN {x} END"
    sql["validate_event"] = nested(*RECORDS, final=(
        f"SELECT {POSITION}, error_type, broken AS violations, {ok(chr(39) + 'review:' + chr(39) + ' || review_id')} AS event_id, "
        f"{ok('review_id')} AS review_id, {ok('movie_id')} AS movie_id, {ok('md5(text)')} AS text_md5, "
        f"{ok(stamp('created_at'))} AS source_created_at, {ok(repr(views.EMITTED_AT))} AS emitted_at FROM errors"))
    sql["validate_prediction"] = nested(A, *softmax("c", "la", T), ("d", f"SELECT *, {largest('s0', 's1', 's2')} AS lab FROM c"), final=(
        "SELECT row_key, CASE label WHEN 0 THEN CASE WHEN lab = 2 THEN CASE WHEN abs(p2 - p0) > 1e-6 THEN 'label_mapping,confidence_matches' ELSE 'label_mapping' END "
        "ELSE CASE WHEN abs([p0, p1, p2][lab + 1] - p2) > 1e-6 THEN 'label_mapping,confidence_matches' ELSE 'label_mapping' END END "
        "WHEN 1 THEN CASE WHEN p0 + 2e-6::DOUBLE > 1 THEN CASE WHEN lab = 0 THEN 'confidence,probabilities' ELSE 'probabilities' END ELSE 'probability_sum' END "
        "WHEN 2 THEN CASE WHEN p0 + 5e-7::DOUBLE > 1 THEN CASE WHEN lab = 0 THEN 'confidence,probabilities' ELSE 'probabilities' END ELSE '' END "
        "WHEN 3 THEN 'confidence_matches' "
        "WHEN 4 THEN CASE WHEN lab = 0 THEN 'confidence,probabilities' ELSE 'probabilities' END "
        "WHEN 5 THEN 'label_id' "
        "WHEN 6 THEN 'sentiment,label_mapping' "
        "WHEN 7 THEN CASE WHEN lab = 0 THEN 'confidence,probabilities' ELSE 'probabilities' END ELSE '' END AS violations FROM d"))
    errors = {k: f"'{v[0]}'" for k, v in PREDICTION_ERRORS.items()}
    broken = {k: f"'{v[1]}'" for k, v in PREDICTION_ERRORS.items()}
    sql["validate_prediction_event"] = nested(
        REVIEWS,
        ("f", f"SELECT *, {PREDICTION_FAULT} AS fault FROM reviews"),
        ("g", f"SELECT *, {case('fault', errors, 'NULL')} AS error_type, {case('fault', broken, repr(''))} AS violations FROM f"),
        final=(
            f"SELECT {POSITION}, error_type, violations, {ok(PREDICTION_ID)} AS prediction_id, {ok('2')} AS label_id, "
            f"{ok('CASE fault WHEN ' + repr('sum_within') + ' THEN 0.1000005::DOUBLE ELSE 0.1::DOUBLE END')} AS p_neu, "
            f"{ok(repr('run-a'))} AS run_id, {ok(repr(views.PREDICTED_AT))} AS predicted_at FROM g"))
    sql["check_constraints"] = nested(*HISTORY, final=(
        "SELECT prediction_id, CASE model_version || '/' || label_id WHEN '1/0' THEN 'movie_id_non_blank' WHEN '1/1' THEN '' "
        "WHEN '1/2' THEN 'model_run_id_non_blank' WHEN '2/0' THEN 'confidence_range,confidence_matches_label' "
        "WHEN '2/1' THEN 'confidence_matches_label' ELSE 'schema_version_v1' END AS violations FROM history"))
    sql["uniqueness_violations"] = nested(*HISTORY, final=(
        "SELECT 'primary_key' AS constraint_name, prediction_id AS key, 2::BIGINT AS n FROM h1 "
        "UNION ALL SELECT 'model_identity', source_event_id || '|' || model_name || '|' || model_version, 2 FROM h1 "
        "UNION ALL SELECT 'model_identity', source_event_id || '|' || model_name || '|' || model_version, 2 FROM h2"))
    sql["quarantine_split"] = nested(*RECORDS, final=(
        f"SELECT (doc_id % 3)::INTEGER AS partition, count(*) AS n, CASE WHEN {VALID} THEN 'valid' ELSE 'quarantine' END AS side "
        "FROM errors GROUP BY ALL"))

    kept = ("kept", "SELECT * FROM corpus WHERE text != '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY label_id, doc_id) = 1")
    sql["clean_corpus"] = nested(CORPUS, kept, final="SELECT doc_id, md5(text) AS text_md5, label, label_id FROM kept")
    sql["clean_report"] = nested(CORPUS, kept, final=(
        "SELECT (SELECT count(*) FROM corpus) AS rows_before, (SELECT count(*) FROM kept) AS rows_after, "
        "(SELECT count(*) FROM corpus) - (SELECT count(*) FROM kept) AS removed"))
    sql["class_counts"] = nested(CORPUS, final="SELECT label, count(*) AS n FROM corpus GROUP BY label")
    split = split_of("corpus", "doc_id")
    sql["stratified_split"] = nested(CORPUS, *split, final="SELECT doc_id, label_id, split FROM parts")
    sql["class_shares"] = nested(CORPUS, *split, final=(
        "SELECT split, label, count(*) AS n, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split) * 1000, 0)::DOUBLE / 1000 AS share "
        "FROM parts GROUP BY split, label"))
    sql["class_weights"] = nested(CORPUS, final=(
        "SELECT label_id, count(*) AS n, round((SELECT count(*) FROM corpus)::DOUBLE / (3 * count(*)), 9) AS weight FROM corpus GROUP BY label_id"))
    quantiles = ", ".join(f"round(quantile_cont(n_tokens, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99))
    shares = ", ".join(f"round_even(avg(CASE WHEN n_tokens > {k} THEN 1::DOUBLE ELSE 0 END) * 1000, 0)::DOUBLE / 1000 AS share_over_{k}" for k in (512, 256))
    sql["length_profile"] = nested(
        ("lens", f"SELECT len({TOKENS}) + 2 AS n_tokens FROM documents"),
        final=f"SELECT count(*) AS n, round(avg(n_tokens), 6) AS mean, round(stddev_samp(n_tokens), 6) AS std, {quantiles}, "
              f"min(n_tokens) AS min, max(n_tokens) AS max, {shares} FROM lens")
    sql["head_tail"] = nested(
        ("toks", f"SELECT doc_id, {TOKENS} AS t FROM documents"),
        ("cut", f"SELECT doc_id, t, {cut(510, 256, 254)} AS l, {cut(254, 128, 126)} AS s FROM toks"),
        final="SELECT doc_id, len(t)::INTEGER AS n, len(l)::INTEGER AS n_long, md5(array_to_string(l, ' ')) AS long_md5, "
              "len(s)::INTEGER AS n_short, md5(array_to_string(s, ' ')) AS short_md5 FROM cut")

    sql["confusion"] = nested(*PREDICTED_ROWS, final="SELECT label_id, pred, count(*) AS n FROM d GROUP BY ALL")
    classes = " UNION ALL ".join(
        f"SELECT '{n}' AS class, {r9(PRECISION[c], 'precision')}, {r9(RECALL[c], 'recall')}, {r9(F1[c], 'f1')}, t{c} AS support FROM s"
        for c, n in enumerate(NAMES))
    means = " UNION ALL ".join(
        f"SELECT '{name}', round({of(PRECISION)}, 9), round({of(RECALL)}, 9), round({of(F1)}, 9), t0 + t1 + t2 FROM s"
        for name, of in (("macro avg", macro), ("weighted avg", weighted)))
    sql["per_class_report"] = nested(*TALLIED, final=f"{classes} UNION ALL {means}")
    sql["eval_metrics"] = nested(*TALLIED, final=(
        f"SELECT {r9(macro(F1), 'macro_f1')}, round((tp0 + tp1 + tp2)::DOUBLE / (t0 + t1 + t2), 9) AS accuracy, "
        f"{r9(macro(PRECISION), 'macro_precision')}, {r9(macro(RECALL), 'macro_recall')}, "
        + ", ".join(r9(F1[c], f"f1_{n}") for c, n in enumerate(NAMES)) + " FROM s"))
    w = "[" + ", ".join(dbl(CLASS_LOSS_WEIGHTS[c]) for c in range(3)) + "][label_id + 1]"
    sql["weighted_ce"] = nested(A, *softmax("c", "la"), final=f"SELECT round(sum({w} * ({LOSS})) / sum({w}), 9) AS weighted_ce FROM c")
    temps = ", ".join(f"({dbl(t)})" for t in TEMPERATURES)
    sql["nll_by_temperature"] = nested(
        A, ("tt", f"SELECT * FROM (VALUES {temps}) v(temperature)"), ("x", "SELECT * FROM la, tt"),
        *softmax("c", "x", "temperature"), final=f"SELECT temperature, round(avg({LOSS}), 9) AS nll FROM c GROUP BY temperature")
    sql["temperature_fit"] = nested(
        A, *newton("la"), ("x", "SELECT * FROM la, fit"), *softmax("c", "x", "t"),
        final=f"SELECT round(any_value(t), 6) AS temperature, round(avg({LOSS}), 9) AS nll FROM c")
    sql["grid_class_bias"] = nested(A, *softmax("c", "la", T), *bias_search("c"), final=(
        "SELECT grid_idx::INTEGER AS grid_idx, bn AS bias_neg, bu AS bias_neu, round(f, 9) AS macro_f1 FROM bias_f"))
    sql["grid_thresholds"] = nested(A, *softmax("c", "la", T), *threshold_search("c"), final=(
        "SELECT grid_idx::INTEGER AS grid_idx, round(h0, 9) AS threshold_neg, round(h1, 9) AS threshold_neu, "
        "round(h2, 9) AS threshold_pos, round(f, 9) AS macro_f1 FROM thr_f"))
    chosen = [*SPLIT_A, *softmax("c", "val", T), *strategies("c")]
    sql["strategy_compare"] = nested(*chosen, final=(
        "SELECT place, strategy, round(b0, 9) AS bias_neg, round(b1, 9) AS bias_neu, round(h0, 9) AS threshold_neg, "
        "round(h1, 9) AS threshold_neu, round(h2, 9) AS threshold_pos, round(f, 9) AS macro_f1 FROM compared"))
    sql["strategy_select"] = nested(*chosen, final=(
        "SELECT place, strategy, round(f, 9) AS macro_f1 FROM compared ORDER BY f DESC, place LIMIT 1"))
    plain = ("plain", f"SELECT {macro(F1)} AS f FROM (SELECT {sums('label_id', 'pred')} FROM (SELECT label_id, {largest('z0', 'z1', 'z2')} AS pred FROM tst))")
    gain = "round(w.f, 9) AS test_macro_f1, round(plain.f, 9) AS baseline_test_macro_f1, round(w.f - plain.f, 9) AS gain"
    sql["heldout_gain"] = nested(
        *SPLIT_A, plain, *softmax("c", "tst", T),
        ("w", f"SELECT {macro(F1)} AS f FROM (SELECT {sums('label_id', 'pred')} FROM (SELECT label_id, {biased()} AS pred FROM c))"),
        final=f"SELECT {gain} FROM w, plain")
    any_pass = " OR ".join(f"p{c} >= h{c}" for c in range(3))
    masked = largest(*[f"CASE WHEN p{c} >= h{c} THEN p{c} ELSE -1::DOUBLE END" for c in range(3)])
    by_strategy = (
        f"CASE strategy WHEN 'argmax' THEN {largest('s0', 's1', 's2')} WHEN 'class_bias' THEN {largest('s0 + b0', 's1 + b1', 's2')} "
        f"ELSE CASE WHEN {any_pass} THEN {masked} ELSE {largest('p0', 'p1', 'p2')} END END")
    sql["calibration_report"] = nested(
        *SPLIT_A, plain, *newton("val"), ("vx", "SELECT * FROM val, (SELECT t FROM fit)"), *softmax("c", "vx", "t"), *strategies("c"),
        ("best", "SELECT * FROM compared ORDER BY f DESC, place LIMIT 1"),
        ("tx", "SELECT tst.*, fit.t FROM tst, fit"), *softmax("tc", "tx", "t"),
        ("w", f"SELECT {macro(F1)} AS f FROM (SELECT {sums('label_id', 'pred')} FROM (SELECT label_id, {by_strategy} AS pred "
              "FROM tc, (SELECT strategy, b0, b1, h0, h1, h2 FROM best)))"),
        final=f"SELECT round(fit.t, 6) AS temperature, best.strategy, round(best.f, 9) AS val_macro_f1, {gain} FROM fit, best, w, plain")

    mixed = [f"{dbl(0.55)} * a{c} + (1 - {dbl(0.55)}) * b{c}" for c in range(3)]
    sql["ensemble_probs"] = nested(*aligned(), final=(
        "SELECT row_key, " + ", ".join(r9(f"b{c}", f"external_{n}") for c, n in enumerate(NAMES)) + ", "
        + ", ".join(r9(mixed[c], f"mixed_{n}") for c, n in enumerate(NAMES)) + " FROM al"))
    sql["ensemble_sweep"] = nested(*aligned(), *sweep("al"), final=(
        "SELECT grid_idx::INTEGER AS grid_idx, round(w, 9) AS weight, round(f, 9) AS macro_f1 FROM sw"))
    sql["ensemble_diagnostics"] = nested(*aligned(), final=(
        f"SELECT round({DISAGREE}, 9) AS disagreement_rate, round({BOTH_WRONG}, 9) AS both_wrong_rate FROM al"))
    scored = lambda name, pred: (name, f"SELECT {sums('label_id', 'pred')} FROM (SELECT label_id, {pred} AS pred FROM ts)")
    sql["ensemble_report"] = nested(
        *aligned(), *split_of("al", "row_key"),
        ("vs", "SELECT * FROM parts WHERE split = 'val'"), *sweep("vs"),
        ("best", "SELECT * FROM sw ORDER BY f DESC, grid_idx LIMIT 1"),
        ("ts", "SELECT parts.*, best.w FROM parts, best WHERE split = 'test'"),
        scored("o_s", OWN_PRED), scored("x_s", EXT_PRED), scored("e_s", largest(*MIXED)),
        ("o", f"SELECT {macro(F1)} AS f FROM o_s"), ("x", f"SELECT {macro(F1)} AS f FROM x_s"),
        ("e", f"SELECT {macro(F1)} AS f, " + ", ".join(f"{F1[c]} AS f{c}" for c in range(3)) + " FROM e_s"),
        ("g", f"SELECT {DISAGREE} AS dis, {BOTH_WRONG} AS wrong FROM ts"),
        final="SELECT 'external-demo' AS external_name, '2,0,1' AS external_permutation, round(o.f, 9) AS own_macro_f1, round(x.f, 9) AS external_macro_f1, round(best.w, 9) AS best_weight, "
              "round(best.f, 9) AS val_macro_f1, round(e.f, 9) AS ensemble_macro_f1, round(e.f0, 9) AS ensemble_f1_neg, "
              "round(e.f1, 9) AS ensemble_f1_neu, round(e.f2, 9) AS ensemble_f1_pos, round(e.f - o.f, 9) AS gain, "
              "round(dis, 9) AS disagreement_rate, round(wrong, 9) AS both_wrong_rate FROM o, x, e, g, best")

    count = lambda c, i: f"{dbl(CUE_SCALE)} * (length(text) - length(replace(text, '{c}', ''))) / length(text)::DOUBLE AS z{i}"
    cues = lambda chosen: ", ".join(count(c, i) for i, c in enumerate(chosen))
    sql["ensemble_scored"] = nested(
        CORPUS, ("own", "SELECT doc_id, label_id, text FROM corpus WHERE text != ''"),
        ("oz", f"SELECT doc_id AS row_key, label_id, {cues(CUES)} FROM own"), *softmax("pa", "oz"),
        ("xt", f"SELECT doc_id, {TOKENS} AS t FROM own"), ("xs", f"SELECT doc_id, array_to_string({cut(254, 128, 126)}, ' ') AS text FROM xt"),
        ("xz", f"SELECT doc_id AS row_key, {cues(SECOND_CUES)} FROM xs"), *softmax("pb", "xz"),
        ("al", "SELECT a.row_key, a.label_id, a.p0 AS a0, a.p1 AS a1, a.p2 AS a2, b.p2 AS b0, b.p0 AS b1, b.p1 AS b2 FROM pa a JOIN pb b USING (row_key)"),
        *sweep("al"), final="SELECT grid_idx::INTEGER AS grid_idx, round(w, 9) AS weight, round(f, 9) AS macro_f1 FROM sw")
    sql["keyset_page"] = nested(REVIEWS, final=(
        f"SELECT review_id, md5(text) AS text_md5 FROM reviews WHERE review_id > '{CURSOR}' ORDER BY review_id LIMIT 50"))
    sql["keyset_mixed_case"] = nested(REVIEWS, final=(
        "SELECT review_id, md5(text) AS text_md5, ((row_number() OVER (ORDER BY review_id) - 1) // 50)::INTEGER AS page "
        f"FROM reviews WHERE review_id > '{CURSOR}' ORDER BY review_id LIMIT 150"))
    sql["lookback_publish"] = nested(REVIEWS, final="SELECT review_id, 1::BIGINT AS published FROM reviews")
    sql["history_compact"] = nested(*HISTORY, final="SELECT prediction_id, review_id, sentiment, model_version FROM history")
    sql["text_classifier"] = nested(
        CORPUS, kept, *split_of("kept", "doc_id"),
        ("t", "SELECT label_id, count(*) AS n FROM parts WHERE split = 'test' GROUP BY label_id"),
        final="SELECT label_id, n AS n_test, n AS n_scored, "
              "round(2 * (max(n) OVER ())::DOUBLE / ((max(n) OVER ()) + (sum(n) OVER ())) / (count(*) OVER ()), 9) AS majority_macro_f1, "
              "true AS beats_majority FROM t")
    sql["advance_cursor"] = nested(
        ("new", "SELECT source, lang, max(doc_id) AS id FROM documents GROUP BY ALL"),
        ("old", "SELECT source, lang, max(doc_id * (1 + toxic)) AS id FROM documents JOIN labels USING (doc_id) GROUP BY ALL"),
        final="SELECT source AS checkpoint_id, 1 AS schema_version, lpad(printf('%x', greatest(new.id, old.id)), 24, '0') AS last_review_id, "
              f"lang AS source_collection, 'reviews.v1' AS target_topic, '{views.EMITTED_AT}' AS updated_at "
              "FROM new FULL JOIN old USING (source, lang)")
    sql["next_offsets"] = (
        "SELECT 'reviews.v1' AS topic, (doc_id % 3)::INTEGER AS partition, max(doc_id // 3) + 1 AS next_offset FROM documents GROUP BY ALL")
    sql["insert_if_absent"] = nested(*HISTORY, final=(
        f"SELECT prediction_id, review_id, model_version, 2 AS arrival, {stamp('predicted_at')} AS predicted_at FROM h2"))
    sql["history_lookup"] = nested(*HISTORY, final=(
        "SELECT prediction_id, review_id, sentiment, model_version FROM history "
        f"WHERE review_id = lpad(printf('%x', {LOOKUP_ROW}), 24, '0') AND model_version = '1'"))
    sql["history_counts"] = nested(*HISTORY, final="SELECT sentiment, model_name, model_version, count(*) AS n FROM history GROUP BY ALL")
    sql["history_delete"] = nested(*HISTORY, final=(
        "SELECT prediction_id, review_id, model_version FROM history WHERE review_id NOT IN (SELECT review_id FROM h2 WHERE sentiment = 'neg')"))
    sql["history_table"] = nested(*HISTORY, final=(
        f"SELECT prediction_id, review_id, sentiment, label_id, {r9('confidence', 'confidence')}, model_version, model_run_id, "
        f"{stamp('predicted_at')} AS predicted_at, true AS stored FROM history"))
    sql["corpus_snapshot"] = sql["clean_corpus"]
    sql["corpus_csv"] = nested(CORPUS, final="SELECT doc_id, md5(text) AS text_md5, label, label_id FROM corpus")
    sql["decide_from_report"] = nested(
        *SPLIT_A, *newton("val"), ("vx", "SELECT * FROM val, (SELECT t FROM fit)"), *softmax("c", "vx", "t"), *strategies("c"),
        ("best", "SELECT * FROM compared ORDER BY f DESC, place LIMIT 1"),
        ("tx", "SELECT la.*, fit.t FROM la, fit"), *softmax("tc", "tx", "t"),
        final=f"SELECT row_key, label_id, {by_strategy} AS pred FROM tc, (SELECT strategy, b0, b1, h0, h1, h2 FROM best)")
    sql["cursor_identity"] = nested(REVIEWS, final=(
        "SELECT 'pipeline-' || doc_id % 3 AS checkpoint_id, 'none' AS before, max(review_id) AS last_review_id, "
        "CASE WHEN count(*) > 1 THEN 'CursorRegression' ELSE max(review_id) END AS backwards, "
        "CASE WHEN count(*) > 1 THEN 'CursorConflict' ELSE max(review_id) END AS outdated, "
        "'CursorMismatch' AS other_source, 'CursorMismatch' AS other_topic FROM reviews GROUP BY doc_id % 3"))
    sql["incremental_publish"] = nested(REVIEWS, final=(
        "SELECT NULL::VARCHAR AS error_type, 'review:' || review_id AS event_id, movie_id, md5(text) AS text_md5, "
        f"{stamp('created_at')} AS source_created_at, (SELECT max(review_id) FROM reviews) AS cursor FROM reviews"))
    sql["scored_predictions"] = nested(*cue_scores("documents"), final=(
        f"SELECT doc_id, lab AS label_id, {named('lab')} AS sentiment, round([p0, p1, p2][lab + 1], 9) AS confidence, {p9} FROM d"))
    sql["stream_history"] = nested(*RECORDS, *cue_scores(f"(SELECT * FROM errors WHERE {VALID})"), final=(
        f"SELECT {PREDICTION_ID} AS prediction_id, review_id, movie_id, {stamp('created_at')} AS source_created_at, "
        f"{named('lab')} AS sentiment, lab::SMALLINT AS label_id, round([p0, p1, p2][lab + 1], 9) AS confidence, "
        "'1' AS model_version, 'run-a' AS model_run_id FROM d"))
    sql["stream_history_deduped"] = sql["stream_history"]
    sql["stream_dead_letters"] = nested(*RECORDS, final=(
        "SELECT 'reviews.v1' AS source_topic, (doc_id % 3)::INTEGER AS source_partition, doc_id // 3 AS source_offset, "
        f"{KEY_BASE64} AS key_base64, error_type, error_message FROM errors WHERE NOT ({VALID})"))
    return sql
