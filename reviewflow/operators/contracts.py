"""Contract checks for reviews, events, predictions and stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reviewflow.functions import chain, ids, matches, quoted
from reviewflow.functions.text import has_ascii_nonspace, is_nonblank
from reviewflow.operators.rules import Rule, fence, violations
from reviewflow.schema import LABELS, PROBABILITY_TOLERANCE, SCHEMA_VERSION

# The recorded error types.
NULL_OR_KEY_ERROR = "ValueError"
CONTRACT_ERROR = "ValidationError"
KEY_DECODE_ERROR = "UnicodeDecodeError"

_NUMBER_TYPES = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"
_LITERAL_TYPES = r"\A(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)\z"
_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)


# --------------------------------------------------------------------------- typed rows
def validate_reviews(df: DataFrame, id_column: str = "review_id") -> DataFrame:
    """Review documents with a normalised id and a ``violations`` array.

    Columns beyond the contract are dropped. ``created_at`` may be an instant
    or a text, which then needs an offset.
    """
    rules = [
        ("review_id", "_id_ok IS NULL"),
        ("text", f"NOT {is_nonblank('text')}"),
        ("movie_id", f"movie_id IS NOT NULL AND NOT {is_nonblank('movie_id')}"),
    ]
    instant = "created_at"
    if df.schema["created_at"].dataType.typeName() == "string":
        instant = ids.parse_utc("created_at")
        rules.append(("created_at", "created_at IS NOT NULL AND _instant IS NULL"))
    checked = df.selectExpr(
        f"CAST({id_column} AS STRING) AS _id_text", "text", "movie_id", "created_at",
        f"{ids.object_id(id_column)} AS _id_ok", f"{instant} AS _instant",
    )
    return checked.selectExpr(
        "coalesce(_id_ok, _id_text) AS review_id", "text", "movie_id", "_instant AS created_at",
        f"{violations(rules)} AS violations",
    )


def review_store_violations(id_column: str = "_id") -> str:
    """The looser check of the document store: ASCII white space only."""
    return violations(
        [
            ("_id", f"NOT {matches(id_column, r'\A[0-9a-fA-F]{24}\z')}"),
            ("text", f"NOT {has_ascii_nonspace('text')}"),
            ("movie_id", f"movie_id IS NOT NULL AND NOT {has_ascii_nonspace('movie_id')}"),
        ]
    )


def _in_unit(p: str) -> str:
    return f"coalesce({p} BETWEEN 0.0D AND 1.0D, false)"


def prediction_rules(sentiment: str, label_id: str, confidence: str, p: dict[str, str]) -> list[Rule]:
    """Rules of a prediction core; NULL breaks a rule."""
    ranged = chain(p.values(), "coalesce({0} BETWEEN 0.0D AND 1.0D, false)", " AND ")
    total = " + ".join(p.values())
    named = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(LABELS))
    chosen = " ".join(f"WHEN '{n}' THEN {x}" for n, x in p.items())
    far = f"> {PROBABILITY_TOLERANCE!r}D"
    return [
        ("sentiment", f"NOT coalesce({sentiment} IN ({_LABEL_LIST}), false)"),
        ("label_id", f"NOT coalesce({label_id} IN (0, 1, 2), false)"),
        ("confidence", f"NOT {_in_unit(confidence)}"),
        ("probabilities", f"NOT ({ranged})"),
        ("label_mapping", f"{sentiment} != CASE {label_id} {named} END"),
        ("probability_sum", f"({ranged}) AND abs({total} - 1.0D) {far}"),
        (
            "confidence_matches",
            f"({ranged}) AND {_in_unit(confidence)} AND abs({confidence} - CASE {sentiment} {chosen} END) {far}",
        ),
    ]


def validate_predictions(df: DataFrame) -> DataFrame:
    """Add ``violations`` to typed prediction cores."""
    probs = {label: f"probabilities.{label}" for label in LABELS}
    rules = prediction_rules("sentiment", "label_id", "confidence", probs)
    return df.selectExpr("*", f"{violations(rules)} AS violations")


def history_checks() -> list[Rule]:
    """The storage constraints of a history row; an unknown result passes."""
    columns = [f"probability_{x}" for x in LABELS]
    near = f"<= {PROBABILITY_TOLERANCE!r}D"
    mapping = " OR ".join(f"(label_id = {i} AND sentiment = '{n}')" for i, n in enumerate(LABELS))
    chosen = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(columns))
    checks = [
        ("schema_version_v1", f"schema_version = {SCHEMA_VERSION}"),
        ("prediction_id_sha256", matches("prediction_id", ids.PREDICTION_ID_PATTERN)),
        ("review_id_object_id", matches("review_id", ids.OBJECT_ID_PATTERN)),
        ("source_event_id", f"source_event_id = {ids.event_id('review_id')}"),
        ("movie_id_non_blank", "trim(movie_id) != ''"),
        ("sentiment", f"sentiment IN ({_LABEL_LIST})"),
        ("label", "label_id BETWEEN 0 AND 2"),
        ("label_mapping", mapping),
        ("confidence_range", "confidence BETWEEN 0.0D AND 1.0D"),
        *[(f"{c}_range", f"{c} BETWEEN 0.0D AND 1.0D") for c in columns],
        ("probability_sum", f"abs({' + '.join(columns)} - 1.0D) {near}"),
        ("confidence_matches_label", f"abs(confidence - CASE label_id {chosen} END) {near}"),
        ("model_name_non_blank", "trim(model_name) != ''"),
        ("model_version_non_blank", "trim(model_version) != ''"),
        ("model_run_id_non_blank", "trim(model_run_id) != ''"),
    ]
    required = (
        "prediction_id", "schema_version", "source_event_id", "review_id", "sentiment", "label_id",
        "confidence", *columns, "model_name", "model_version", "predicted_at",
    )
    return [(f"{name}_not_null", f"{name} IS NULL") for name in required] + [
        (name, f"NOT ({passed})") for name, passed in checks
    ]


def check_constraints(df: DataFrame) -> DataFrame:
    """Add the names of the storage constraints each history row breaks."""
    return df.selectExpr("*", f"{violations(history_checks())} AS violations")


# --------------------------------------------------------------------------- JSON events
_END = "end of the payload"


def _v(path: str) -> str:
    """The column that holds a member as VARIANT."""
    return "_v_" + path.replace(".", "_")


def _type_of(path: str) -> str:
    return "_t_" + path.replace(".", "_")


def _absent(path: str) -> str:
    """Whether the member is missing or null."""
    return f"{_type_of(path)} IN ('MISSING', 'VOID')"


def _as(path: str, as_type: str) -> str:
    return f"try_variant_get({_v(path)}, '$', '{as_type}')"


def _string(path: str) -> str:
    return f"CASE WHEN {_type_of(path)} = 'STRING' THEN {_as(path, 'string')} END"


def _number(path: str) -> str:
    return f"CASE WHEN {matches(_type_of(path), _NUMBER_TYPES)} THEN {_as(path, 'double')} END"


def _literal(path: str) -> str:
    """A number or boolean usable as a literal integer."""
    return f"CASE WHEN {matches(_type_of(path), _LITERAL_TYPES)} THEN {_as(path, 'double')} END"


def _unknown(members: str, allowed: tuple[str, ...]) -> str:
    """Whether an object's map of members has one beyond the allowed ones."""
    listed = ", ".join(f"'{a}'" for a in allowed)
    return f"coalesce(size(array_except(map_keys({members}), array({listed}))) > 0, false)"


def _with_members(df: DataFrame, raw: list[str], fields: tuple[str, ...], nested: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add each member of ``_doc`` as VARIANT (``_v_...``) and its type (``_t_...``), taken once.

    The members of an object are read in one go, as a map; ``_m`` and
    ``_m_<name>`` keep the maps of the document and of its nested objects.
    """
    def typed(df: DataFrame, paths: list[str], source: str) -> DataFrame:
        taken = [f"{source}['{p.split('.')[-1]}'] AS {_v(p)}" for p in paths]
        df = df.selectExpr("*", *taken)
        return df.selectExpr("*", *[f"coalesce(schema_of_variant({_v(p)}), 'MISSING') AS {_type_of(p)}" for p in paths])

    df = df.selectExpr(*raw, "_doc", "try_variant_get(_doc, '$', 'map<string,variant>') AS _m")
    df = typed(df, list(fields), "_m")
    for name in nested:
        members = f"try_variant_get({_v(name)}, '$', 'map<string,variant>')"
        df = df.selectExpr("*", f"CASE WHEN startswith({_type_of(name)}, 'OBJECT') THEN {members} END AS _m_{name}")
        df = typed(df, [f"{name}.{x}" for x in nested[name]], f"_m_{name}")
    return df


def _lone_surrogate(text: str) -> str:
    """Whether a JSON text escapes half of a surrogate pair, which is not valid text."""
    pair = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    unescaped = f"replace({text}, {quoted(chr(92) * 2)}, '')"
    rest = f"regexp_replace({unescaped}, {quoted(pair)}, '')"
    return f"contains({text}, {quoted(chr(92) + 'u')}) AND rlike({rest}, {quoted(r'\\u[dD][89a-fA-F]')})"


def _with_document(records: DataFrame) -> DataFrame:
    """Add the payload as VARIANT ``_doc``, NULL unless it is one whole JSON object.

    The JSON reader stops after the first value, so the payload is read as the
    first of two list items; the second, a text that the payload does not
    contain, proves that nothing else came between. It is a fixed one, or, for a
    payload that contains that, the payload's digest.
    """
    text = "CASE WHEN is_valid_utf8(value) THEN CAST(value AS STRING) END AS _text"
    df = records.selectExpr("*", text)
    df = df.selectExpr("*", f"IF(contains(_text, '{_END}'), md5(value), '{_END}') AS _digest")
    listed = "concat('[', _text, ',\"', _digest, '\"]')"
    df = df.selectExpr("*", f"CASE WHEN NOT ({_lone_surrogate('_text')}) THEN try_parse_json({listed}) END AS _list")
    whole = (
        "try_variant_get(_list, '$[1]', 'string') = _digest "
        "AND try_variant_get(_list, '$[2]', 'variant') IS NULL "
        "AND startswith(trim(LEADING ' \\t\\n\\r' FROM _text), '{')"
    )
    return df.selectExpr("*", f"CASE WHEN {whole} THEN try_variant_get(_list, '$[0]', 'variant') END AS _doc")


def _conclude(df: DataFrame, raw: list[str], rules: list[Rule], event: str) -> DataFrame:
    """Add ``violations``, ``error_type``, ``error_message`` and ``event``.

    The first error counts: null value, contract, key bytes, key and id differ.
    """
    broken = (
        "CASE WHEN value IS NULL THEN CAST(array() AS ARRAY<STRING>) "
        f"WHEN _doc IS NULL THEN array('json_object') ELSE {violations(rules)} END AS violations"
    )
    df = df.selectExpr(*raw, broken, f"{event} AS _event")
    df = df.selectExpr(
        "*",
        "CASE WHEN value IS NULL THEN 1 WHEN size(violations) > 0 THEN 2 "
        "WHEN key IS NOT NULL AND NOT is_valid_utf8(key) THEN 3 "
        f"WHEN NOT ({ids.decode_key('key')} <=> _event.review_id) THEN 4 END AS _error",
    )
    out = df.selectExpr(
        *raw,
        "violations",
        f"CASE WHEN _error IN (1, 4) THEN '{NULL_OR_KEY_ERROR}' WHEN _error = 2 THEN '{CONTRACT_ERROR}' "
        f"WHEN _error = 3 THEN '{KEY_DECODE_ERROR}' END AS error_type",
        "CASE _error WHEN 1 THEN 'message value is null' "
        "WHEN 2 THEN concat('contract violated: ', array_join(violations, ', ')) "
        "WHEN 3 THEN 'key is not valid UTF-8' WHEN 4 THEN 'key does not match review_id' END AS error_message",
        "CASE WHEN _error IS NULL THEN _event END AS event",
    )
    return fence(out, ["violations", "error_type", "error_message", "event"])


# The members of the two event records.
REVIEW_EVENT_FIELDS = (
    "schema_version", "event_id", "review_id", "movie_id", "text", "source_created_at", "emitted_at",
)
PREDICTION_EVENT_FIELDS = (
    "sentiment", "label_id", "confidence", "probabilities", "schema_version", "prediction_id",
    "source_event_id", "review_id", "movie_id", "source_created_at", "model", "predicted_at",
)
_VERSION_RULE = ("schema_version", f"NOT coalesce(_version = {SCHEMA_VERSION}, false)")
_MOVIE_RULE = ("movie_id", f"NOT _no_movie AND NOT {is_nonblank('_movie_id')}")
_CREATED_RULE = ("source_created_at", "NOT _no_created AND _created IS NULL")


def parse_review_events(records: DataFrame) -> DataFrame:
    """Topic records with ``event``, ``violations``, ``error_type``, ``error_message``.

    ``event`` is NULL exactly when ``error_type`` is set; no record is dropped.
    """
    raw = records.columns
    df = _with_members(_with_document(records), raw, REVIEW_EVENT_FIELDS, {}).selectExpr(
        *raw,
        "_doc",
        f"{_unknown('_m', REVIEW_EVENT_FIELDS)} AS _unknown_field",
        f"{_literal('schema_version')} AS _version",
        f"{_string('event_id')} AS _event_id",
        # Any JSON scalar is read as text here, as ids are normalised from text.
        f"{_as('review_id', 'string')} AS _review_text",
        f"{_absent('movie_id')} AS _no_movie",
        f"{_string('movie_id')} AS _movie_id",
        f"{_string('text')} AS _body",
        f"{_absent('source_created_at')} AS _no_created",
        f"{_string('source_created_at')} AS _created_text",
        f"{_string('emitted_at')} AS _emitted_text",
    )
    df = df.selectExpr(
        "*", f"{ids.utc_parts('_created_text')} AS _created_parts", f"{ids.utc_parts('_emitted_text')} AS _emitted_parts"
    )
    df = df.selectExpr(
        "*",
        f"{ids.object_id('_review_text')} AS _review_id",
        f"{ids.parse_utc('_created_text', '_created_parts')} AS _created",
        f"{ids.parse_utc('_emitted_text', '_emitted_parts')} AS _emitted",
        f"{matches('_event_id', ids.EVENT_ID_PATTERN)} AS _event_ok",
    )
    rules = [
        ("unknown_field", "_unknown_field"),
        _VERSION_RULE,
        ("event_id", "NOT _event_ok"),
        ("review_id", "_review_id IS NULL"),
        _MOVIE_RULE,
        ("text", f"NOT {is_nonblank('_body')}"),
        _CREATED_RULE,
        ("emitted_at", "_emitted IS NULL"),
        ("event_id_matches", f"_event_ok AND _event_id != {ids.event_id('_review_id')}"),
    ]
    event = (
        f"named_struct('schema_version', {SCHEMA_VERSION}, 'event_id', _event_id, "
        "'review_id', _review_id, 'movie_id', _movie_id, 'text', _body, "
        "'source_created_at', _created, 'emitted_at', _emitted)"
    )
    return _conclude(df, raw, rules, event)


def parse_prediction_events(records: DataFrame) -> DataFrame:
    """As :func:`parse_review_events`, for prediction records."""
    raw = records.columns
    nested = {"probabilities": LABELS, "model": ("name", "version", "run_id")}
    df = _with_members(_with_document(records), raw, PREDICTION_EVENT_FIELDS, nested).selectExpr(
        *raw,
        "_doc",
        f"{_unknown('_m', PREDICTION_EVENT_FIELDS)} AS _unknown_field",
        f"{_unknown('_m_probabilities', LABELS)} AS _unknown_probability",
        f"{_unknown('_m_model', nested['model'])} AS _unknown_model_field",
        f"{_literal('schema_version')} AS _version",
        f"{_literal('label_id')} AS _label_id",
        f"{_string('sentiment')} AS _sentiment",
        f"{_number('confidence')} AS _confidence",
        *[f"{_number(f'probabilities.{x}')} AS _p_{x}" for x in LABELS],
        f"{_string('prediction_id')} AS _prediction_id",
        f"{_string('source_event_id')} AS _source",
        f"{_as('review_id', 'string')} AS _review_text",
        f"{_absent('movie_id')} AS _no_movie",
        f"{_string('movie_id')} AS _movie_id",
        f"{_absent('source_created_at')} AS _no_created",
        f"{_string('source_created_at')} AS _created_text",
        f"{_string('predicted_at')} AS _predicted_text",
        f"{_string('model.name')} AS _name",
        f"{_string('model.version')} AS _model_version",
        f"{_absent('model.run_id')} AS _no_run",
        f"{_string('model.run_id')} AS _run_id",
    )
    df = df.selectExpr(
        "*", f"{ids.utc_parts('_created_text')} AS _created_parts", f"{ids.utc_parts('_predicted_text')} AS _predicted_parts"
    )
    df = df.selectExpr(
        "*",
        f"{ids.object_id('_review_text')} AS _review_id",
        f"{ids.parse_utc('_created_text', '_created_parts')} AS _created",
        f"{ids.parse_utc('_predicted_text', '_predicted_parts')} AS _predicted",
        f"{matches('_source', ids.EVENT_ID_PATTERN)} AS _source_ok",
        f"{matches('_prediction_id', ids.PREDICTION_ID_PATTERN)} AS _id_ok",
        f"{ids.prediction_id('_source', '_name', '_model_version')} AS _expected_id",
    )
    p = {label: f"_p_{label}" for label in LABELS}
    rules = [
        ("unknown_field", "_unknown_field"),
        ("unknown_probability", "_unknown_probability"),
        ("unknown_model_field", "_unknown_model_field"),
        _VERSION_RULE,
        ("prediction_id", "NOT _id_ok"),
        ("source_event_id", "NOT _source_ok"),
        ("review_id", "_review_id IS NULL"),
        _MOVIE_RULE,
        _CREATED_RULE,
        ("predicted_at", "_predicted IS NULL"),
        ("model_name", f"NOT {is_nonblank('_name')}"),
        ("model_version", f"NOT {is_nonblank('_model_version')}"),
        ("model_run_id", f"NOT _no_run AND NOT {is_nonblank('_run_id')}"),
        *prediction_rules("_sentiment", "_label_id", "_confidence", p),
        ("source_event_id_matches", f"_source_ok AND _source != {ids.event_id('_review_id')}"),
        ("prediction_id_matches", "_id_ok AND _prediction_id != _expected_id"),
    ]
    event = (
        "named_struct('sentiment', _sentiment, 'label_id', try_cast(_label_id AS INT), "
        "'confidence', _confidence, 'probabilities', "
        "named_struct('neg', _p_neg, 'neu', _p_neu, 'pos', _p_pos), "
        f"'schema_version', {SCHEMA_VERSION}, 'prediction_id', _prediction_id, 'source_event_id', _source, "
        "'review_id', _review_id, 'movie_id', _movie_id, 'source_created_at', _created, "
        "'model', named_struct('name', _name, 'version', _model_version, 'run_id', _run_id), "
        "'predicted_at', _predicted)"
    )
    return _conclude(df, raw, rules, event)
