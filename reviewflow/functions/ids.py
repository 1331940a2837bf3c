"""Identifiers, keys, base64 and time stamps."""

from __future__ import annotations

from reviewflow.functions import matches, quoted

# Identifier formats. \z, not $, so a trailing newline never passes.
OBJECT_ID_PATTERN = r"\A[0-9a-f]{24}\z"
EVENT_ID_PATTERN = r"\Areview:[0-9a-f]{24}\z"
PREDICTION_ID_PATTERN = r"\A[0-9a-f]{64}\z"

_CLOCK = (
    r"\A((?!0000)\d{4}-\d{2}-\d{2})[Tt _](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,6})\d*)?"
    r"([Zz]|[+\x{2212}-]\d{2}:?\d{2})\z"
)
_NUMBER = r"\A[+-]?(?:\d+\.?\d*|\.\d+)\z"
_MILLIS_FROM = 20_000_000_000  # larger digit strings are milliseconds


def object_id(value: str) -> str:
    """Lower-cased object id, or NULL when it is not 24 hex digits."""
    lowered = f"lower(CAST({value} AS STRING))"
    return f"CASE WHEN {matches(lowered, OBJECT_ID_PATTERN)} THEN {lowered} END"


def event_id(review_id: str) -> str:
    return f"concat('review:', {review_id})"


def prediction_id(source_event_id: str, model_name: str, model_version: str) -> str:
    """Stable id of one model version's prediction; NULL if a part is NULL."""
    return f"sha2(concat({source_event_id}, chr(0), {model_name}, chr(0), {model_version}), 256)"


def decode_key(key: str) -> str:
    """Key bytes as text; NULL for a NULL or invalid key."""
    return f"CASE WHEN is_valid_utf8({key}) THEN CAST({key} AS STRING) END"


def plain_base64(raw: str) -> str:
    """Base64 on one line."""
    return f"replace(base64({raw}), '\\r\\n', '')"


def utc_parts(value: str) -> str:
    """A time text as (local time, fraction, offset), by one match; one entry if it has no such form.

    Kept as a column of its own, it spares :func:`parse_utc` a match per part.
    """
    marked = f"regexp_replace({value}, {quoted(_CLOCK)}, concat('$1T$2$3', chr(1), '$4', chr(1), '$5'))"
    return f"CASE WHEN contains({value}, chr(1)) THEN array('') ELSE split({marked}, chr(1)) END"


def parse_utc(value: str, parts: str | None = None) -> str:
    """Instant named by a text with an offset, or by a digit string; else NULL.

    A time without an offset is NULL on purpose. Digits past the microsecond
    are cut. ``parts`` names a column with the text's :func:`utc_parts`.
    """
    parts = parts or utc_parts(value)
    local = f"concat(rpad({parts}[0], 19, ':00'), '.', rpad({parts}[1], 6, '0'), 'Z')"
    zone = f"{parts}[2]"
    hours = f"CAST(substring({zone}, 2, 2) AS INT)"
    minutes = f"CAST(right({zone}, 2) AS INT)"
    shift = (
        f"CASE WHEN length({zone}) = 1 THEN 0 WHEN {hours} < 24 AND {minutes} < 60 "
        f"THEN ({hours} * 60 + {minutes}) * IF(startswith({zone}, '+'), 1, -1) END"
    )
    clock = f"timestamp_micros(unix_micros(try_to_timestamp({local})) - ({shift}) * 60000000L)"
    number = f"try_cast({value} AS DECIMAL(30, 9))"
    micros = f"round({number} * IF(abs({number}) > {_MILLIS_FROM}, 1000, 1000000))"
    return (
        f"CASE WHEN size({parts}) = 3 THEN {clock} "
        f"WHEN {matches(value, _NUMBER)} THEN timestamp_micros(try_cast({micros} AS BIGINT)) END"
    )


def format_utc(instant: str) -> str:
    """ISO text in UTC; the fraction appears only when it is not zero.

    Needs the session time zone UTC.
    """
    fraction = f"date_format({instant}, '.SSSSSS')"
    return (
        f"concat(date_format({instant}, \"yyyy-MM-dd'T'HH:mm:ss\"), "
        f"CASE WHEN {fraction} = '.000000' THEN '' ELSE {fraction} END, 'Z')"
    )
