"""Text predicates, stripping and head-and-tail truncation."""

from __future__ import annotations

from reviewflow.functions import quoted
from reviewflow.schema import HEAD_TOKENS, MAX_LENGTH, SPECIAL_TOKENS, TAIL_TOKENS

# The code points a Unicode-aware strip removes.
WHITESPACE = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
ASCII_WHITESPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def _characters(points) -> str:
    return "'" + "".join(f"\\u{p:04x}" for p in points) + "'"


def is_nonblank(text: str) -> str:
    """True when something is left after stripping; NULL counts as blank."""
    return f"coalesce(trim(LEADING {_characters(WHITESPACE)} FROM {text}) != '', false)"


def has_ascii_nonspace(text: str) -> str:
    """The document store's ``\\S``: only ASCII white space counts as blank."""
    return f"coalesce(trim(LEADING {_characters(ASCII_WHITESPACE)} FROM {text}) != '', false)"


def strip_text(text: str) -> str:
    return f"trim(BOTH {_characters(WHITESPACE)} FROM {text})"


def decode_lossy(raw: str) -> str:
    """UTF-8 text of raw bytes, invalid sequences replaced, line ends as LF."""
    return f"regexp_replace(make_valid_utf8(CAST({raw} AS STRING)), {quoted(r'\r\n?')}, '\\n')"


def tokens(text: str) -> str:
    """Default tokenizer: pieces between runs of white space.

    Splitting at one plain character avoids a regular expression, which would
    take most of the time.
    """
    spaced = f"replace(replace(replace({text}, '\\t', ' '), '\\n', ' '), '\\r', ' ')"
    return f"array_remove(split({spaced}, ' '), '')"


def token_count(toks: str) -> str:
    """Number of tokens including the two special ones."""
    return f"(size({toks}) + {SPECIAL_TOKENS})"


def head_tail(
    toks: str,
    max_length: int = MAX_LENGTH,
    head: int = HEAD_TOKENS,
    tail: int = TAIL_TOKENS,
) -> str:
    """The first ``head`` and last ``tail`` tokens of a sequence that is too long."""
    room = max_length - SPECIAL_TOKENS
    if head <= 0 or tail <= 0 or head + tail > room:
        raise ValueError("head + tail must fit into max_length without the special tokens")
    shortened = f"concat(slice({toks}, 1, {head}), slice({toks}, -{tail}, {tail}))"
    return f"CASE WHEN size({toks}) > {room} THEN {shortened} ELSE {toks} END"
