"""Trimming, case folding, placeholders and JSON string literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode whitespace character, by rule.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# What event sources write for "no value".
NULL_TOKENS = ("", "-", "n/a", "N/A")

_DOTLESS_I = "\u0131"
_PRIVATE_USE = "\ue000"
_FINAL_SIGMA = "\u03c2"
_SIGMA = "\u03c3"

_SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    """The trimmed text, or null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def placeholder_to_null(text: Column) -> Column:
    """The trimmed text, or null for a blank or a no-value placeholder."""
    trimmed = strip(text)
    return F.when(~trimmed.isin(*NULL_TOKENS), trimmed)


def dash_to_null(text: Column) -> Column:
    """The trimmed text, or null for a blank or a bare dash."""
    trimmed = strip(text)
    return F.when(~trimmed.isin("", "-"), trimmed)


def fold(text: Column) -> Column:
    """Unicode case folding from the built-in case maps.

    Upper-casing first expands characters such as the sharp s; the dotless i has no
    folding and is kept out of the upper-case map.
    """
    shielded = F.upper(F.translate(text, _DOTLESS_I, _PRIVATE_USE))
    lowered = F.lower(F.translate(shielded, _PRIVATE_USE, _DOTLESS_I))
    return F.translate(lowered, _FINAL_SIGMA, _SIGMA)


def match_key(text: Column) -> Column:
    """The form two evidence texts are compared in: trimmed and case-folded."""
    return fold(strip(text))


def quote(text: Column) -> Column:
    """Single-quote a value for a rejection detail, leaving backslashes alone."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))


def json_escape(text: Column) -> Column:
    """Backslashes and quotes escaped for a JSON string; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def json_member(text: Column) -> Column:
    """A JSON string literal, control characters still to be escaped."""
    return F.concat(F.lit('"'), json_escape(text), F.lit('"'))


def escape_controls(document: Column) -> Column:
    """Control characters of assembled JSON as escapes with lower-case hex codes.

    JSON on one line holds control characters only inside its strings, so one pass over
    the whole document does; documents without any are returned as they are.
    """
    escapes = ", ".join(
        f"named_struct('code', {code}, 'escape', '{text}')"
        for code, text in (
            (code, _SHORT_ESCAPES.get(chr(code), f"\\u{code:04x}").replace("\\", "\\\\"))
            for code in range(0x20)
        )
    )
    escaped = F.aggregate(
        F.expr(f"array({escapes})"),
        document,
        lambda kept, item: F.replace(kept, F.char(item["code"]), item["escape"]),
    )
    return F.when(document.rlike(r"[\x00-\x1f]"), escaped).otherwise(document)


def json_string(text: Column) -> Column:
    """A complete JSON string literal."""
    return escape_controls(json_member(text))


def action_verb(label: Column, default: str) -> Column:
    """A free-form label as a snake_case verb, or ``default`` when unusable."""
    cleaned = F.btrim(
        F.regexp_replace(F.lower(strip(label)), r"[^a-z0-9]+", "_"), F.lit("_")
    )
    return F.when(cleaned.rlike(r"^[a-z][a-z0-9_]*$"), cleaned).otherwise(F.lit(default))


def base_name(path: Column) -> Column:
    """The last component of a path written with either separator."""
    unified = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.substring_index(unified, "/", -1)


def channel_file(channel: Column) -> Column:
    """The log file that holds a channel, with ``/`` escaped the way Windows does."""
    return F.concat(F.replace(channel, F.lit("/"), F.lit("%4")), F.lit(".evtx"))


def file_channel(path: Column) -> Column:
    """The channel a log file holds, or null for any other file."""
    name = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    stem = F.expr("null").cast("string")
    stem = F.when(
        F.lower(name).endswith(".evtx"), F.left(name, F.length(name) - F.lit(len(".evtx")))
    ).otherwise(stem)
    return F.nullif(F.replace(stem, F.lit("%4"), F.lit("/")), F.lit(""))
