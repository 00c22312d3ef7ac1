"""Ids derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions.text import escape_controls, json_member

# The fields that make up an event's identity, in encoding order.
IDENTITY_FIELDS = (
    "action",
    "datetime",
    "host",
    "object",
    "principal",
    "source_artifact",
    "source_tool",
    "timestamp_desc",
)

SHORT_ID_LENGTH = 12


def event_id(namespace: str, fields: dict[str, Column]) -> Column:
    """SHA-256 over the compact JSON of the namespace and the identity fields."""
    parts = [F.lit("["), json_member(F.lit(namespace)), F.lit(",{")]
    for position, name in enumerate(IDENTITY_FIELDS):
        lead = "," if position else ""
        parts += [F.lit(f'{lead}"{name}":'), json_member(fields[name])]
    parts.append(F.lit("}]"))
    return F.sha2(escape_controls(F.concat(*parts)), 256)


def digest(payload: Column) -> Column:
    """The payload's SHA-256 in hex: what rows are grouped and joined by."""
    return F.sha2(payload, 256)


_DIGEST, _TEXT = "X'01'", "X'00'"


def packed(identifier: Column) -> Column:
    """An id as bytes, for rows that move: a digest takes half of its hex digits, any other id its text."""
    is_digest = (F.length(identifier) == 64) & identifier.rlike("^[0-9a-f]{64}$")
    other = F.concat(F.expr(_TEXT), identifier.cast("binary"))
    return F.when(is_digest, F.concat(F.expr(_DIGEST), F.unhex(identifier))).otherwise(other)


def unpacked(value: Column) -> Column:
    """The id that ``packed`` made into ``value``."""
    rest = F.substr(value, F.lit(2))
    return F.when(F.startswith(value, F.expr(_DIGEST)), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def short_id(prefix: str, digest: Column) -> Column:
    """``prefix`` plus the first hex digits of a digest: to be shown, too short to be a key."""
    return F.concat(F.lit(prefix), F.left(digest, F.lit(SHORT_ID_LENGTH)))
