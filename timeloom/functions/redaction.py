"""Blanking of indicators and account names in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: account names shorter than this are left in text.
MIN_USERNAME_LENGTH = 3


def username_tokens(principal: Column) -> Column:
    """The spellings of an account to blank, longest first."""
    spellings = F.array_distinct(
        F.array(
            principal,
            F.substring_index(principal, "\\", -1),
            F.substring_index(principal, "@", 1),
        )
    )
    long_enough = F.filter(spellings, lambda token: F.length(token) >= MIN_USERNAME_LENGTH)
    return F.array_sort(long_enough, lambda a, b: F.length(b) - F.length(a))


def strip_values(text: Column, found: Column, placeholder: str) -> Column:
    """Replace every occurrence of each found value."""
    return F.aggregate(
        found, text, lambda kept, hit: F.replace(kept, hit["value"], F.lit(placeholder))
    )


def strip_username(text: Column, principal: Column, placeholder: str) -> Column:
    """Replace the account's spellings, whatever their case."""
    literal = placeholder.replace("\\", "\\\\").replace("$", "\\$")

    def blank(kept: Column, token: Column) -> Column:
        quoted = F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        pattern = F.concat(F.lit("(?iu)\\Q"), quoted, F.lit("\\E"))
        return F.regexp_replace(kept, pattern, F.lit(literal))

    blanked = F.aggregate(username_tokens(principal), text, blank)
    return F.when(principal.isNull() | (principal == ""), text).otherwise(blanked)
