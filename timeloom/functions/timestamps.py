"""Timestamps of many spellings to UTC instants."""

from __future__ import annotations

import zoneinfo
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions import freeform
from timeloom.functions.freeform import MONTHS
from timeloom.functions.text import quote, strip

ASSUMED_UTC = "assumed_utc"

_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_ZONE = r"(?:\s*(?:[Zz]|UTC|GMT|[+-]\d{2}(?::?\d{2})?))"
_MERIDIEM = r"(?:\s*[AaPp][Mm])"
_TAIL = rf"(?:(?:[Tt]|\s+){_TIME}{_MERIDIEM}?{_ZONE}?)?"
_YEAR_FIRST = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})({_TAIL})$"
_DAY_FIRST = rf"^(1[3-9]|2\d|3[01])[-/.](\d{{1,2}})[-/.](\d{{4}})({_TAIL})$"
_MONTH_FIRST = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})({_TAIL})$"
_COMPACT_DATE = rf"^(\d{{4}})(\d{{2}})(\d{{2}})({_TAIL})$"
_COMPACT_MINUTE = rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}})(\d{{2}})({_ZONE}?)$"
_COMPACT_SECOND = (
    rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt]?(\d{{2}})(\d{{2}})(\d{{2}}(?:[.,]\d+)?)({_ZONE}?)$"
)
_MONTH_NAME = "(" + "|".join(MONTHS) + r")[a-z]*\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_DAY_NAMED = rf"(?i)^{_WEEKDAY}(\d{{1,2}})[\s-]+{_MONTH_NAME},?[\s-]+(\d{{4}})({_TAIL})$"
_NAMED_DAY = rf"(?i)^{_WEEKDAY}{_MONTH_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})({_TAIL})$"

_CTIME = rf"(?i)^{_WEEKDAY}{_MONTH_NAME}\s+(\d{{1,2}})\s+({_TIME})({_ZONE}?)\s+(\d{{4}})$"
_TIME_FIRST = rf"(?i)^({_TIME}{_MERIDIEM}?{_ZONE}?),?\s+(\S[^:]*)$"
_HOUR_ONLY = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}})[Tt](\d{{1,2}})({_ZONE}?)$"

_INCOMPLETE = rf"(?i)^(?:\d{{1,2}}:\d{{2}}|\d{{4}}-\d{{1,2}}$|{_MONTH_NAME}$)"
_CLOCK = r"\d:\d{2}"
_OFFSET_AT_END = r"(?<=\d)(Z|[+-]\d{2}:\d{2})$"

# Placeholder entries of the zone database that name no zone.
_NOT_ZONES = {"Factory", "localtime", "posixrules"}
KNOWN_ZONES = tuple(sorted(zoneinfo.available_timezones() - _NOT_ZONES))


def zone_is_known(column_name: str) -> Column:
    """True for an IANA zone name, null for no zone."""
    names = ", ".join(f"'{name}'" for name in KNOWN_ZONES)
    return F.expr(f"{column_name} IN ({names})")


def canonical_datetime(ts: Column) -> Column:
    """ISO 8601 UTC text with a trailing Z and no trailing fractional zeros."""
    return F.concat(F.replace(ts.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _month_number(name: Column) -> Column:
    position = F.array_position(
        F.array(*[F.lit(month) for month in MONTHS]), F.lower(F.left(name, F.lit(3)))
    )
    return position.cast("string")


def _short_year_layouts() -> list[tuple[str, str]]:
    """Patterns for years of two digits, which mean the one of that ending under fifty years away."""
    now = datetime.now().year
    by_century: dict[int, list[str]] = {}
    for year in range(now - 50, now + 50):
        by_century.setdefault(year // 100, []).append(f"{year % 100:02d}")
    return [
        (rf"^(\d{{1,2}}[-/.]\d{{1,2}}[-/.])({'|'.join(years)})({_TAIL})$", f"$1{century}$2$3")
        for century, years in by_century.items()
    ]


def _date_first(text: Column) -> Column:
    """Rewrite a time before its date, the form of ``ctime``, a bare hour, a year of two digits.

    Each pattern leaves other text as it is, so the expression names its input once.
    """
    layouts = [
        (_CTIME, "$1 $2 $5 $3$4"),
        (_TIME_FIRST, "$2 $1"),
        (_HOUR_ONLY, "$1T$2:00$3"),
        *_short_year_layouts(),
    ]
    for pattern, layout in layouts:
        text = F.regexp_replace(text, pattern, layout)
    return text


def _year_month_day(text: Column) -> Column:
    """The text with its date in year-month-day order, or null for no full date."""

    def named(pattern: str, day: int, month: int) -> Column:
        return F.concat(
            F.regexp_extract(text, pattern, 3),
            F.lit("-"),
            _month_number(F.regexp_extract(text, pattern, month)),
            F.lit("-"),
            F.regexp_extract(text, pattern, day),
            F.regexp_extract(text, pattern, 4),
        )

    shapes = (
        (_YEAR_FIRST, "$1-$2-$3$4"),
        (_DAY_FIRST, "$3-$2-$1$4"),
        (_MONTH_FIRST, "$3-$1-$2$4"),
        (_COMPACT_DATE, "$1-$2-$3$4"),
        (_COMPACT_MINUTE, "$1-$2-$3 $4:$5$6"),
        (_COMPACT_SECOND, "$1-$2-$3 $4:$5:$6$7"),
    )
    result = F.when(text.rlike(_DAY_NAMED), named(_DAY_NAMED, 1, 2)).when(
        text.rlike(_NAMED_DAY), named(_NAMED_DAY, 2, 1)
    )
    for pattern, layout in reversed(shapes):
        result = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, layout)).otherwise(
            result
        )
    return result


def _twenty_four_hours(text: Column) -> Column:
    """Rewrite a 12-hour clock reading; other text is returned as it is."""
    pattern = r"^(.*?[Tt\s])(\d{1,2})(:\d{2}(?::\d{2}(?:[.,]\d+)?)?)\s*([AaPp])[Mm](.*)$"
    hour = F.regexp_extract(text, pattern, 2).try_cast("int")
    shifted = hour % 12 + F.when(
        F.lower(F.regexp_extract(text, pattern, 4)) == "p", F.lit(12)
    ).otherwise(F.lit(0))
    rebuilt = F.when(
        hour.between(1, 12),
        F.concat(
            F.regexp_extract(text, pattern, 1),
            shifted.cast("string"),
            F.regexp_extract(text, pattern, 3),
            F.regexp_extract(text, pattern, 5),
        ),
    )
    return F.when(text.rlike(r"(?i)\d\s*[ap]m"), rebuilt).otherwise(text)


def _tidy_zone(text: Column) -> Column:
    """Write the trailing zone as ``Z`` or ``+hh:mm`` right after the time."""
    tidy = F.regexp_replace(text, r"(?<=\d)\s*(?:[Zz]|UTC|GMT)$", "Z")
    tidy = F.regexp_replace(tidy, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    tidy = F.regexp_replace(tidy, r"(:\d{2}(?:[.,]\d+)?)\s*([+-]\d{2})$", "$1$2:00")
    tidy = F.regexp_replace(tidy, r"(:\d{2}),(\d)", "$1.$2")
    # Most texts end in Z already and need none of this.
    settled = text.rlike(r"^[^,\s]+(?:[Tt ][^,\s]+)?:\d{2}(?:\.\d+)?Z?$")
    return F.when(settled | ~text.rlike(_CLOCK), text).otherwise(tidy)


def _offset_minutes(offset: Column) -> Column:
    sign = F.when(F.left(offset, F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1))
    hours = F.substring(offset, 2, 2).try_cast("int")
    minutes = F.substring(offset, 5, 2).try_cast("int")
    return F.when(offset == "Z", F.lit(0)).otherwise(sign * (hours * 60 + minutes))


def utc_offset_label(minutes: Column) -> Column:
    """``UTC``, ``UTC-04:00`` or ``UTC+05:30``."""
    magnitude = F.abs(minutes)
    label = F.format_string(
        "UTC%s%02d:%02d",
        F.when(minutes > 0, F.lit("+")).otherwise(F.lit("-")),
        F.floor(magnitude / 60).cast("int"),
        (magnitude % 60).cast("int"),
    )
    return F.when(minutes == 0, F.lit("UTC")).otherwise(label)


def add_timestamp(
    df: DataFrame, raw: Column, assume_timezone: Column | str | None = None
) -> DataFrame:
    """Add ``ts``, ``source_timezone`` and ``time_reason`` for one raw timestamp.

    An explicit offset fixes the instant; otherwise the assumed zone does, and UTC
    (labelled as assumed) when there is none. ``time_reason`` says why a text was
    refused. Each stage is its own projection, so nothing is computed twice.
    """
    if isinstance(assume_timezone, Column):
        zone, known = assume_timezone, zone_is_known("_zone")
    else:
        # A fixed zone is checked here, not per row.
        zone = F.lit(assume_timezone).cast("string")
        known = F.lit(assume_timezone is None or assume_timezone in KNOWN_ZONES)
    text, offset, wall = F.col("_time_text"), F.col("_offset"), F.col("_wall")
    staged = (
        df.withColumn("_zone", zone)
        .withColumn("_raw_time", raw)
        .withColumn("_trimmed_time", strip(F.col("_raw_time")))
        .withColumn("_time_text", _date_first(F.col("_trimmed_time")))
        .withColumn("_time_text", _year_month_day(text))
    )
    staged = freeform.add_rewritten(staged, "_trimmed_time", "_time_text")
    # Always true, but not known before a row is there: filters on the results stay above this,
    # and Spark does not copy the chain up to here into each of their expressions.
    staged = staged.withColumn("_time_text", F.when(F.monotonically_increasing_id() >= 0, text))
    staged = (
        staged.withColumn("_time_text", _twenty_four_hours(text))
        .withColumn("_time_text", _tidy_zone(text))
        .withColumn(
            "_offset",
            F.when(text.rlike(_CLOCK), F.nullif(F.regexp_extract(text, _OFFSET_AT_END, 1), F.lit(""))),
        )
        .withColumn(
            "_wall",
            F.when(offset.isNull(), text)
            .otherwise(F.left(text, F.length(text) - F.length(offset)))
            .try_cast("timestamp_ntz"),
        )
        .withColumn("_minutes", _offset_minutes(offset))
        .withColumn("_zone_known", F.coalesce(known, F.lit(True)))
    )
    usable_zone = (
        F.when(F.col("_zone").isNull() | ~F.col("_zone_known"), F.lit("UTC"))
        .when(F.col("_zone") == "ROC", F.lit("Asia/Taipei"))  # a name Java does not list
        .otherwise(F.col("_zone"))
    )
    minutes = F.col("_minutes")
    instant = (
        F.when(~F.year(wall).between(1, 9999), F.lit(None))
        .when(offset.isNotNull() & (F.abs(minutes) >= 24 * 60), F.lit(None))
        .when(offset.isNotNull(), F.timestamp_add("MINUTE", -minutes, wall.cast("timestamp")))
        .when(usable_zone == "UTC", wall.cast("timestamp"))
        .otherwise(F.convert_timezone(usable_zone, F.lit("UTC"), wall).cast("timestamp"))
    )
    staged = staged.withColumn("_instant", instant)
    in_range = F.when(F.year("_instant").between(1, 9999), F.col("_instant"))
    label = F.coalesce(
        F.col("_zone"),
        F.when(offset.isNotNull(), utc_offset_label(minutes)),
        F.lit(ASSUMED_UTC),
    )
    incomplete = F.col("_trimmed_time").rlike(_INCOMPLETE)
    quoted = quote(F.col("_raw_time"))
    reason = (
        F.when(F.coalesce(F.col("_trimmed_time"), F.lit("")) == "", F.lit("timestamp is empty"))
        .when(
            text.isNull() & incomplete,
            F.concat(
                F.lit("timestamp "),
                quoted,
                F.lit(" does not carry a complete date; refusing to fill the missing parts"),
            ),
        )
        .when(F.col("ts").isNull(), F.concat(F.lit("cannot parse timestamp "), quoted))
        .when(
            ~F.col("_zone_known"), F.concat(F.lit("unknown timezone "), quote(F.col("_zone")))
        )
    )
    staged = staged.withColumn("ts", in_range).withColumn("source_timezone", label)
    kept = [c for c in df.columns if c not in ("ts", "source_timezone", "time_reason")]
    return staged.select(*kept, "ts", "source_timezone", reason.alias("time_reason"))


# Fixed value: the ISO 8601 extended form an asserted time may take.
_ASSERTED = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?)"
    r"([Zz]|[+-]\d{2}(?::?\d{2})?)?)?$"
)


def add_asserted_instant(df: DataFrame, text: Column, output: str) -> DataFrame:
    """Add the UTC instant of an ISO 8601 text (naive means UTC), or null."""
    staged = (
        df.withColumn("_asserted", strip(text))
        .withColumn(
            "_asserted", F.when(F.col("_asserted").rlike(_ASSERTED), F.col("_asserted"))
        )
        .withColumn("_day", F.regexp_extract("_asserted", _ASSERTED, 1))
        .withColumn("_clock", F.regexp_extract("_asserted", _ASSERTED, 2))
        .withColumn("_shift", F.upper(F.regexp_extract("_asserted", _ASSERTED, 3)))
    )
    clock = F.replace(F.col("_clock"), F.lit(","), F.lit("."))
    clock = F.when(F.length(clock) == 2, F.concat(clock, F.lit(":00"))).otherwise(clock)
    wall = F.concat(
        F.col("_day"), F.when(clock != "", F.concat(F.lit(" "), clock)).otherwise(F.lit(""))
    ).try_cast("timestamp_ntz")
    digits = F.replace(F.col("_shift"), F.lit(":"), F.lit(""))
    sign = F.when(digits.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    minutes = F.when(digits.isin("", "Z"), F.lit(0)).otherwise(
        sign
        * (
            F.substring(digits, 2, 2).try_cast("int") * 60
            + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
        )
    )
    staged = staged.withColumn("_wall", wall).withColumn("_minutes", minutes)
    instant = F.when(
        F.abs("_minutes") < 24 * 60,
        F.timestamp_add("MINUTE", -F.col("_minutes"), F.col("_wall").cast("timestamp")),
    )
    return staged.select(*[c for c in df.columns if c != output], instant.alias(output))
