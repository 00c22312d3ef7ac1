"""Dates and times in free order: words, ordinals, zone names, as people and tools write them.

A text is read in three steps. Its one clock reading is found and taken out, with the zone that
follows. What is left is cut into tokens: numbers, month names, and words that say nothing.
Three numbers, or two and a month name, are a date; which of them is the year, the month
and the day follows from their place and size. Any other token, a second clock
reading or a missing part means that the text is refused.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month and weekday names, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_MONTH_WORD = (
    r"(?i)^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
)
_WEEKDAY_WORD = (
    r"(?i)^(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)$"
)
# What may stand between the parts of a date and says nothing.
FILLERS = (".", ",", ";", "-", "/", "'", "at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")
# Zone names that mean no offset. Other names are not told apart: they may mean several zones.
ZERO_ZONES = ("UTC", "GMT", "Z", "z")

#: Longer texts are no timestamps.
LONGEST = 100
_MARK = "\x01"
_DOTTED_MERIDIEM = r"(?i)(?<![a-z])([ap])\.\s?m(?![a-z])\.?"
_SPELLED = (
    r"(?i)(?<![\d:.])(\d{1,2})\s*h(?:ours?)?(?:\s*(\d{1,2})\s*(?:m(?:in(?:ute)?s?)?)?"
    r"(?:\s*(\d{1,2}(?:[.,]\d+)?)\s*s(?:ec(?:ond)?s?)?)?)?(?![a-z\d])"
)
# A sign before it, behind a word, a space or another clock reading, makes a reading an offset.
_CLOCK = r"(?<![\d:.+])(?<![A-Za-z\s]-)(?<!:\d{2}-)(\d{1,2}:\d{1,2}(?::\d{1,2}(?:[.,]\d{1,9})?)?)(?![\d:])(?:\s*([AaPp][Mm])(?![A-Za-z]))?"
_HOUR = r"(?<![\d:.])(\d{1,2})\s*([AaPp][Mm])(?![A-Za-z])"
_NO_ZONE = "|".join(name.upper() for name in (*MONTHS, *WEEKDAYS))
_ZONE = (
    rf"{_MARK}\s*(?!(?:{_NO_ZONE}|JUNE|JULY|MARCH|APRIL|SEPT)(?![A-Z]))([A-Z]{{1,5}}(?![A-Za-z])|z(?![A-Za-z]))?"
    r"(?:(\s*)([+-])(\d{2}:?\d{2}|\d{1,2})(?![\d:])(?:\s*\([A-Z]{3,5}\))?)?"
)
_TOKEN = r"\d+|[A-Za-z]+|[^\sA-Za-z\d]"


def add_rewritten(df: DataFrame, source: str, output: str) -> DataFrame:
    """Fill ``output``, where it is null, with the text of ``source`` as ``y-m-d h:m:s`` and offset.

    Stays null for a text that is no full date. Rows that have an output are passed over.
    """
    free, mark, zone = F.col("_free"), F.col("_mark"), F.col("_free_zone")
    wanted = F.col(output).isNull() & F.length(source).between(1, LONGEST)
    text = F.regexp_replace("_free", _DOTTED_MERIDIEM, "$1m")
    text = F.regexp_replace(F.regexp_replace(text, _SPELLED, "$1:$2:$3"), r"(\d)::(?!\d)", "$1:00")
    text = F.regexp_replace(text, r"(:\d{1,2}):(?!\d)", "$1")
    # Bound to a variable: a constant text is then not copied into every expression behind it.
    bound = F.get(F.transform(F.array(source), lambda t: F.when(wanted, t)), 0)
    staged = df.withColumn("_free", bound).withColumn("_free", text)
    staged = staged.withColumn("_hours_alone", ~free.rlike(_CLOCK))
    clock = F.when(F.col("_hours_alone"), F.regexp_extract(free, _HOUR, 1)).otherwise(F.regexp_extract(free, _CLOCK, 1))
    meridiem = F.when(F.col("_hours_alone"), F.regexp_extract(free, _HOUR, 2)).otherwise(F.regexp_extract(free, _CLOCK, 2))
    clock = F.when(F.col("_hours_alone") & (clock != ""), F.concat(clock, F.lit(":00"))).otherwise(clock)
    marked = F.when(F.col("_hours_alone"), F.regexp_replace(free, _HOUR, f" {_MARK} ")).otherwise(
        F.regexp_replace(free, _CLOCK, f" {_MARK} ")
    )
    staged = staged.withColumns({"_free_clock": clock, "_free_meridiem": meridiem, "_mark": marked})
    name, apart = F.regexp_extract(mark, _ZONE, 1), F.regexp_extract(mark, _ZONE, 2)
    sign, amount = F.regexp_extract(mark, _ZONE, 3), F.replace(F.regexp_extract(mark, _ZONE, 4), F.lit(":"), F.lit(""))
    # A sign right behind a name counts from the zone to the zero zone, as in "GMT+3".
    turned = F.when((name != "") & (apart == ""), F.translate(sign, "+-", "-+")).otherwise(sign)
    hours, minutes = F.lpad(F.left(amount, F.least(F.length(amount), F.lit(2))), 2, "0"), F.rpad(F.substr(amount, F.lit(3)), 2, "0")
    offset = F.when(sign != "", F.concat(turned, hours, F.lit(":"), minutes)).when(name.isin(*ZERO_ZONES), "Z").otherwise("")
    tokens = F.regexp_extract_all(F.regexp_replace(mark, _ZONE, " "), F.lit(_TOKEN), F.lit(0))
    staged = staged.withColumns({"_free_zone": offset, "_tokens": tokens, "_marks": F.length(F.regexp_replace(mark, f"[^{_MARK}]", ""))})
    staged = staged.withColumn("_fields", F.filter("_tokens", lambda t: t.rlike(r"^\d") | t.rlike(_MONTH_WORD)))
    odd = F.exists("_tokens", lambda t: ~(t.rlike(r"^\d{1,8}$") | F.lower(t).isin(*FILLERS) | t.rlike(_MONTH_WORD) | t.rlike(_WEEKDAY_WORD)))
    staged = staged.withColumn("_date", F.when(~odd & (F.col("_marks") <= 1), _date(F.col("_fields"))))
    time = F.when(F.col("_marks") == 0, "").otherwise(F.concat(F.lit(" "), "_free_clock", "_free_meridiem", zone))
    staged = staged.withColumn(output, F.coalesce(output, F.concat("_date", time)))
    return staged.select(*df.columns)


def _date(fields: Column) -> Column:
    """Year, month and day of three fields, or of one of eight digits; null for any other."""

    def month(field: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(field, F.lit(3))))
        return F.when(place > 0, place.cast("int"))

    def dated(year: Column, month_: Column, day: Column) -> Column:
        return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month_.cast("string"), day.cast("string"))

    def resolved(f: Column) -> Column:
        # Fields as (number, month by name, whether a whole year): bound once for all that follows.
        a, b, c = (F.get(f, i) for i in range(3))
        by_name = [x["month"].isNotNull() for x in (a, b, c)]
        n = [x["number"] for x in (a, b, c)]
        year = [_full_year(x) for x in (a, b, c)]
        is_year = [x["whole"] for x in (a, b, c)]
        plain = F.when((n[0] > 31) | is_year[0], dated(year[0], n[1], n[2])).when(n[0] > 12, dated(year[2], n[1], n[0])).otherwise(
            dated(year[2], n[0], n[1])
        )
        month_first = F.when(is_year[1] | (~is_year[2] & (n[1] > 31)), dated(year[1], a["month"], n[2])).otherwise(dated(year[2], a["month"], n[1]))
        month_second = F.when(is_year[0] | (~is_year[2] & (n[0] > 31)), dated(year[0], b["month"], n[2])).otherwise(dated(year[2], b["month"], n[0]))
        month_last = F.when(is_year[1] | (~is_year[0] & (n[1] > 31)), dated(year[1], c["month"], n[0])).otherwise(dated(year[0], c["month"], n[1]))
        several = sum((x.cast("int") for x in by_name[1:]), by_name[0].cast("int")) > 1
        return F.when(several, None).when(by_name[0], month_first).when(by_name[1], month_second).when(by_name[2], month_last).otherwise(plain)

    parsed = F.transform(
        fields,
        lambda t: F.struct(
            t.try_cast("int").alias("number"), month(t).alias("month"), (t.rlike(r"^\d") & (F.length(t) > 2)).alias("whole")
        ),
    )
    compact = F.get(fields, 0)
    one = F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))
    return F.when(F.size(fields) == 3, F.get(F.transform(F.array(parsed), resolved), 0)).when(
        (F.size(fields) == 1) & compact.rlike(r"^\d{8}$"), one
    )


def _full_year(field: Column) -> Column:
    """A year of up to two digits is the one with that ending under fifty years away."""
    now = datetime.now().year
    short = field["number"] + now // 100 * 100
    near = F.when(short >= now + 50, short - 100).when(short < now - 50, short + 100).otherwise(short)
    return F.when(field["whole"], field["number"]).otherwise(near)
