"""Indicators inside evidence text: addresses, domains, hashes and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.functions.identity import digest, short_id
from timeloom.functions.text import fold, strip

IP, DOMAIN, HASH, PATH = "ip", "domain", "hash", "path"
# The display order of indicator types.
TYPE_ORDER = (IP, DOMAIN, HASH, PATH)

# Where an embedded path stops.
_PATH_STOP = "\\s\\x1c-\\x1f\"'<>|\u00a6,;+"
# The indicator patterns.
QUOTED_PATH = r'"((?:[A-Za-z]:\\|\\\\)[^"<>|\r\n]+)"'
DRIVE_PATH = rf"(?U)[A-Za-z]:\\[^{_PATH_STOP}]+"
UNC_PATH = rf"(?U)\\\\[^{_PATH_STOP}]+"
HASH_DIGEST = r"(?U)\b(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})\b"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
DOMAIN_NAME = r"(?U)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}\b"
WHOLE_PATH = "^(?:[A-Za-z]:\\\\|\\\\\\\\)[^:/+,;\u00a6'\"<>|?\n\r\t]*$"
LOCAL_ADDRESS = r"^(?:127\.\d{1,3}\.\d{1,3}\.\d{1,3}|0\.0\.0\.0)$"

# No domain name is longer than 253 characters. Longer runs are blanked first, which
# keeps the backtracking of the domain pattern bounded on hostile text.
_OVERLONG_TOKEN = r"(?U)[\w.-]{254,}+"

# What every indicator holds: a backslash, a dot before a letter or digit, or a long run of
# hexadecimal digits. ASCII classes that fail at the first character of most words.
_DOTTED = r"\.[A-Za-z0-9]"
_HEX_RUN = r"[0-9a-fA-F]{32}"
# Between tokens: ASCII that is neither part of a word nor of a name. A match of a digest,
# an address or a domain lies within one token, and word bounds are the same inside it as in the text.
_TOKEN_BREAK = r"[\x00-,/:-@\[-^`{-\x7f]+"

# Final labels that are file extensions rather than top-level domains.
FILE_EXTENSIONS = (
    "bak", "bat", "bin", "cmd", "conf", "csv", "dat", "dll", "dmp", "doc", "docx", "etl",
    "evtx", "exe", "gif", "htm", "html", "ini", "iso", "jar", "jpeg", "jpg", "json", "lnk",
    "log", "msi", "mui", "nls", "pdb", "pdf", "png", "ppt", "pptx", "reg", "rtf", "scr",
    "sys", "tmp", "txt", "vbs", "xls", "xlsx", "xml", "yaml", "yml",
)


def _typed(kind: str, found: Column) -> Column:
    return F.transform(
        found, lambda value: F.struct(F.lit(kind).alias("ioc_type"), value.alias("value"))
    )


def scan(df: DataFrame, texts: str, output: str) -> DataFrame:
    """Add ``output``: the ``(ioc_type, value)`` indicators in the string array ``texts``.

    A text that is one whole path is a single indicator. Otherwise each pattern runs on
    what the patterns before it left over, so a path never yields its parts again. One cheap
    pass holds back texts that cannot have any indicator. Of the others, what paths leave over is split into
    tokens once, and only tokens that can be a digest or a dotted name meet the patterns for these.
    The stages are separate projections: each intermediate value is computed once, and rows
    never leave their partition.
    """
    kept = [name for name in df.columns if name != output]

    def holds(text: str) -> Callable[[Column], Column]:
        return lambda t: t.contains(text)

    def token_like(t: Column) -> Column:
        return t.rlike(_DOTTED) | t.rlike(_HEX_RUN)

    paths = (
        (PATH, QUOTED_PATH, 1, holds("\\")),
        (PATH, DRIVE_PATH, 0, holds(":\\")),
        (PATH, UNC_PATH, 0, holds("\\\\")),
    )
    names = (
        (HASH, HASH_DIGEST, 0, lambda t: t.rlike(_HEX_RUN)),
        (IP, IPV4, 0, holds(".")),
    )

    def matches(array: Column, pattern: str, group: int, may: Callable[[Column], Column]) -> Column:
        return F.flatten(
            F.transform(
                F.filter(array, may), lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
            )
        )

    def blank(array: Column, pattern: str, may: Callable[[Column], Column]) -> Column:
        return F.transform(array, lambda t: F.when(may(t), F.regexp_replace(t, pattern, " ")).otherwise(t))

    live = F.filter(F.col(texts), lambda t: t.contains("\\") | token_like(t))
    trimmed = F.filter(F.transform(live, strip), lambda t: t != "")
    work = df.withColumn("_trimmed", trimmed)
    work = work.withColumn(
        "_whole", F.filter("_trimmed", lambda t: t.contains("\\") & t.rlike(WHOLE_PATH))
    ).withColumn(
        "_work", F.filter("_trimmed", lambda t: ~(t.contains("\\") & t.rlike(WHOLE_PATH)))
    )
    parts = [_typed(PATH, F.col("_whole"))]
    for number, (kind, pattern, group, may) in enumerate(paths + names):
        if number == len(paths):
            tokens = F.transform("_work", lambda t: F.filter(F.split(t, _TOKEN_BREAK), token_like))
            work = work.withColumn("_work", F.flatten(tokens))
        found = f"_found{number}"
        work = work.withColumn(found, matches(F.col("_work"), pattern, group, may))
        work = work.withColumn("_work", blank(F.col("_work"), pattern, may))
        column = F.col(found)
        if kind == IP:
            column = F.filter(column, lambda value: ~value.rlike(LOCAL_ADDRESS))
        parts.append(_typed(kind, column))
    bounded = F.transform(
        F.filter("_work", lambda t: t.contains(".")),
        lambda t: F.regexp_replace(t, _OVERLONG_TOKEN, " "),
    )
    domains = F.flatten(
        F.transform(bounded, lambda t: F.regexp_extract_all(t, F.lit(DOMAIN_NAME), F.lit(0)))
    )
    domains = F.filter(
        domains, lambda value: ~F.lower(F.substring_index(value, ".", -1)).isin(*FILE_EXTENSIONS)
    )
    parts.append(_typed(DOMAIN, domains))
    return work.select(*kept, F.concat(*parts).alias(output))


def display_value(kind: Column, value: Column) -> Column:
    """How an indicator is shown: domains and hashes in lower case."""
    return F.when(kind.isin(DOMAIN, HASH), F.lower(value)).otherwise(value)


def dedup_key(kind: Column, value: Column) -> Column:
    """What makes two spellings one indicator."""
    path = fold(F.rtrim(value, F.lit("\\")))
    path = F.when(path == "", value).otherwise(path)
    return F.when(kind == PATH, path).otherwise(display_value(kind, value))


def indicator_id(namespace: str, kind: Column, key: Column) -> Column:
    return short_id("ioc-", digest(F.concat_ws("\n", F.lit(namespace), kind, key)))


def defang(kind: Column, value: Column) -> Column:
    """The value written so that it cannot be followed by accident."""
    safe = F.regexp_replace(value, r"(?i)^https://", "hxxps://")
    safe = F.regexp_replace(safe, r"(?i)^http://", "hxxp://")
    return F.when(
        kind.isin(IP, DOMAIN), F.replace(safe, F.lit("."), F.lit("[.]"))
    ).otherwise(value)


def type_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in TYPE_ORDER]), kind)
