"""Parsing of packed cells, and the details record of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeloom.functions.text import blank_to_null, json_member, strip
from timeloom.schema import DETAILS, LISTS, MAPS, SCALARS

# The separator detection timelines put between values of one cell.
BROKEN_BAR = "\u00a6"


def _pair_entries(text: Column, separator: str) -> Column:
    """``key: value`` fragments as map entries; a fragment without a key is skipped."""

    def entry(fragment: Column) -> Column:
        key = strip(F.substring_index(fragment, ":", 1))
        value = strip(F.substr(fragment, F.instr(fragment, ":") + 1))
        return F.struct(key.alias("key"), value.alias("value"))

    fragments = F.filter(
        F.split(text, f"[{separator}]", -1), lambda fragment: fragment.contains(":")
    )
    return F.filter(F.transform(fragments, entry), lambda pair: pair["key"] != "")


def parse_pairs(text: Column, separator: str) -> Column:
    """A cell of ``key: value`` pairs as a map; a repeated key keeps its last value."""
    return F.map_from_entries(_pair_entries(F.coalesce(text, F.lit("")), separator))


def _json_scalar(value: Column) -> Column:
    """One JSON value as the text a CSV cell would have carried."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    joined = F.array_join(
        F.transform(
            F.try_variant_get(value, "$", "array<string>"), lambda item: F.coalesce(item, F.lit(""))
        ),
        " ",
    )
    return (
        F.when(kind.startswith("ARRAY"), joined)
        .when(kind == "VOID", F.lit(""))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def parse_details(cell: Column) -> Column:
    """A details cell as a map: JSON object text, or broken-bar separated pairs."""
    text = strip(F.coalesce(cell, F.lit("")))
    decoded = F.try_variant_get(
        F.try_parse_json(F.when(text.startswith("{"), text)), "$", "map<string,variant>"
    )
    from_json = F.transform_values(decoded, lambda _, value: _json_scalar(value))
    return F.coalesce(from_json, parse_pairs(text, BROKEN_BAR))


def split_values(cell: Column) -> Column:
    """A multi-value cell as an array: JSON list text, or broken-bar separated."""
    text = strip(F.coalesce(cell, F.lit("")))
    decoded = F.try_variant_get(
        F.try_parse_json(F.when(text.startswith("["), text)), "$", "array<string>"
    )
    from_json = F.filter(
        F.transform(decoded, lambda item: strip(F.coalesce(item, F.lit("None")))),
        lambda item: item != "",
    )
    pieces = F.filter(
        F.transform(F.split(text, BROKEN_BAR, -1), strip), lambda item: ~item.isin("", "-")
    )
    return F.coalesce(from_json, pieces)


def scalar_text(value: Column) -> Column:
    """A JSON scalar as text with lower-case booleans; containers and nulls are empty."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    is_container = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(kind.isNull() | is_container | (kind == "VOID"), F.lit("")).otherwise(
        F.coalesce(text, F.lit(""))
    )


def scalars(**entries: Column) -> Column:
    """A scalar map that leaves out null entries."""
    pairs = F.array(
        *[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in entries.items()]
    )
    return F.map_from_entries(F.filter(pairs, lambda pair: pair["value"].isNotNull()))


def present(**cells: Column) -> Column:
    """A scalar map of the non-blank cells, trimmed."""
    return scalars(**{key: blank_to_null(value) for key, value in cells.items()})


def lists(**entries: Column) -> Column:
    """A list map that leaves out empty lists."""
    pairs = F.array(
        *[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in entries.items()]
    )
    return F.map_from_entries(F.filter(pairs, lambda pair: F.size(pair["value"]) > 0))


def record(
    scalar_map: Column | None = None, list_map: Column | None = None, map_map: Column | None = None
) -> Column:
    """The details struct; a missing part is an empty map."""

    def part(column: Column | None, empty: str) -> Column:
        if column is None:
            return F.from_json(F.lit("{}"), empty)
        return column

    return F.struct(
        part(scalar_map, SCALARS.simpleString()).alias("scalars"),
        part(list_map, LISTS.simpleString()).alias("lists"),
        part(map_map, MAPS.simpleString()).alias("maps"),
    ).cast(DETAILS)


def scalar(details: Column, key: str) -> Column:
    return F.try_element_at(details["scalars"], F.lit(key))


def values(details: Column, key: str) -> Column:
    return F.try_element_at(details["lists"], F.lit(key))


def with_entry(entries: Column, key: str, value: Column) -> Column:
    """The map with ``key`` set to ``value``; a null value leaves it unchanged."""
    replaced = F.map_concat(
        F.map_filter(entries, lambda name, _: name != key), F.create_map(F.lit(key), value)
    )
    return F.when(value.isNotNull(), replaced).otherwise(entries)


def all_strings(details: Column) -> Column:
    """Every string reachable inside the details."""
    nested = F.transform(F.map_values(details["maps"]), F.map_values)
    return F.concat(
        F.map_values(details["scalars"]),
        F.flatten(F.map_values(details["lists"])),
        F.flatten(nested),
    )


def to_json_text(details: Column) -> Column:
    """The details as one JSON object; an integer event id is written as a number.

    Control characters are left to the pass over the whole document.
    """

    def members(entries: Column, render) -> Column:
        return F.transform(
            F.map_entries(entries),
            lambda entry: F.concat(
                json_member(entry["key"]), F.lit(":"), render(entry["key"], entry["value"])
            ),
        )

    def render_scalar(key: Column, value: Column) -> Column:
        is_number = (key == "win_event_id") & value.rlike(r"^-?\d+$")
        return F.when(is_number, value).otherwise(json_member(value))

    def render_list(_, items: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(items, json_member), ","), F.lit("]"))

    def render_map(_, entries: Column) -> Column:
        inner = members(entries, lambda _key, value: json_member(value))
        return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))

    everything = F.concat(
        members(details["scalars"], render_scalar),
        members(details["lists"], render_list),
        members(details["maps"], render_map),
    )
    return F.concat(F.lit("{"), F.array_join(everything, ","), F.lit("}"))


def from_variant(value: Column) -> Column:
    """The details struct of a parsed JSON object."""
    entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))

    def kind_is(prefix: str):
        return lambda entry: F.schema_of_variant(entry["value"]).startswith(prefix)

    def is_scalar(entry: Column) -> Column:
        kind = F.schema_of_variant(entry["value"])
        return ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"))

    def collect(predicate, target: str) -> Column:
        chosen = F.filter(entries, predicate)
        return F.map_from_entries(
            F.transform(
                chosen,
                lambda entry: F.struct(
                    entry["key"].alias("key"),
                    F.try_variant_get(entry["value"], "$", target).alias("value"),
                ),
            )
        )

    return record(
        collect(is_scalar, "string"),
        collect(kind_is("ARRAY"), "array<string>"),
        collect(kind_is("OBJECT"), "map<string,string>"),
    )
