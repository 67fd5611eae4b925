"""Null-coalescing merges of dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DICTIONARY = "map<string,variant>"


def map_coalesce(target: Column, source: Column) -> Column:
    """Merge of two flat maps: keys missing or NULL in the target come from the source."""
    merged = F.map_zip_with(target, source, lambda _, t, s: F.coalesce(t, s))
    return F.coalesce(merged, target, source)


def _is_dictionary(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _slot(key: Column, target: Column, source: Column) -> Column:
    """One value of the merge; with two dictionaries, the one from the source waits in ``other`` to be merged."""
    missing = target.isNull() | F.coalesce(F.is_variant_null(target), F.lit(False))
    return F.struct(
        key.alias("key"), F.when(missing, F.coalesce(source, target)).otherwise(target).alias("value"),
        F.when(_is_dictionary(target) & _is_dictionary(source), source).alias("other"), F.lit(None).cast("int").alias("size"))


def _opened(slot: Column) -> Column:
    """The values of two dictionaries, and after them a slot with their number; other slots stay."""
    target, source = (F.try_variant_get(slot[side], "$", _DICTIONARY) for side in ("value", "other"))
    inner = F.map_values(F.map_zip_with(target, source, _slot))
    none = F.lit(None).cast("variant")
    closing = F.struct(slot["key"].alias("key"), none.alias("value"), none.alias("other"), F.size(inner).alias("size"))
    return F.when(slot["other"].isNotNull(), F.concat(inner, F.array(closing))).otherwise(F.array(slot))


def _closed(stack: Column, slot: Column) -> Column:
    """Put a value on the stack, or make a dictionary of the last ones."""
    below = F.size(stack) - F.coalesce(slot["size"], F.lit(0))
    inner = F.to_variant_object(F.map_from_entries(F.slice(stack, below + 1, F.coalesce(slot["size"], F.lit(0)))))
    value = F.when(slot["size"].isNotNull(), inner).otherwise(slot["value"])
    return F.concat(F.slice(stack, 1, below), F.array(F.struct(slot["key"].alias("key"), value.alias("value"))))


def variant_coalesce(target: Column, source: Column) -> Column:
    """Recursive merge of two dictionaries given as VARIANT, of any depth.

    Keys that are missing or null in the target come from the source, dictionaries
    on both sides are merged, and in any other case the target wins.

    Each step opens the dictionaries of one level, until none is left; there are
    no more levels than braces.
    """

    def step(state: Column, _: Column) -> Column:
        slots = state["slots"]
        opened = F.struct(F.exists(slots, lambda x: x["other"].isNotNull()).alias("open"), F.flatten(F.transform(slots, _opened)).alias("slots"))
        return F.when(state["open"], opened).otherwise(state)

    braces = F.least(*[F.regexp_count(F.to_json(v), F.lit(r"\{")) for v in (target, source)])
    start = F.struct(F.lit(True).alias("open"), F.array(_slot(F.lit("$"), target, source)).alias("slots"))
    slots = F.aggregate(F.sequence(F.lit(0), F.coalesce(braces, F.lit(0))), start, step)["slots"]
    merged = F.aggregate(slots, F.array().cast("array<struct<key:string,value:variant>>"), _closed)[0]["value"]
    return F.when(_is_dictionary(target) & _is_dictionary(source), merged).otherwise(F.coalesce(target, source))


def json_coalesce(target: Column, source: Column) -> Column:
    """Recursive merge of two JSON dictionaries, as JSON text."""
    return F.to_json(variant_coalesce(F.try_parse_json(target), F.try_parse_json(source)))
