"""Strict decoding of JSON texts into maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowtide.functions.text import trim_white

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_object(text: Column) -> Column:
    """JSON object text -> ``MAP<STRING,STRING>`` of raw tokens, else NULL.

    Quoted and bare values look alike here; ``parse_object_typed`` keeps them
    apart. A repeated key keeps its last value; an explicit null stays a key
    with a NULL value.
    """
    return _sole_object(text, "string")


def parse_object_typed(text: Column) -> Column:
    """JSON object text -> ``MAP<STRING,VARIANT>``, else NULL."""
    return _sole_object(text, "variant")


def envelope_object(text: Column) -> Column:
    """Like ``parse_object_typed`` but repeated keys are kept for inspection."""
    return _wrapped(text, "variant", lambda m: m)


def _sole_object(text: Column, value_type: str) -> Column:
    return _wrapped(text, value_type, _last_value_wins)


def _wrapped(text: Column, value_type: str, finish) -> Column:
    # Spark's parser stops after the first JSON value and ignores what follows.
    # As the first item of a two-item array the text is parsed to its end:
    # trailing text breaks the array, and a second object changes its size.
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit(",{}]")), f"array<map<string,{value_type}>>", STRICT
    )

    def only_first(a: Column) -> Column:
        whole = (F.size(a) == 2) & F.get(a, F.lit(0)).isNotNull() & (F.size(F.get(a, F.lit(1))) == 0)
        return F.when(whole, finish(F.get(a, F.lit(0))))

    # transform over a one-item array binds the parsed value to a name
    return F.get(F.transform(F.array(items), only_first), F.lit(0))


def _last_value_wins(parsed: Column) -> Column:
    keys = F.map_keys(parsed)
    entries = F.map_entries(parsed)
    last_of_each = F.filter(
        entries,
        lambda entry, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), entry["key"]),
    )
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    return F.when(repeated, F.map_from_entries(last_of_each)).otherwise(parsed)


def is_json_container(text: Column) -> Column:
    """Trimmed text is one whole JSON object or array."""
    trimmed = trim_white(text)
    bracketed = trimmed.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    items = F.from_json(F.concat(F.lit("["), trimmed, F.lit(",0]")), "array<variant>", STRICT)
    return F.when(bracketed, F.coalesce(F.size(items) == 2, F.lit(False))).otherwise(F.lit(False))


def type_tag(value: Column) -> Column:
    """Variant's own type, e.g. ``STRING``, ``BIGINT``, ``DECIMAL(2,1)``."""
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """String content of a variant."""
    return F.try_variant_get(value, "$", "string")


def string_only(value: Column) -> Column:
    """String content when the variant is a JSON string, else NULL."""
    return F.when(type_tag(value) == "STRING", text_of(value))
