"""Column types inferred from JSON values, and conversion on write."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rowtide.functions.json_text import is_json_container
from rowtide.functions.text import canonical_uuid, is_uuid_text, trim_white

# The six column types. Aggregations carry the small integer
# code, which keeps them in hash aggregation; names appear at the end.
TYPE_NAMES = ["TEXT", "BOOLEAN", "BIGINT", "DOUBLE", "UUID", "JSONB"]
TEXT, BOOLEAN, BIGINT, DOUBLE, UUID, JSONB = range(6)

SPARK_TYPES = {
    "TEXT": "string",
    "BOOLEAN": "boolean",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "UUID": "string",
    "JSONB": "string",
}

# Which value types a column accepts (column <- values).
ACCEPTED = {
    "TEXT": ["TEXT", "BOOLEAN", "BIGINT", "DOUBLE", "UUID", "JSONB"],
    "DOUBLE": ["DOUBLE", "BIGINT"],
    "BIGINT": ["BIGINT", "DOUBLE"],
    "BOOLEAN": ["BOOLEAN"],
    "UUID": ["UUID"],
    "JSONB": ["JSONB"],
}

U64_MAX = "18446744073709551615"
_BIGINT_LIMIT = 9.2233720368547758e18


def infer_type_code(tag: Column, raw: Column) -> Column:
    """Type code of one JSON value from its variant tag and raw token."""
    unsigned = raw.rlike(r"^\d{1,20}$") & (F.lpad(raw, 20, "0") <= F.lit(U64_MAX))
    return (
        F.when(tag.isNull() | (tag == "VOID"), F.lit(TEXT))
        .when(tag == "BOOLEAN", F.lit(BOOLEAN))
        .when(tag == "BIGINT", F.lit(BIGINT))
        .when(tag.startswith("DECIMAL"), F.when(unsigned, F.lit(BIGINT)).otherwise(F.lit(DOUBLE)))
        .when(tag.isin("DOUBLE", "FLOAT"), F.lit(DOUBLE))
        .when(
            tag == "STRING",
            F.when(is_uuid_text(raw), F.lit(UUID))
            .when(is_json_container(raw), F.lit(JSONB))
            .otherwise(F.lit(TEXT)),
        )
        .otherwise(F.lit(JSONB))
    )


def type_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TYPE_NAMES]), code + 1)


def infer_type(tag: Column, raw: Column) -> Column:
    return type_name(infer_type_code(tag, raw))


def storable(column_type: Column, value_type: Column) -> Column:
    """Whether a value of ``value_type`` may be written to ``column_type``."""
    verdict = F.lit(False)
    for target, accepted in ACCEPTED.items():
        verdict = F.when(column_type == target, value_type.isin(accepted)).otherwise(verdict)
    return verdict


def cast_raw(raw: Column, column_type: str) -> Column:
    """Raw token -> Spark value of an established column type, NULL if impossible."""
    if column_type == "TEXT":
        return raw
    if column_type == "BOOLEAN":
        return F.when(raw.isin("true", "false"), raw == "true")
    if column_type == "BIGINT":
        # Doubles are rounded half to even on assignment to an integer column.
        number = raw.try_cast("double")
        return F.coalesce(_exact_bigint(raw), F.when(fits_bigint(number), F.rint(number).cast("bigint")))
    if column_type == "DOUBLE":
        return raw.try_cast("double")
    if column_type == "UUID":
        return F.when(is_uuid_text(raw), canonical_uuid(raw))
    if column_type == "JSONB":
        return trim_white(raw)
    raise ValueError(f"unknown column type {column_type!r}")


def fits_bigint(number: Column) -> Column:
    """Whether a double, rounded, is one of 64 signed bits."""
    rounded = F.rint(number)
    return (rounded >= -_BIGINT_LIMIT) & (rounded < _BIGINT_LIMIT)


def _exact_bigint(raw: Column) -> Column:
    return F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("bigint"))


def cast_cell(raw: Column, column_type: Column) -> Column:
    """Text form of a converted value when the column type is itself data."""
    converted = F.lit(None).cast("string")
    for name in TYPE_NAMES:
        converted = F.when(column_type == name, cast_raw(raw, name).cast("string")).otherwise(converted)
    return converted


def canonical_key(raw: Column, is_number: Column | None = None) -> Column:
    """Key text under which equal keys meet.

    UUIDs in lower case; JSON numbers of one value alike however they are
    written (``5``, ``5.0``, ``5e0``); other strings as they are.
    ``is_number`` is only looked at where a spelling other than the plain
    integer may stand for a number.
    """
    key = F.when((F.length(raw) >= 36) & is_uuid_text(raw), canonical_uuid(raw))
    if is_number is not None:
        odd = raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$") & ~raw.rlike(r"^(0|-?[1-9]\d*)$")
        key = key.when(odd, F.when(is_number, _plain_number(raw)).otherwise(raw))
    return key.otherwise(raw)


def _plain_number(raw: Column) -> Column:
    exact = raw.try_cast("decimal(38,10)")
    whole = exact.try_cast("decimal(28,0)")
    return F.coalesce(F.when(exact == whole, whole.cast("string")), raw.try_cast("double").cast("string"), raw)
