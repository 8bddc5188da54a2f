"""Reading heterogeneous JSON: presence, truth, value types and renderings.

A parsed value is a VARIANT. An absent field reads as NULL, a JSON null as a
VARIANT null, so that the two can be told apart.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

_FALSE_TEXTS = ["null", "false", "0", '""', "[]", "{}"]


def parse(text: Column | str) -> Column:
    """Text to VARIANT; malformed text is NULL."""
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def text_of(value: Column, name: str) -> Column:
    """A field as string; JSON null and absent are NULL."""
    return F.try_variant_get(value, f"$.{name}", "string")


def truthy(value: Column) -> Column:
    """False for absent, null, false, zero and empty values; true for all others."""
    number = F.try_variant_get(value, "$", "double")
    zero = F.coalesce((number == 0) & ~is_text(value), F.lit(False))
    return F.coalesce(~F.to_json(value).isin(_FALSE_TEXTS), F.lit(False)) & ~zero


def strings_of(value: Column) -> Column:
    """A list as array of strings; a scalar becomes a list of one; NULLs dropped, empty is NULL."""
    scalar = F.try_variant_get(value, "$", "string")
    items = F.when(is_list(value), F.try_variant_get(value, "$", "array<string>")).otherwise(
        F.when(scalar.isNotNull(), F.array(scalar))
    )
    kept = F.array_compact(items)
    return F.when(F.size(kept) > 0, kept)


def _is_whole_decimal(kind: Column) -> Column:
    # Whole numbers beyond 64 bits are held as decimals without fraction digits; a
    # shorter decimal of that form was written with a fraction part such as '.0'.
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)
    return F.coalesce(digits.try_cast("int") >= 19, F.lit(False))


def dtype_of(value: Column) -> Column:
    """One of null, bool, int64, float64, string, array, struct, unknown."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull() | (kind == "VOID"), "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int64")
        .when(_is_whole_decimal(kind), "int64")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT"), "float64")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "struct")
        .otherwise("unknown")
    )


def scalar_text(value: Column) -> Column:
    """Strings, numbers and booleans as plain text ('True', '1.0'); other values NULL."""
    kind = dtype_of(value)
    plain = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "bool", F.initcap(plain))
        .when((kind == "float64") & ~plain.rlike("[.eE]"), F.concat(plain, F.lit(".0")))
        .when(kind.isin("string", "int64", "float64"), plain)
    )


def ordered_entries(row: Column | str) -> Column:
    """The entries of a JSON object in written order, values as VARIANT."""
    return F.map_entries(F.from_json(row, "map<string,variant>"))


def row_text(row: Column | str, max_chars: int | None = None) -> Column:
    """Scalar values of a JSON object in key order, joined by a space."""
    texts = F.transform(ordered_entries(row), lambda entry: scalar_text(entry.value))
    joined = F.array_join(F.array_compact(texts), " ")
    return joined if max_chars is None else F.substring(joined, 1, max_chars)
