"""JSON text: strict parsing, typed reads and assembly.

Objects are assembled from raw members by string concatenation, so nested values that are already
JSON text go in unparsed; a null member is left out.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One pattern for all of them: a value that is computed by a lambda is computed for each mention.
FALSY = r"""^(?:(?:null|""|false|\[\]|\{\})\z|-?0+(\.0+)?([eE][+-]?[0-9]+)?$)"""
# Kinds of objects, arrays and strings.
HOLDER = r"\A(?:OBJECT|ARRAY|STRING\z)"


def string(text: Column) -> Column:
    """A string as JSON text; null stays null."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def boolean(flag: Column) -> Column:
    return F.when(flag, F.lit("true")).when(~flag, F.lit("false"))


def obj(*members: tuple[str, Column]) -> Column:
    """``{"name":value,...}`` of JSON text values; null values are left out."""
    pairs = [F.concat(F.lit(json.dumps(name) + ":"), value) for name, value in members]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def keyed(keys_and_values: Column, key: str = "k", value: str = "v") -> Column:
    """An object out of an array of (key, JSON text value) structs."""
    pairs = F.transform(
        keys_and_values, lambda e: F.concat(string(e[key]), F.lit(":"), e[value])
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def array(values: Column) -> Column:
    """An array out of an array of JSON text values."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def is_truthy(value: Column) -> Column:
    """A JSON value that is neither absent, null, false, zero nor empty."""
    return F.coalesce(~F.rlike(value, F.lit(FALSY)), F.lit(False))


def truthy(value: Column) -> Column:
    """The JSON text itself when truthy, else null."""
    return F.when(is_truthy(value), value)


def non_empty(text: Column) -> Column:
    """Null for the empty string."""
    return F.when(text != "", text)


def _listed(text: Column) -> Column:
    # The JVM parser stops at the end of the first value. Listed in front of its own digest, a text
    # with something behind its value cannot leave the digest in second place.
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def _is_strict(text: Column, listed: Column | None = None) -> Column:
    second = F.try_variant_get(_listed(text) if listed is None else listed, "$[1]", "string")
    return F.coalesce(second == F.md5(text), F.lit(False))


def _reencoded(text):
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return ""


@F.pandas_udf(T.StringType())
def _reencode(texts: pd.Series) -> pd.Series:
    """Last of equal keys wins; empty for what is no JSON."""
    return pd.Series([_reencoded(t) for t in texts], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _reencode_list(lists: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [_reencoded(t) for t in v] for v in lists])


def canonical(text: Column) -> Column:
    """JSON text that parses strictly and has no repeated key, else null.

    Valid texts stay as they are. Only the few that the JVM parser turns down (repeated keys, or
    no JSON at all) take the Arrow path, where the last of equal keys wins.
    """
    again = _reencode(F.when(~_is_strict(text), text))
    return F.when(again.isNull(), text).otherwise(non_empty(again))


def with_canonical(frame: DataFrame, column: str, text: str, value: str) -> DataFrame:
    """Replace a column by its ``canonical`` text and the same as VARIANT, parsed once.

    The value is null beside a text when VARIANT cannot hold it (it is too large).
    """
    rest = [c for c in frame.columns if c != column]
    given, listed = F.col(column), F.col("_listed")
    read = frame.withColumn("_listed", _listed(given))
    read = read.select(*rest, column, "_listed", _reencode(F.when(~_is_strict(given, listed), given)).alias("_again"))
    again = F.col("_again")
    first = F.try_variant_get(listed, "$[0]", "variant")
    return read.select(
        *rest,
        F.when(again.isNull(), given).otherwise(non_empty(again)).alias(text),
        F.when(again.isNull(), first).otherwise(F.try_parse_json(non_empty(again))).alias(value),
    )


def canonical_list(texts: Column) -> Column:
    """``canonical`` for every text of a list; one that fails sends the list down the Arrow path."""
    again = _reencode_list(F.when(~F.forall(texts, lambda c: _is_strict(c)), texts))
    return F.when(again.isNull(), texts).otherwise(F.transform(again, non_empty))


# Typed reads of VARIANT values. An absent member is null; a member that is JSON null is a value of
# kind VOID. Each read costs, so callers take all members of an object once, with `members`.


def member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$['{name}']", "variant")


def members(value: Column, *names: str) -> Column:
    """Struct of the named members of an object."""
    return F.struct(*[member(value, name).alias(name) for name in names])


def variants(*names: str) -> str:
    """Schema reading the named members of an object text as VARIANT."""
    return ", ".join(f"`{name}` VARIANT" for name in names)


# Typed reads of texts, in one pass. They cost far less than reads of VARIANT, but a member of type STRING does
# not tell a string from another value's JSON text, and null is not told from absence. So a typed read counts
# only where nothing of that kind is in doubt; any other text is read as VARIANT.

CORRUPT = "_corrupt_record"
# What the JSON text of a value that is no string looks like: a text that doesn't was a string.
NO_STRING = r"""\A(?:[{\["]|(?:[-+]?[0-9.][0-9.eE+-]*|true|false|[-+]?(?:NaN|INF|Infinity))\z)"""


def typed(text: Column, schema: str) -> Column:
    """A text read with a schema; ``fits`` tells whether every member had its type."""
    return F.from_json(text, f"{schema}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT})


def fits(value: Column) -> Column:
    return value[CORRUPT].isNull()


def has_null(text: Column) -> Column:
    """Whether a text may hold a null (also where a string says so)."""
    return F.contains(text, F.lit("null")) & F.rlike(text, F.lit(r"[:\[,]\s*null"))


def in_doubt(text: Column) -> Column:
    """Whether a member read as STRING may have been something else; an absent one is not."""
    return F.coalesce(F.rlike(text, F.lit(NO_STRING)), F.lit(False))


def bound(value: Column, read) -> Column:
    """``read`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID ...; OBJECT and ARRAY with their element types."""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_other_than_object(value: Column) -> Column:
    """Present, but no object."""
    return F.coalesce(~kind(value).startswith("OBJECT"), F.lit(False))


def is_optional_string(value: Column) -> Column:
    """Absent, null or a string."""
    return F.coalesce(kind(value).isin("STRING", "VOID"), F.lit(True))


def text(value: Column) -> Column:
    """A string as it is, other values as JSON text, null for null."""
    return F.try_variant_get(value, "$", "string")


def as_string(value: Column) -> Column:
    """The string, or null when the value is anything else."""
    return F.when(kind(value) == "STRING", text(value))


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_text(value: Column) -> Column:
    """JSON text of a value; null for absent and null."""
    return F.when(~F.is_variant_null(value), F.to_json(value))


# Spellings a flag may have.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")


def as_flag(value: Column) -> Column:
    """A boolean, or a number or word that stands for one; false when absent, else null."""
    word = F.regexp_replace(F.lower(text(value)), r"^([01])\.0+$", "$1")
    return (
        F.when(value.isNull(), False)
        .when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(word.isin(*TRUE_WORDS), True)
        .when(word.isin(*FALSE_WORDS), False)
    )


def is_string_list(value: Column) -> Column:
    """Absent, null or an array of strings only."""
    return (
        F.when(value.isNull() | F.is_variant_null(value), True)
        .otherwise(F.coalesce(F.forall(as_array(value), is_string), F.lit(False)))
    )


def as_string_list(value: Column) -> Column:
    return F.transform(as_array(value), text)
