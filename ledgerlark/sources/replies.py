"""Quote replies whose fields drift: read as VARIANT, typed field by field.

A reply is one JSON map of symbol to fields. A field that is missing or of a wrong type is
NULL and harms no other; unknown fields are left out of the rows and counted instead.
Nothing is lost in silence: what gives no row is among the rejects, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite, is_floating
from ..schema import QUOTE_SCHEMA

# What may be wrong with a reply or with the entry of a symbol.
EMPTY, NO_JSON, NO_MAP, NO_FIELDS = "empty", "no JSON", "no map", "no fields"
# What may be said of a field of an entry.
READ, ABSENT, WRONG, UNKNOWN = "read", "missing", "wrong type", "unknown"


def _map(document: str) -> Column:
    return F.expr(f"try_variant_get({document}, '$', 'map<string, variant>')")


def _entries(replies: DataFrame, column: str) -> DataFrame:
    """Every symbol of every reply: ``symbol, _entry`` and its ``_fields``, NULL if it has none."""
    documents = replies.select(*_other(replies, column), F.try_parse_json(F.col(column)).alias("_doc"))
    entries = documents.select(*_other(replies, column), F.explode(_map("_doc")).alias("symbol", "_entry"))
    return entries.withColumn("_fields", _map("_entry"))


def _other(replies: DataFrame, column: str) -> list[str]:
    return [c for c in replies.columns if c != column]


def _given(name: str) -> Column:
    """The field as a variant; NULL if it is absent or null."""
    value = F.try_element_at("_fields", F.lit(name))
    return F.when(~F.is_variant_null(value), value)


def _cast(field: T.StructField) -> Column:
    value = F.try_variant_get(_given(field.name), "$", field.dataType.simpleString())
    return finite(value) if is_floating(field.dataType) else value


def drifting_quotes(replies: DataFrame, schema: T.StructType = QUOTE_SCHEMA, column: str = "value") -> DataFrame:
    """One row per reply and symbol with the fields of ``schema``, beside the other columns of
    ``replies``. Numbers in quotes are numbers."""
    found = _entries(replies, column).where(F.col("_fields").isNotNull())
    return found.select(*_other(replies, column), "symbol", *[_cast(f).alias(f.name) for f in schema.fields])


def drifting_rejects(replies: DataFrame, column: str = "value") -> DataFrame:
    """``(symbol, reason, reply)`` beside the other columns: replies that are no JSON map, and
    symbols of the others whose entry has no fields."""
    other, text = _other(replies, column), F.col(column)
    documents = replies.select(*other, text.alias("reply"), F.try_parse_json(text).alias("_doc"))
    whole = F.when(F.coalesce(F.trim("reply"), F.lit("")) == "", EMPTY).when(F.col("_doc").isNull(), NO_JSON).when(_map("_doc").isNull(), NO_MAP)
    entries = F.transform_values(_map("_doc"), lambda _, entry: F.try_variant_get(entry, "$", "map<string, variant>").isNull())
    empty = F.map_keys(F.map_filter(entries, lambda _, bad: bad))
    reason = F.coalesce("_whole", F.lit(NO_FIELDS)).alias("reason")
    found = documents.select(*other, "reply", whole.alias("_whole"), empty.alias("_empty"))
    symbols = F.when(F.col("_whole").isNotNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("_empty"))
    return found.select(*other, F.explode(symbols).alias("symbol"), reason, "reply")


def field_drift(replies: DataFrame, schema: T.StructType = QUOTE_SCHEMA, column: str = "value") -> DataFrame:
    """``(field, state, n, type)``: how many entries have a field in which state, and the type
    that holds all values of the unknown and the wrongly typed ones.

    Fields are counted where they are read and added up, so the result has a few rows per
    field name.
    """
    one = lambda name, state, value: F.struct(name.alias("field"), state.alias("state"), value.alias("value"))

    def known(field: T.StructField) -> Column:
        value = _given(field.name)
        state = F.when(value.isNull(), ABSENT).when(_cast(field).isNull(), WRONG).otherwise(READ)
        return one(F.lit(field.name), state, value)

    names = F.array(*[F.lit(f.name) for f in schema.fields])
    unknown = F.transform(
        F.filter(F.map_entries("_fields"), lambda e: ~F.array_contains(names, e["key"])),
        lambda e: one(e["key"], F.lit(UNKNOWN), e["value"]),
    )
    fields = F.concat(F.array(*[known(f) for f in schema.fields]), unknown)
    rows = _entries(replies, column).where(F.col("_fields").isNotNull()).select(F.inline(fields))
    drifted = F.when(F.col("state").isin(WRONG, UNKNOWN), F.col("value"))
    kinds = F.schema_of_variant_agg(drifted)
    return rows.groupBy("field", "state").agg(F.count(F.lit(1)).alias("n"), kinds.alias("type"))
