"""Coercion of a reader's reply fields, and strict JSON, as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.text import unicode_trim
from newsdesk.sources.catalogue import CATEGORY_SYNONYMS

MIN_SEVERITY, MAX_SEVERITY = 1, 4

# Integers that fit 64 bits only without a sign; JSON numbers in this range are DECIMAL.
UNSIGNED_ONLY = (Decimal(2**63), Decimal(2**64 - 1))


def json_pair(text: Column) -> Column:
    """VARIANT array of the JSON value in ``text`` and a hash of the text.

    ``try_parse_json`` stops after the first value and ignores the rest of a text. With
    the hash behind it, trailing text changes the shape of the array.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), _seal(text), F.lit("]")))


def whole_value(pair: Column, text: Column) -> Column:
    """The value of a :func:`json_pair` whose text was exactly one JSON value, else null."""
    whole = F.try_variant_get(pair, "$[1]", "string").eqNullSafe(_seal(text)) & F.try_variant_get(
        pair, "$[2]", "variant"
    ).isNull()
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def one_json_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else, whatever keys it repeats.

    Between two members of an object it must leave just those two: the keys tell text that
    closes the object or adds a member, and the strict parse tells everything else.
    """
    between = F.concat(F.lit('{"v":'), text, F.lit(',"s":0}'))
    strict = F.from_json(
        between, "v STRING, s STRING, _malformed STRING",
        {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_malformed"},
    )
    keys = F.json_object_keys(between)
    return F.coalesce((keys == F.array(F.lit("v"), F.lit("s"))) & strict["_malformed"].isNull(), F.lit(False))


def _seal(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def coerce_severity(severity: Column) -> Column:
    """1..4 from a dynamically typed value.

    Unsigned 64-bit integers wrap to one byte before the clamp; strings must spell an
    integer of one byte; anything else counts as 1.
    """
    kind = F.schema_of_variant(severity)
    whole = F.try_variant_get(severity, "$", "bigint")
    wide = F.try_variant_get(severity, "$", "decimal(20,0)")
    text = unicode_trim(F.try_variant_get(severity, "$", "string"))
    spelled = F.when(
        F.regexp_like(text, F.lit(r"^\+?[0-9]+$")), text.try_cast("decimal(38,0)")
    )
    value = (
        F.when((kind == "BIGINT") & (whole >= 0), whole % 256)
        .when(kind.startswith("DECIMAL") & wide.between(*UNSIGNED_ONLY), wide % 256)
        .when((kind == "STRING") & (spelled <= 255), spelled)
        .otherwise(MIN_SEVERITY)
        .cast("int")
    )
    return F.greatest(F.lit(MIN_SEVERITY), F.least(F.lit(MAX_SEVERITY), value))


def category_spelling(category: Column) -> Column:
    """The form in which a reply's category is looked up; it is not trimmed."""
    return F.translate(F.lower(category), "_", "-")


def coerce_category(category: Column) -> Column:
    """Band of a free-text category; unknown spellings count as ``drop``."""
    spelling = category_spelling(category)
    band = F.lit("drop")
    for name, synonyms in CATEGORY_SYNONYMS.items():
        band = F.when(spelling.isin(*synonyms), F.lit(name)).otherwise(band)
    return band


def coerce_confidence(confidence: Column) -> Column:
    return F.when(confidence == "", F.lit("low")).otherwise(F.lower(confidence))
