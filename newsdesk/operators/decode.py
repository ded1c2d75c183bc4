"""Strict decoding of JSON columns, one parse per row."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions.barrier import computed_once
from newsdesk.functions.replies import is_text, json_pair, one_json_value, whole_value

TEXT_FIELDS = ("category", "read", "confidence")
JSON_SPACE = " \t\r\n"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_malformed"}
OBJECT_SCHEMA = "category VARIANT, read VARIANT, confidence VARIANT, severity STRING, _malformed STRING"
FIELD_POSITIONS = {"category": 0, "read": 1, "severity": 2, "confidence": 3}


def with_json(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the VARIANT of a text that is exactly one JSON value, else null."""
    parsed = computed_once(df, {"_pair": json_pair(F.col(text))})
    return computed_once(parsed, {into: whole_value(F.col("_pair"), F.col(text))}).drop("_pair")


def _at_most_once(keys: str, name: str) -> Column:
    return F.size(F.filter(keys, lambda key: key == name)) <= 1


def with_reply(df: DataFrame, raw: str, into: str) -> DataFrame:
    """Add ``STRUCT<category, read, confidence, severity VARIANT>`` of a valid reply, else null.

    A reply is an object, or an array of the fields in order. Absent fields take
    defaults; a text field that is present but not a string, one of the four keys given twice, a severity beyond
    any number, or trailing text makes the whole reply an error, so that its item is offered again. Other keys are
    skipped, however often they are given, and so is what lies within a severity that is no single value.
    """
    opening = F.left(F.ltrim(F.col(raw), F.lit(JSON_SPACE)), F.lit(1))
    opened = computed_once(df, {"_opening": opening})
    is_object, is_array = F.col("_opening") == "{", F.col("_opening") == "["
    parsed = computed_once(
        opened,
        {
            "_keys": F.json_object_keys(F.when(is_object, F.col(raw))),
            "_whole": F.when(is_object, one_json_value(F.col(raw))),
            "_object": F.from_json(F.when(is_object, F.col(raw)), OBJECT_SCHEMA, STRICT_JSON),
            "_pair": json_pair(F.when(is_array, F.col(raw))),
        },
    )
    # A severity of several values counts as none; their keys may repeat.
    single = ~F.coalesce(F.left("_object.severity", F.lit(1)).isin("{", "["), F.lit(False))
    scalar = F.from_json(F.when(is_object & single, F.col(raw)), "severity VARIANT", STRICT_JSON)
    parsed = computed_once(parsed, {"_array": whole_value(F.col("_pair"), F.col(raw)), "_scalar": scalar, "_single": single})
    fields = {
        f"_{name}": F.when(
            is_object, F.col(f"_scalar.{name}") if name == "severity" else F.col(f"_object.{name}")
        ).when(is_array, F.try_variant_get("_array", f"$[{at}]", "variant"))
        for name, at in FIELD_POSITIONS.items()
    }
    known = [_at_most_once("_keys", name) for name in FIELD_POSITIONS]
    too_long = F.try_variant_get("_array", f"$[{len(FIELD_POSITIONS)}]", "variant").isNotNull()
    an_object = F.col("_whole") & F.col("_object._malformed").isNull() & reduce(and_, known)
    shaped = F.when(is_object, an_object).when(is_array, F.col("_array").isNotNull() & ~too_long)
    parsed = computed_once(parsed, {**fields, "_shaped": F.coalesce(shaped, F.lit(False))})
    texts = [F.coalesce(is_text(F.col(f"_{name}")), F.lit(True)) for name in TEXT_FIELDS]
    number = F.schema_of_variant("_severity").isin("DOUBLE", "FLOAT")
    beyond = F.coalesce(number & (F.abs(F.try_variant_get("_severity", "$", "double")) == float("inf")), F.lit(False))
    reply = F.struct(
        *[
            F.coalesce(F.try_variant_get(f"_{name}", "$", "string"), F.lit("")).alias(name)
            for name in TEXT_FIELDS
        ],
        F.col("_severity").alias("severity"),
    )
    valid = reduce(and_, texts, F.col("_shaped")) & ~beyond
    return computed_once(parsed, {into: F.when(valid, reply)}).drop(
        "_opening", "_keys", "_whole", "_object", "_pair", "_array", "_scalar", "_single", "_shaped", *fields
    )


def with_response(df: DataFrame, body: str, into: str) -> DataFrame:
    """Add the reply text inside a model server's ``{"response": "<json>"}`` body, else null."""
    response = F.try_variant_get("_json", "$.response", "variant")
    found = computed_once(with_json(df, body, "_json"), {"_response": response})
    text = F.when(is_text(F.col("_response")), F.try_variant_get("_response", "$", "string"))
    return found.withColumn(into, text).drop("_json", "_response")
