"""Card layout and delivery lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.replies import MAX_SEVERITY

FILLED, EMPTY = "●", "○"
BRAND = "Newsdesk"

CARD_TYPE = (
    "STRUCT<username: STRING, embeds: ARRAY<STRUCT<title: STRING, url: STRING, color: INT, "
    "description: STRING, fields: ARRAY<STRUCT<name: STRING, value: STRING, inline: BOOLEAN>>, "
    "footer: STRUCT<text: STRING>>>>"
)


def meter(severity: Column) -> Column:
    """Four glyphs, filled up to the severity."""
    return F.concat(
        F.repeat(F.lit(FILLED), severity),
        F.repeat(F.lit(EMPTY), F.lit(MAX_SEVERITY) - severity),
    )


def card(brand: str = BRAND) -> Column:
    """Card struct over ``label emoji color title link source read severity confidence``."""

    def inline_field(name: str, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline")
        )

    severity = F.col("severity")
    return F.struct(
        F.lit(brand).alias("username"),
        F.array(
            F.struct(
                F.concat_ws(" ", "emoji", "title").alias("title"),
                F.col("link").alias("url"),
                F.col("color"),
                F.concat(F.lit("**"), F.col("read"), F.lit("**")).alias("description"),
                F.array(
                    inline_field("Band", F.col("label")),
                    inline_field(
                        "Severity",
                        F.concat(
                            meter(severity),
                            F.format_string(f"  %d/{MAX_SEVERITY}", severity),
                        ),
                    ),
                    inline_field("Confidence", F.col("confidence")),
                ).alias("fields"),
                F.struct(
                    F.concat(F.lit(f"{brand} · "), F.col("source")).alias("text")
                ).alias("footer"),
            )
        ).alias("embeds"),
    )


def card_json(card_struct: Column, pretty: bool = False) -> Column:
    return F.to_json(card_struct, {"pretty": "true"}) if pretty else F.to_json(card_struct)


def outcome(dry: bool, channel: Column, failure: Column) -> Column:
    """``dry`` wins over everything; without a channel a card is ``held``."""
    if dry:
        return F.lit("dry")
    return (
        F.when(channel.isNull(), F.lit("held"))
        .when(failure.isNotNull(), F.lit("failed"))
        .otherwise(F.lit("posted"))
    )


def delivery_line(result: Column, failure: Column) -> Column:
    """Activity line of one popped card over ``emoji label title``."""
    emoji, label, title = F.col("emoji"), F.col("label"), F.col("title")
    return (
        F.when(result == "dry", F.format_string("[dry] %s %s — %s", emoji, label, title))
        .when(result == "posted", F.format_string("posted %s %s — %s", emoji, label, title))
        .when(result == "failed", F.format_string("post FAILED %s — %s", label, failure))
        .otherwise(F.format_string("no webhook for %s — held", label))
    )
