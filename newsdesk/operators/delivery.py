"""Popped cards: routing, themed payloads, outcomes and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import cards as C
from newsdesk.operators.joins import with_channel, with_skin

# A poster sends (channel, payload) pairs of one Arrow batch and returns, for each, null
# or the text of the failure.
Poster = Callable[[pd.Series, pd.Series], "list[str | None]"]


def themed(cards: DataFrame, brand: str = C.BRAND) -> DataFrame:
    """Add ``label, emoji, color`` and the ``card`` payload."""
    return with_skin(cards).withColumn("card", C.card(brand))


def routed(cards: DataFrame, routes: DataFrame, brand: str = C.BRAND) -> DataFrame:
    """Themed cards with their ``channel``, null where the category has no route."""
    return with_channel(themed(cards, brand), routes)


def with_outcome(cards: DataFrame, dry: bool = False, failure: str | None = None) -> DataFrame:
    """Add ``outcome`` and ``line`` to routed cards that were popped.

    ``failure`` names a column with the failed post's text, null where it succeeded.
    Every popped card has left the queue, whatever its outcome.
    """
    text = F.lit(None).cast("string") if failure is None else F.col(failure)
    return cards.withColumn("outcome", C.outcome(dry, F.col("channel"), text)).withColumn(
        "line", C.delivery_line(F.col("outcome"), text)
    )


def posted_by(cards: DataFrame, poster: Poster) -> DataFrame:
    """Add ``failure`` by handing every routed card's JSON to ``poster``.

    The poster has side effects: write the result down before using it.
    """
    schema = cards.drop("card").schema.add("failure", "string")

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            routed = batch["channel"].notna()
            failures = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if routed.any():
                failures[routed] = poster(batch.loc[routed, "channel"], batch.loc[routed, "_payload"])
            yield batch.drop(columns="_payload").assign(failure=failures)

    return cards.withColumn("_payload", C.card_json(F.col("card"))).drop("card").mapInPandas(post, schema)


def write_channels(cards: DataFrame, path: str) -> None:
    """One JSON folder per channel; a busy channel is written by many tasks."""
    (
        cards.where(F.col("channel").isNotNull())
        .select("channel", C.card_json(F.col("card")).alias("value"))
        .write.mode("overwrite")
        .partitionBy("channel")
        .text(path)
    )
