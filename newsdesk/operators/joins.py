"""Dimension lookups.

Tables of fixed values are hinted for broadcast. For every other side Spark decides: a table's
file size, or its measured shuffle size under adaptive execution, is checked against
``spark.sql.autoBroadcastJoinThreshold``, and a larger side is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.functions.replies import category_spelling
from newsdesk.sources import catalogue

def with_skin(cards: DataFrame) -> DataFrame:
    """Add ``label, emoji, color``; every category has a skin."""
    return cards.join(F.broadcast(catalogue.skins(cards.sparkSession)), "category")


def with_channel(cards: DataFrame, routes: DataFrame) -> DataFrame:
    """Add ``channel``, null for a category without a route. ``routes`` is N:1 on category."""
    return cards.join(routes, "category", "left")


def with_band(replies: DataFrame, category: str = "category") -> DataFrame:
    """Replace a free-text category by its band, ``drop`` when no spelling matches."""
    spellings = F.broadcast(
        catalogue.synonyms(replies.sparkSession).withColumnRenamed("category", "_band")
    )
    return (
        replies.withColumn("spelling", category_spelling(F.col(category)))
        .join(spellings, "spelling", "left")
        .withColumn(category, F.coalesce("_band", F.lit("drop")))
        .drop("spelling", "_band")
    )
