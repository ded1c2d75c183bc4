"""Columns that are computed once per row, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later projections and filters read instead of repeating.

    Spark moves filters below ordinary projections by substituting their expressions, and
    infers filters from generators: a text would be parsed once per use. It does not move
    them below a generator of a literal array.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))
