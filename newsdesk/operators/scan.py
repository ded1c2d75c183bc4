"""Running sums and their running least over long histories, by a prefix scan over blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 4096
"""Positions of one block; no window has more rows of a key."""


def scanned(rows: DataFrame, keys: Sequence[str], position: str, step: str, span: int, block: int = BLOCK) -> DataFrame:
    """Add ``total``, ``least`` and ``least_before`` of ``step`` to every row.

    ``total`` is the sum of ``step`` within ``keys`` up to the row, in the order of ``position``; ``least`` the
    smallest total so far, and ``least_before`` the one before the row, null at the first. Positions are
    whole, unique within a key, and ``span`` of them lie between the first and the last.

    A stretch of rows is summed up by its sum and its least running sum, and two neighbouring stretches by those of both;
    so blocks are scanned on their own, then their summaries as rows of a shorter history, and so on up.
    """
    if block < 4:
        raise ValueError("blocks of fewer than four positions need not get fewer")
    return _scan(rows.withColumns({"_sum": F.col(step), "_low": F.col(step)}), list(keys), position, span, block).drop("_sum", "_low")


def _scan(rows: DataFrame, keys: list[str], position: str, span: int, block: int) -> DataFrame:
    if span <= block:
        return _within(rows, W.partitionBy(*(keys or [F.lit(0)])).orderBy(position))
    of = f"{position}_block"
    dealt = rows.withColumn(of, F.expr(f"({position} - pmod({position}, {block})) div {block}"))
    line = W.partitionBy(*keys, of).orderBy(position)
    blocks = _within(dealt.select(*keys, of, position, "_sum", "_low"), line).groupBy(*keys, of)
    blocks = blocks.agg(F.sum("_sum").alias("_sum"), F.min("least").alias("_low"))
    earlier = _scan(blocks, keys, of, (span - 1) // block + 2, block).select(
        *keys, of, (F.col("total") - F.col("_sum")).alias("_total"), F.col("least_before").alias("_least")
    )
    return (
        _within(dealt, line)
        .join(earlier, [*keys, of])
        .withColumns(
            {
                "total": F.col("_total") + F.col("total"),
                "least": F.least("_least", F.col("_total") + F.col("least")),
                "least_before": F.least("_least", F.col("_total") + F.col("least_before")),
            }
        )
        .drop(of, "_total", "_least")
    )


def _within(rows: DataFrame, line) -> DataFrame:
    """The scan of the rows of one window."""
    upto, before = line.rowsBetween(W.unboundedPreceding, 0), line.rowsBetween(W.unboundedPreceding, -1)
    summed = rows.withColumn("total", F.sum("_sum").over(upto))
    low: Column = F.col("total") - F.col("_sum") + F.col("_low")
    return summed.withColumn("least", F.min(low).over(upto)).withColumn("least_before", F.min(low).over(before))
