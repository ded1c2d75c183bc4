"""The queue as keyed state with timers: cards wait per channel and leave at that channel's own ticks.

Where the desk keeps one queue in tables and drips it from a clock query, this form keeps a queue per key in the state store:
cards lie in a map by severity and place in line, next to the first and last place of each severity, so that an
arrival or a pop touches one entry however long the line is. A processing-time timer per key wakes the queue every
``seconds`` while cards wait; a restart goes on with the state and timers of its checkpoint.

Sessions that run it need the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from newsdesk.functions.replies import MAX_SEVERITY, MIN_SEVERITY

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STRONGEST_FIRST = range(MAX_SEVERITY, MIN_SEVERITY - 1, -1)


def use_state_store(spark: SparkSession) -> None:
    """Let streaming queries of this session keep keyed state in RocksDB."""
    spark.conf.set(STATE_STORE, ROCKS_DB)


class Lines(StatefulProcessor):
    """One line per severity of one key; ``most`` cards leave at a tick, strongest first, then in order of arrival."""

    def __init__(self, key: str, columns: T.StructType, order: tuple[str, ...], most: int, seconds: float):
        self.key, self.order, self.most, self.period = key, list(order), most, int(seconds * 1000)
        self.columns = columns
        self.names = [c for c in columns.names if c not in (key, "severity")]

    def init(self, handle) -> None:
        place = T.StructType([T.StructField("severity", T.IntegerType()), T.StructField("place", T.LongType())])
        self.handle = handle
        self.cards = handle.getMapState("cards", place, T.StructType([self.columns[name] for name in self.names]))
        ends = [T.StructField(f"{end}_{s}", T.LongType()) for s in STRONGEST_FIRST for end in ("first", "next")]
        self.ends = handle.getValueState("ends", T.StructType(ends))

    def _ends(self) -> dict[int, list[int]]:
        """By severity: the place of the first waiting card, and the next free one."""
        flat = list(self.ends.get()) if self.ends.exists() else [0] * (2 * len(STRONGEST_FIRST))
        return {s: flat[2 * i : 2 * i + 2] for i, s in enumerate(STRONGEST_FIRST)}

    def _keep(self, ends: dict[int, list[int]]) -> None:
        self.ends.update(tuple(n for s in STRONGEST_FIRST for n in ends[s]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Line up a micro-batch's cards; rows reach a key unordered, so they are put in order of arrival first."""
        ends = self._ends()
        idle = all(first == free for first, free in ends.values())
        arrived = pd.concat(rows, ignore_index=True).sort_values(self.order, kind="stable")
        values = arrived[self.names].astype(object).where(arrived[self.names].notna(), None)
        for severity, card in zip(arrived["severity"].tolist(), values.itertuples(index=False, name=None), strict=True):
            line = ends[min(max(int(severity), MIN_SEVERITY), MAX_SEVERITY)]
            self.cards.updateValue((min(max(int(severity), MIN_SEVERITY), MAX_SEVERITY), line[1]), card)
            line[1] += 1
        self._keep(ends)
        if idle and len(arrived):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.period)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """One tick: the front of the strongest lines leaves; the next tick comes a period later while cards wait."""
        ends, left = self._ends(), []
        for severity in STRONGEST_FIRST:
            line = ends[severity]
            while line[0] < line[1] and len(left) < self.most:
                place = (severity, line[0])
                left.append((key[0], severity, *self.cards.getValue(place)))
                self.cards.removeKey(place)
                line[0] += 1
        self._keep(ends)
        if any(first < free for first, free in ends.values()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.period)
        out = pd.DataFrame(left, columns=[self.key, "severity", *self.names])
        yield out.assign(left_ms=expiredTimerInfo.getExpiryTimeInMs(), place=range(1, len(left) + 1))

    def close(self) -> None:
        pass


def drained(cards: DataFrame, key: str, order: tuple[str, ...], most: int, seconds: float) -> DataFrame:
    """Stream of cards as they leave the queue of their ``key``, with ``left_ms`` and ``place`` within the tick.

    ``cards`` is a stream with a ``severity``; ``order`` are the columns that tell the arrival of cards of one micro-batch,
    and a later micro-batch arrives later. A card waits in the state store until it leaves. A null key is a
    key; severities are clamped.
    """
    columns = cards.schema
    rest = [columns[name] for name in columns.names if name not in (key, "severity")]
    made = T.StructType(
        [columns[key], T.StructField("severity", T.IntegerType()), *rest, T.StructField("left_ms", T.LongType()), T.StructField("place", T.LongType())]
    )
    lines = Lines(key, columns, order, most, seconds)
    return cards.groupBy(key).transformWithStateInPandas(lines, made, "Append", "ProcessingTime")
