"""The ledger of seen fingerprints: segments dealt by a hash, merged as they pile up, and read only where a batch can meet them.

Each batch writes its inserts as a segment, one file per bucket of a hash of the fingerprint. Once ``FAN`` segments are of one
tier they become one of the next, so there are at most ``FAN - 1`` per tier and a fingerprint is written again once per tier.
The state of a batch lists the live segments: how many fingerprints each bucket has, and a Bloom filter of them. A poll
tests its batch against the filters and reads only the files that may hold some of it; how many fingerprints
are known is a sum over the state.

A batch that is run again starts from the state of the batch before it and overwrites what it wrote; the state is
written last. What neither the last state nor the one before it lists is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators.dedupe import LEDGER_COLUMNS, capped, known
from newsdesk.session import delete_folder
from newsdesk.sources.tables import BatchTable

FAN, BUCKETS = 8, 16
BITS_PER_KEY, PROBES, MOST_BITS = 16, 6, 1 << 23
"""Bits of a filter for each key, and the most a filter has (1 MB); a fuller one passes more files, and loses none."""
KEYS_AT_ONCE = 1 << 18
ROW_SCHEMA = "fp STRING, poll_id BIGINT, feed_ord INT, entry_ord BIGINT"
STATE_SCHEMA = "segment STRING, oldest BIGINT, tier INT, bucket INT, rows BIGINT, bits BINARY"


@dataclass
class Segment:
    """Consecutive inserts; ``parts`` are the written segments it is to be made of."""

    oldest: int
    tier: int
    rows: int
    parts: list[str] = field(default_factory=list)
    skipped: int = 0

    def written(self) -> bool:
        return len(self.parts) == 1 and not self.skipped


def merged(segments: list[Segment], fan: int) -> list[Segment]:
    """Segments from old to new, with every ``fan`` of one tier as one of the next; decided before any is written."""
    out = sorted(segments, key=lambda s: s.oldest)
    while True:
        last = out[-fan:]
        if len(last) < fan or len({s.tier for s in last}) > 1:
            return out
        whole = Segment(last[0].oldest, last[0].tier + 1, sum(s.rows for s in last), [p for s in last for p in s.parts])
        out[-fan:] = [whole]


def evicted(segments: list[Segment], cap: int | None) -> list[Segment]:
    """Less the first inserts beyond ``cap``: old segments go as a whole, and one is cut."""
    out = sorted(segments, key=lambda s: s.oldest)
    over = sum(s.rows for s in out) - cap if cap is not None else 0
    while over > 0:
        if out[0].rows <= over:
            over -= out.pop(0).rows
        else:
            out[0].skipped, out[0].rows, over = over, out[0].rows - over, 0
    return out


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("fp"), F.lit(buckets)).cast("int")


def probes(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of each key in a filter of ``n_bits``, a power of two."""
    keys = keys.view(np.uint64)
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return (keys[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(n_bits - 1)


def filter_bits(rows: int) -> int:
    return int(min(max(1 << (BITS_PER_KEY * rows - 1).bit_length(), 64), MOST_BITS))


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter per bucket, from keys sorted by bucket; one filter is held at a time."""
    now, bits, rows = None, None, 0

    def made() -> pa.RecordBatch:
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "rows": pa.array([rows], pa.int64()), "bits": pa.array([packed], pa.binary())})

    for batch in batches:
        buckets, keys, total = (batch.column(c).to_numpy() for c in ("bucket", "key", "total"))
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1)) if len(buckets) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if buckets[a] != now:
                if now is not None:
                    yield made()
                now, rows, bits = int(buckets[a]), 0, np.zeros(filter_bits(int(total[a])), bool)
            bits[probes(keys[a:b], len(bits)).ravel()] = True
            rows += int(b - a)
    if now is not None:
        yield made()


def _met(keys: pa.Table, state: pa.Table) -> pa.Table:
    """Files of one bucket whose filter has some key of the batch."""
    found = []
    own = np.unique(keys["key"].to_numpy())
    for segment, bucket, packed in zip(state["segment"], state["bucket"], state["bits"], strict=True):
        bits = np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), bitorder="little").view(bool)
        if any(bits[probes(own[at : at + KEYS_AT_ONCE], len(bits))].all(1).any() for at in range(0, len(own), KEYS_AT_ONCE)):
            found.append((segment.as_py(), bucket.as_py()))
    return pa.table({"segment": pa.array([s for s, _ in found], pa.string()), "bucket": pa.array([b for _, b in found], pa.int32())})


class LedgerTable:
    """Seen fingerprints after each batch, at most ``cap`` of them, or all.

    A ledger that is missing counts as empty, and is seeded; one with a damaged file is an error,
    as reading on without a part of it would read and post that part's items again. ``buckets`` holds for
    good once a ledger is written; a bucket of a segment is one file and one task.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int | None = None, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.cap, self.buckets, self.fan = spark, path, cap, buckets, fan
        self.states = BatchTable(spark, f"{path}/states", STATE_SCHEMA)

    # What the batches before one have left

    def state(self, batch_id: int) -> DataFrame:
        """A row per live segment and bucket, as the batches before ``batch_id`` left them."""
        every = self.states.read().where(F.col("batch_id") < batch_id)
        last = every.agg(F.max("batch_id")).head()[0]
        return self.states.at(batch_id - 1 if last is None else last)

    def size(self, batch_id: int) -> int:
        """How many fingerprints the ledger holds before ``batch_id``."""
        return self.state(batch_id).agg(F.sum("rows")).head()[0] or 0

    def segments(self, batch_id: int) -> list[Segment]:
        """From old to new; at most ``fan - 1`` of each tier."""
        listed = self.state(batch_id).groupBy("segment", "oldest", "tier").agg(F.sum("rows").alias("rows")).collect()
        return sorted((Segment(r["oldest"], r["tier"], r["rows"], [r["segment"]]) for r in listed), key=lambda s: s.oldest)

    def _scan(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], ROW_SCHEMA)
        reader = self.spark.read.schema(f"{ROW_SCHEMA}, segment STRING, bucket INT").option("basePath", f"{self.path}/segments")
        return reader.parquet(*files).drop("segment", "bucket")

    def _folder(self, segment: str) -> str:
        return f"{self.path}/segments/segment={segment}"

    def before(self, batch_id: int) -> DataFrame:
        """The whole ledger as the batches before ``batch_id`` left it."""
        return self._scan([self._folder(p) for s in self.segments(batch_id) for p in s.parts])

    def files_met(self, batch: DataFrame, batch_id: int) -> list[str]:
        """The files that may hold fingerprints of a batch."""
        keys = batch.select(bucket_of(self.buckets).alias("of"), F.xxhash64("fp").alias("key"))
        state = self.state(batch_id).select("segment", "bucket", "bits")
        met = keys.groupBy("of").cogroup(state.groupBy("bucket")).applyInArrow(_met, "segment string, bucket int")
        # At most live segments x buckets, whatever the ledger and the batch hold.
        return sorted(f"{self._folder(r['segment'])}/bucket={r['bucket']}" for r in met.collect())

    def met(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The ledger rows of a batch's fingerprints, from the files that can hold them."""
        return known(self._scan(self.files_met(batch, batch_id)), batch)

    # Inserting

    def insert(self, sightings: DataFrame, batch_id: int) -> None:
        """Append ``sightings``, of which the ledger holds none, merge what has piled up, and evict."""
        before = self.state(batch_id)
        old = self.segments(batch_id)
        name = f"{batch_id}-0"
        self._write(sightings.select(*LEDGER_COLUMNS), name)
        fresh = self._state_of(name, batch_id, 0)
        fresh_rows = self._rows_of(name).count()
        live = [*old, Segment(batch_id, 0, fresh_rows, [name])] if fresh_rows else old
        live = evicted(merged(live, self.fan), self.cap)
        kept = {s.parts[0] for s in live if s.written()}
        state = before.where(F.col("segment").isin(*kept)).unionByName(fresh.where(F.col("segment").isin(*kept))) if kept else self.spark.createDataFrame([], STATE_SCHEMA)
        for at, segment in enumerate((s for s in live if not s.written()), 1):
            made = f"{batch_id}-{at}"
            rows = self._scan([self._folder(p) for p in segment.parts])
            if segment.skipped:
                rows = capped(rows, segment.rows)
            self._write(rows, made)
            state = state.unionByName(self._state_of(made, segment.oldest, segment.tier))
        self.states.write(state.repartition(1), batch_id)
        self._clean(batch_id)

    def _write(self, rows: DataFrame, segment: str) -> None:
        dealt = rows.withColumn("bucket", bucket_of(self.buckets)).repartition("bucket").sortWithinPartitions("bucket", "fp")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(segment))

    def _rows_of(self, segment: str) -> DataFrame:
        return self.states.scan(self._folder(segment), f"{ROW_SCHEMA}, bucket INT")

    def _state_of(self, segment: str, oldest: int, tier: int) -> DataFrame:
        """The state's rows of a written segment."""
        rows = self._rows_of(segment)
        totals = F.broadcast(rows.groupBy("bucket").agg(F.count("*").alias("total")))
        keys = rows.select("bucket", F.xxhash64("fp").alias("key")).join(totals, "bucket")
        sorted_keys = keys.select("bucket", "key", "total").repartition("bucket").sortWithinPartitions("bucket")
        filters = sorted_keys.mapInArrow(_filters, "bucket int, rows bigint, bits binary")
        return filters.select(F.lit(segment).alias("segment"), F.lit(oldest).cast("bigint").alias("oldest"), F.lit(tier).alias("tier"), "bucket", "rows", "bits")

    def _clean(self, batch_id: int) -> None:
        """Remove segments and states that a batch that is run again cannot need."""
        listed = self.states.read().groupBy("batch_id").agg(F.collect_set("segment").alias("segments")).collect()
        recent = {r["batch_id"]: set(r["segments"]) for r in listed}
        keep = sorted(b for b in recent if b <= batch_id)[-2:]
        for b in recent.keys() - set(keep):
            if b < batch_id:
                delete_folder(self.spark, f"{self.states.path}/batch_id={b}")
        wanted = set().union(*(recent[b] for b in keep)) if keep else set()
        gone = set().union(*(recent[b] for b in recent if b < batch_id)) | {f"{batch_id}-0"}
        for segment in gone - wanted:
            delete_folder(self.spark, self._folder(segment))
