"""First-wins de-duplication and the ledger of already seen fingerprints.

A ledger row is ``fp`` plus the position of its first insert, ``poll_id, feed_ord,
entry_ord``, which grows with time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsdesk.functions.text import fingerprint, is_blank
from newsdesk.operators.rank import ranked

ITEM_POSITION = ("feed_ord", "entry_ord")
SEEN_POSITION = ("poll_id", *ITEM_POSITION)
LEDGER_COLUMNS = ("fp", *SEEN_POSITION)

# Total orders: items of one feed that landed in several payloads share a position.
BATCH_ORDER = (*ITEM_POSITION, "fp")
INSERT_ORDER = (*SEEN_POSITION, "fp")


def with_fingerprint(items: DataFrame) -> DataFrame:
    """Add ``fp``, never null: a join on a nullable key would compute it again to test it."""
    return items.withColumn("fp", F.coalesce(fingerprint(F.col("title")), F.lit("")))


def not_blank(items: DataFrame) -> DataFrame:
    return items.where(~is_blank(F.col("title")))


def first_wins(rows: DataFrame, key: str, position: tuple[str, ...]) -> DataFrame:
    """One whole row per key, the one with the smallest position.

    ``min`` of a struct is combined before the shuffle, so however many copies a key
    has, each map task sends one row of it.
    """
    rest = [c for c in rows.columns if c != key and c not in position]
    winner = rows.groupBy(key).agg(F.min(F.struct(*position, *rest)).alias("_first"))
    return winner.select(key, "_first.*").select(*rows.columns)


def gathered(items: DataFrame) -> DataFrame:
    """One batch of items: blanks removed, first title of each fingerprint kept."""
    return first_wins(with_fingerprint(not_blank(items)), "fp", ITEM_POSITION)


def unseen(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items of a batch that the ledger does not hold."""
    return batch.join(ledger.select("fp"), "fp", "left_anti").select(*batch.columns)


def suppressed(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items of a batch that the ledger already holds."""
    return batch.join(ledger.select("fp"), "fp", "left_semi").select(*batch.columns)


def known(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The part of a long ledger that a batch can meet, found without moving the rest."""
    return ledger.join(batch.select("fp"), "fp", "left_semi").select(*ledger.columns)


def seeded(batch: DataFrame, poll_id: int = 0) -> DataFrame:
    """Ledger of a first run: every gathered fingerprint, read or not."""
    return batch.select("fp", F.lit(poll_id).cast("bigint").alias("poll_id"), *ITEM_POSITION)


def upserted(ledger: DataFrame, sightings: DataFrame) -> DataFrame:
    """Set union that keeps each fingerprint's first position."""
    both = ledger.select(*LEDGER_COLUMNS).unionByName(sightings.select(*LEDGER_COLUMNS))
    return first_wins(both, "fp", SEEN_POSITION)


def _edge(ledger: DataFrame, position: str, wanted: int) -> tuple[object, int] | None:
    """Where the newest ``wanted`` rows end: a value of ``position``, and how many rows of it are among them."""
    # At most so many values count, as each has a row.
    newest = ledger.groupBy(position).count().orderBy(F.desc(position)).limit(wanted)
    later = F.sum("count").over(W.orderBy(F.desc(position))) - F.col("count")
    row = newest.withColumn("later", later).where(F.col("later") < wanted).orderBy(position).head()
    return None if row is None else (row[position], wanted - row["later"])


def capped(ledger: DataFrame, cap: int | None) -> DataFrame:
    """The ``cap`` fingerprints inserted last, or all; re-sightings do not refresh their age.

    Polls, and feeds within a poll, stay or go as a whole by their sizes; only rows of the one feed of one poll in
    which the cap falls are ranked. The ledger is read several times: hand in one that is written down.
    """
    if cap is None:
        return ledger
    kept, within, rest, wanted = F.lit(False), F.lit(True), ledger, cap
    for position in SEEN_POSITION[:-1]:
        edge = _edge(rest, position, wanted) if wanted > 0 else None
        if edge is None:
            return ledger.where(kept)
        at, wanted = edge
        kept = kept | (within & (F.col(position).isNotNull() if at is None else F.col(position) > F.lit(at)))
        within = within & F.col(position).eqNullSafe(F.lit(at))
        rest = ledger.where(within)
    newest = [F.desc(c) for c in INSERT_ORDER]
    part = ranked(rest, newest, name="_age").where(F.col("_age") <= wanted).drop("_age")
    return ledger.where(kept).unionByName(part)


def first_sightings(history: DataFrame, seed_poll: int = 0) -> DataFrame:
    """Items of a poll history read once: first sighting of a fingerprint after the seed."""
    firsts = first_wins(with_fingerprint(not_blank(history)), "fp", SEEN_POSITION)
    return firsts.where(F.col("poll_id") > seed_poll)
