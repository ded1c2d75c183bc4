"""Ranked lexical search: items go through owners of terms one after the other and carry their sums of documents along.

An index is written first: consecutive rows make shards of bounded size, and a posting list per shard and term holds the
shard's documents with their counts. Only terms that some item may have are listed (a bit map of fixed size over term
hashes, which lets more pass as items grow and loses none); document lengths are taken over all terms.

Terms are owned by how common they are, in ``OWNERS`` groups from rare to common. A bundle holds a block of items for one
shard, each item with its weighted terms and a sparse accumulator of documents and scores. Stage by stage, bundles are
cogrouped with the posting lists of the next owner, add their integer contributions, and go on to the owner after it.
Between stages a bundle drops documents that cannot come among the item's best any more: ``most`` documents of the same shard
have at least as much already as these would with all of the item's terms to come at their largest count, so the result
is that of the full sums. At the end each shard's best documents of an item meet in one ranking.

A very common term is a list per shard, so no task takes all of it; items are blocks of ``BLOCK_ITEMS``, each of which
meets every shard.

Results for odd input: a null or empty text holds no terms and is not among the counted documents; a document with a
null ``doc_id`` counts in all statistics and is not ranked; rows that share a ``doc_id`` are documents of their own;
each row of the items is an item of its own, one without known terms has no rows; empty tables give no rows; further columns
are not read. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import documents, ship_package, table, written

MOST = 20
MAP_BITS = 1 << 23
"""Bits of the map of item terms (1 MB)."""
SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
BLOCK_ITEMS = 1024
OWNERS = (64, 16, 4)
"""A term that at most one in so many documents holds belongs to the first, second, third owner; others to the last."""

# Fixed values of the score: weights in thousandths, counts and lengths scaled as 64-bit whole numbers.
SCALE, COUNT_UNIT, LENGTH_UNIT, FLAT, SLOPE = 1_000_000_000, 1000, 12, 75, 25

APART = np.ones(256, bool)
for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
    APART[ord(low) : ord(high) + 1] = False
APART[0x80:] = False


def term_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text: how many with repeats, and (row, hash, count) of the distinct ones, by row."""
    words = arrays.Words(*arrays.byte_view(text), True, APART)
    order = np.lexsort((hashes := words.hashes(), words.row))
    row, hashes = words.row[order], hashes[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))) if len(row) else np.zeros(0, np.int64)
    return np.diff(words.bounds), row[first], hashes[first], np.diff(np.append(first, len(row)))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(MAP_BITS)).astype(np.int64)


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of ``values`` as binaries."""
    data = np.ascontiguousarray(values)
    offsets = pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, row, hashes, counts = term_counts(batch.column("text"))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(at), batch.column("item_id").take(at), pa.array(hashes.view(np.int64)), pa.array(counts)],
            names=["item", "item_id", "term", "times"],
        )


LISTS = "shard long, term long, docs binary, counts binary, rows long, most long, words long"


def _lists(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """Posting lists of each shard, and one row without a term that has its documents' ids and lengths.

    Of a list, ``rows`` counts its documents and ``most`` is its largest count. Of a shard, ``rows`` counts the documents
    with terms and ``words`` all their terms; the length of a document without an id is -1 less its terms.
    """
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    names = [x.split()[0] for x in LISTS.split(", ")]
    wanted = np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").view(bool)
    held: list[tuple] = []
    rows = size = 0

    def made() -> Iterator[pa.RecordBatch]:
        ids, named, lengths, doc, term, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(term, kind="stable")
        doc, term, count = doc[order], term[order], count[order]
        bounds = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, np.int64)
        n, first = len(bounds) - 1, bounds[:-1]
        most = np.maximum.reduceat(count, first) if n else count
        counts = blobs(count.astype("<i8"), bounds)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, shard), term[first].view(np.int64))] + [blobs(doc.astype("<i4"), bounds), counts] + [pa.array(x) for x in (np.diff(bounds), most, np.zeros(n, np.int64))], names=names)
        whole, totals = np.array([0, len(ids)]), [(lengths > 0).sum(), 0, lengths.sum()]
        of_docs = [blobs(ids.astype("<i8"), whole), blobs(np.where(named, lengths, -1 - lengths).astype("<i8"), whole)]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.int64()), *of_docs, *(pa.array([int(x)]) for x in totals)], names=names)

    for batch in batches:
        for part in arrays.slices(batch, "text"):
            lengths, row, hashes, counts = term_counts(part.column("text"))
            listed, ids = wanted[_bit(hashes)], part.column("doc_id")
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), lengths, row[listed] + rows, hashes[listed], counts[listed]))
            rows += part.num_rows
            size += part.column("text").nbytes
            if rows >= SHARD_ROWS or size >= SHARD_BYTES:
                yield from made()
                held, rows, size, shard = [], 0, 0, shard + 1
    if rows:
        yield from made()


ENTRY = ("item", "owner", "term", "gain", "ceiling")
BUNDLE = "shard long, block long, ids binary, lengths binary, " + ", ".join(f"{x} binary" for x in ENTRY) + ", bounds binary, docs binary, scores binary"


def _block(key: tuple, entries: pa.Table) -> pa.Table:
    """One row of a block's items with their terms, by item, then owner, and no documents yet."""
    order = np.lexsort((entries["owner"].to_numpy(), entries["item"].to_numpy()))
    packed = [pa.array([entries[x].to_numpy().astype("<i8")[order].tobytes()]) for x in ENTRY]
    n_items = len(np.unique(entries["item"].to_numpy()))
    return pa.Table.from_arrays([pa.array([key[0].as_py()]), *packed, pa.array([np.zeros(n_items + 1, "<i8").tobytes()]), pa.array([b""]), pa.array([b""])], names=["block", *ENTRY, "bounds", "docs", "scores"])


def _stage(key: tuple, bundle: pa.Table, lists: pa.Table, owner: int, n_docs: int, n_words: int, most: int) -> pa.Table:
    """One bundle at one owner: its scores with this owner's lists, or at the last owner each item's best documents."""
    last, names = owner == len(OWNERS), [x.split()[0] for x in BUNDLE.split(", ")]
    if not bundle.num_rows:
        kinds = {"item": pa.int64(), "doc_id": pa.int64(), "score": pa.int64()} if last else {x: pa.int64() if x in ("shard", "block") else pa.binary() for x in names}
        return pa.Table.from_pydict({x: pa.array([], kind) for x, kind in kinds.items()})
    given = {x: np.frombuffer(bundle[x][0].as_buffer(), "<i4" if x == "docs" else "<i8") for x in names[2:]}
    lengths = given["lengths"]
    named = lengths >= 0
    norms = FLAT + (SLOPE * np.where(named, lengths, -1 - lengths) * n_docs) // max(n_words, 1)
    places = {t: i for i, t in enumerate(lists["term"].to_pylist())}
    docs, counts = lists["docs"].combine_chunks(), lists["counts"].combine_chunks()
    gains: dict[int, tuple] = {}

    def of(term: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents of a term and what one of weight one would add to each."""
        if term not in gains and (at := places.get(term)) is not None:
            doc, count = np.frombuffer(docs[at].as_buffer(), "<i4"), np.frombuffer(counts[at].as_buffer(), "<i8")
            gains[term] = doc, (SCALE * count) // (COUNT_UNIT * count + LENGTH_UNIT * norms[doc])
        return gains.get(term)

    starts = np.flatnonzero(np.append(True, np.diff(given["item"]) != 0))
    stops, bounds = np.append(starts[1:], len(given["item"])), given["bounds"]
    dense, out = np.zeros(len(lengths), np.int64), []
    for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        before = given["docs"][bounds[k] : bounds[k + 1]]
        dense[before] = given["scores"][bounds[k] : bounds[k + 1]]
        of_owner = given["owner"][a:b]
        lo, hi = a + np.searchsorted(of_owner, [owner, owner + 1])
        for term, gain in zip(given["term"][lo:hi].tolist(), given["gain"][lo:hi].tolist(), strict=True):
            if (found := of(term)) is not None:
                dense[found[0]] += gain * found[1]
        at = np.flatnonzero(dense)
        scores = dense[at]
        dense[at] = 0
        at, scores = at[named[at]], scores[named[at]]
        if len(at) > most:
            keep = scores + given["ceiling"][hi:b].sum() >= np.partition(scores, len(scores) - most)[len(scores) - most]
            at, scores = at[keep], scores[keep]
        if last:
            best = np.lexsort((given["ids"][at], -scores))[:most]
            at, scores = at[best], scores[best]
        out.append((at, scores))
    sizes = np.array([len(x) for x, _ in out])
    at, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    if last:
        return pa.table({"item": np.repeat(given["item"][starts], sizes), "doc_id": given["ids"][at], "score": scores})
    for name, values in (("bounds", np.append(0, np.cumsum(sizes)).astype("<i8")), ("docs", at.astype("<i4")), ("scores", scores.astype("<i8"))):
        bundle = bundle.set_column(names.index(name), name, pa.array([values.tobytes()]))
    return bundle


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of each item with a score above zero.

    A term's weight is 1000 times the logarithm of (2 N + 2) / (2 df + 1), rounded down; the score is the sum over the
    item's terms, repeats included, of weight x (SCALE x count div (COUNT_UNIT x count + LENGTH_UNIT x norm)), with the
    norm FLAT + (SLOPE x length x N div all lengths). Equal scores are ranked by ``doc_id``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = written(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "search-items")
    n_blocks = -(-items.count() // BLOCK_ITEMS) or 1
    kinds = "item long, item_id long, term long, times long"
    terms = written(items.select("item", "item_id", "text").mapInArrow(_items, kinds), "search-terms")
    bits = terms.selectExpr(f"pmod(term, {MAP_BITS}) as bit").groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("bits"))
    map_of_terms = np.zeros(MAP_BITS // 64, "<i8")
    for r in bits.collect():  # at most MAP_BITS / 64 rows
        map_of_terms[r["at"]] = r["bits"]
    index = written(docs.select("doc_id", "text").mapInArrow(partial(_lists, wanted=spark.sparkContext.broadcast(map_of_terms.tobytes())), LISTS), "search-index")
    shards, lists = index.where("term is null"), index.where("term is not null")
    n_docs, n_words = (x or 0 for x in shards.agg(F.sum("rows"), F.sum("words")).first())

    known = lists.groupBy("term").agg(F.sum("rows").alias("df"), F.max("most").alias("most"))
    owner = F.expr("case " + " ".join(f"when df * {x} <= {n_docs} then {i}L" for i, x in enumerate(OWNERS)) + f" else {len(OWNERS)}L end")
    known = known.withColumn("owner", owner).join(terms.select("term").distinct(), "term")
    known = written(known.selectExpr(
        "term", "owner", f"bigint(floor(1000 * ln((2 * {n_docs}L + 2) / (2 * df + 1)))) as weight",
        f"({SCALE}L * most) div ({COUNT_UNIT} * most + {LENGTH_UNIT * FLAT}) as top",
    ), "search-weights")
    entries = terms.join(known, "term").selectExpr(f"pmod(xxhash64(item), {n_blocks}L) as block", "item", "owner", "term", "weight * times as gain", "weight * times * top as ceiling")
    of_blocks = ", ".join(x for x in BUNDLE.split(", ") if not x.startswith(("shard", "ids", "lengths")))
    blocks = entries.groupBy("block").applyInArrow(_block, of_blocks)
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    bundles = shards.select("shard", every_block.alias("block"), F.col("docs").alias("ids"), F.col("counts").alias("lengths")).join(blocks, "block")
    bundles = bundles.select([x.split()[0] for x in BUNDLE.split(", ")])
    lists = lists.join(known.select("term", "owner"), "term")
    for stage in range(len(OWNERS) + 1):
        owned = lists.where(F.col("owner") == stage).select(F.col("shard").alias("to_shard"), every_block.alias("to_block"), "term", "docs", "counts")
        step = partial(_stage, owner=stage, n_docs=n_docs, n_words=n_words, most=most)
        made = BUNDLE if stage < len(OWNERS) else "item long, doc_id long, score long"
        bundles = bundles.groupBy("shard", "block").cogroup(owned.groupBy("to_shard", "to_block")).applyInArrow(step, made)
    ranked = bundles.where("score > 0").selectExpr("*", "row_number() over (partition by item order by score desc, doc_id) as rank").where(F.col("rank") <= most)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with said as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select item_id, term, count(*) as times from said group by all),
held as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counts as (select doc_id, term, count(*) as tf from held group by all),
lengths as (select doc_id, cast(sum(tf) as bigint) as n from counts group by doc_id),
totals as (select count(*) as n_docs, cast(sum(n) as bigint) as n_words from lengths),
weights as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
    from counts, totals where term in (select term from asked) group by term),
scored as (select a.item_id, c.doc_id,
    cast(sum(a.times * g.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (100 - 25 + (25 * l.n * t.n_docs) // t.n_words)))) as bigint) as score
    from asked a join counts c using (term) join weights g using (term) join lengths l using (doc_id), totals t group by a.item_id, c.doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
    from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
