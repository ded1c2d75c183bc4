"""Exact top-k inner products by dual traversal of cover trees over queries and candidates.

Vectors are cut into blocks. Every block of queries meets every block of candidates in some task, which indexes both
as cover trees and opens pairs of nodes from the top: with centres c and covering radii r no product of a pair exceeds
``cq.cp + rq |cp| + rp |cq| + rq rp``, and a pair is dropped where that is below the worst kth score of the
query node's members. The best of each block pair are merged by query.

Results for odd input: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
with a null ``vec_id``; of rows that share a ``vec_id`` the one of least components counts; only vectors of equal
length are compared; equal scores go by smaller ``vec_id``; an empty table gives no rows; further columns are
not read. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.llm import arrays
from newsdesk.llm.storage import table, written

K, EVERY, SCALE = 5, 50, 256
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
LEAF, FAN = 32, 16


class CoverTree:
    """Nodes by number: centre, covering radius, children, members of leaves, and members in all.

    A node's children are centred on members taken farthest first, until every member is within half the node's
    radius of one, or there are ``FAN`` of them; each member goes to its nearest centre.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        everything = np.arange(len(x))
        centre = x.mean(0)
        self._add(centre, everything, np.sqrt(((x - centre) ** 2).sum(1)))
        at = 0
        while at < len(self.centres):
            self._open(at)
            at += 1
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def _add(self, centre: np.ndarray, members: np.ndarray, distance: np.ndarray) -> int:
        self.centres.append(centre)
        # A little wider than computed, for rounding.
        self.radii.append(float(distance.max()) * (1 + 1e-9) + 1e-6)
        self.children.append(np.zeros(0, np.int64))
        self.members.append(members)
        return len(self.centres) - 1

    def _open(self, node: int) -> None:
        members = self.members[node]
        if len(members) <= LEAF:
            return
        y = self.x[members]
        nearest = np.full(len(members), np.inf)
        owner = np.zeros(len(members), np.int64)
        centres = []
        following = int(((y - self.centres[node]) ** 2).sum(1).argmin())
        while len(centres) < FAN:
            distance = ((y - y[following]) ** 2).sum(1)
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], len(centres)
            centres.append(following)
            following = int(nearest.argmax())
            if nearest[following] <= (self.radii[node] / 2) ** 2 and len(centres) > 1 or nearest[following] == 0:
                break
        if len(centres) == 1:  # all members are equal: cut them anyhow
            owner = np.arange(len(members)) * FAN // len(members)
            centres = [int(np.flatnonzero(owner == i)[0]) for i in range(FAN)]
            nearest = np.zeros(len(members))
        groups = [np.flatnonzero(owner == i) for i in range(len(centres))]
        self.children[node] = np.array([self._add(y[c], members[g], np.sqrt(nearest[g])) for c, g in zip(centres, groups, strict=True) if len(g)])


class Best:
    """The ``k`` best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.scores[rows, -1][:, None]).any(1)
        if not some.any():
            return
        rows, scores = rows[some], scores[some]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def dual_search(queries: CoverTree, query_ids: np.ndarray, candidates: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Raise ``best`` by all candidates but those with the query's own id."""
    stack = [(0, 0, np.inf)]
    while stack:
        q, c, bound = stack.pop()
        rows = queries.members[q]
        if bound < best.scores[rows, -1].min():
            continue
        open_q, open_c = queries.children[q], candidates.children[c]
        if not len(open_q) and not len(open_c):
            members = candidates.members[c]
            scores = np.rint(queries.x[rows] @ candidates.x[members].T)
            scores[query_ids[rows][:, None] == ids[members][None]] = -np.inf
            best.offer(rows, scores, ids[members])
            continue
        a = open_q if len(open_q) else np.array([q])
        b = open_c if len(open_c) else np.array([c])
        most = queries.centre[a] @ candidates.centre[b].T + np.outer(queries.radius[a], candidates.norm[b])
        most += np.outer(queries.norm[a] + queries.radius[a], candidates.radius[b])
        most += np.abs(most) * 1e-9 + 1e-3
        pairs = sorted((float(most[i, j]), int(a[i]), int(b[j])) for i in range(len(a)) for j in range(len(b)))
        stack += [(x, y, m) for m, x, y in pairs]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: ids and whole-number vectors as bytes."""
    for group in arrays.groups(batches, "block"):
        vectors = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.floor(vectors * SCALE)
        ids = group.column("vec_id").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([group.column("block").chunk(0)[:1], group.column("dim").chunk(0)[:1], pa.array([ids.tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])


def _product(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sums of products stay exact in double precision."""
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2**52


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by candidate block, the candidates first: their tree serves all query blocks that follow."""
    block, tree, ids = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            own = np.frombuffer(row["ids"], np.int64)
            if not row["is_query"]:
                block, tree, ids = row["block"], CoverTree(x), own
                continue
            if block != row["block"]:
                continue
            best = Best(len(x), k)
            if _product(x, tree.x):
                dual_search(CoverTree(x), own, tree, ids, best)
            else:
                for i in range(len(x)):
                    exact = [sum(int(a) * int(b) for a, b in zip(x[i], y, strict=True)) for y in tree.x]
                    ranked = sorted((-s, int(v)) for s, v in zip(exact, ids, strict=True) if v != own[i])[:k]
                    yield _out([own[i]] * len(ranked), [v for _, v in ranked], [-s for s, _ in ranked])
                continue
            found = np.isfinite(best.scores)
            yield _out(np.repeat(own, found.sum(1)), best.ids[found], best.scores[found].astype(np.int64))


def _out(query: object, vec: object, score: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query, vec, score)], names=["query_id", "vec_id", "score"])


def best_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of each row whose ``vec_id`` is divisible by ``every``."""
    clean = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf'))"
    clean = vectors.where(clean).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    clean = written(clean.withColumn("dim", F.size("embedding")), "products-vectors")
    rows = clean.count()
    blocks = rows // CANDIDATE_BLOCK + 1

    def packed(part: DataFrame, number: int) -> DataFrame:
        part = part.withColumn("block", F.xxhash64("dim") + F.pmod(F.xxhash64("vec_id"), F.lit(number)))
        part = part.repartition("block").sortWithinPartitions("block", "vec_id")
        return part.select("block", "dim", "vec_id", "embedding").mapInArrow(_packed, "block long, dim int, ids binary, vectors binary")

    queries = packed(clean.where(F.col("vec_id") % every == 0), rows // every // QUERY_BLOCK + 1)
    queries = queries.select(F.explode(F.expr(f"transform(sequence(0L, {blocks - 1}L), i -> xxhash64(dim) + i)")).alias("block"), "dim", "ids", "vectors", F.lit(True).alias("is_query"))
    candidates = packed(clean, blocks).withColumn("is_query", F.lit(False))
    met = queries.unionByName(candidates).repartition("block").sortWithinPartitions("block", "is_query")
    found = met.mapInArrow(partial(_met, k=k), "query_id long, vec_id long, score long")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % {EVERY} = 0
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= {K}
"""


def op9_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_products(table(spark, sf_dir, "embeddings"))
