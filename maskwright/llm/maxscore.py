"""Exact top-k inner products with MaxScore pruning, in blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import cut_lineage

BLOCK = 8_192
QUERY_BLOCK = 2_048
STEP = 8
SEED = 256


class Shard:
    """A block of vectors; component ``t`` is a term, ``terms[t]`` its postings."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids = rows, ids
        self.terms = np.ascontiguousarray(values.T)
        self.low = values.min(axis=0) if len(values) else None
        self.high = values.max(axis=0) if len(values) else None

    def _kth(self, query: np.ndarray, some: np.ndarray, k: int, floor):
        """``floor``, raised to the ``k``-th best whole score of ``some`` vectors."""
        if len(some) < k:
            return floor
        known = np.partition(query @ self.terms[:, some], len(some) - k)[len(some) - k]
        return known if floor is None else max(floor, known)

    def top(self, row: int, query: np.ndarray, k: int, floor=None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the other vectors that are among the ``k`` best here.

        ``floor`` is a score that ``k`` vectors are known to reach; lower ones may be
        left out.  A term gives a vector between ``least[t]`` and ``most[t]``.  Terms
        are taken by falling spread.  The last ones are non-essential: a vector with
        no more than the least from all others cannot reach the floor by them.  The
        postings of the essential terms are traversed for all vectors, then the floor
        is raised by the whole scores of the best so far, and the other terms are
        probed for vectors that can still reach it, a few terms at a time.
        """
        ends = query * self.low, query * self.high
        least, most = np.minimum(*ends), np.maximum(*ends)
        order = np.argsort(least - most, kind="stable")
        ahead = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
        own = self.rows == row
        alive = np.flatnonzero(~own)
        first = order[:STEP]
        score = query[first] @ self.terms[first]
        done = len(first)
        if len(alive) >= k:
            floor = self._kth(query, self._best(score, alive, SEED), k, floor)
        if floor is not None:
            below = np.concatenate([[0], np.cumsum(least[order])])
            essential = int(np.argmax(below + ahead < floor)) if (below + ahead < floor).any() else len(order)
        else:
            essential = len(order)
        if essential > done:
            more = order[done:essential]
            score = score + query[more] @ self.terms[more]
            done = essential
            if floor is not None and done < len(order):
                floor = self._kth(query, self._best(score, alive, max(k, SEED // 4)), k, floor)
        score = score[alive] if len(alive) < len(score) else score
        while True:
            if floor is not None:
                keep = score + ahead[done] >= floor
                if done == len(order) or keep.sum() < 0.7 * len(alive):
                    alive, score = alive[keep], score[keep]
            if done == len(order):
                break
            more = order[done:done + STEP]
            postings = self.terms[more] if len(alive) == len(own) else self.terms[more[:, None], alive]
            score = score + query[more] @ postings
            done += len(more)
        if len(score) > k:
            last = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= last
            alive, score = alive[keep], score[keep]
            best = np.lexsort((self.ids[alive], -score))[:k]
            alive, score = alive[best], score[best]
        return alive, score

    @staticmethod
    def _best(score: np.ndarray, alive: np.ndarray, n: int) -> np.ndarray:
        if len(alive) <= n:
            return alive
        return alive[np.argpartition(score[alive], len(alive) - n)[len(alive) - n:]]


def _matrix(ids: pa.Array, values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = values.flatten().flatten().to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(zero_copy_only=False), flat.reshape(-1, dim) if dim else np.zeros((len(ids.flatten()), 0), np.int64)


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024,
                    key: str = "vec_id", vector: str = "embedding", block: int = BLOCK,
                    query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows.

    The library's own records hold no vectors, so this is general: ``vectors`` has
    an id and an array of numbers.  A component ``x`` counts as ``floor(scale * x)``;
    scores are integers (exact while they fit 63 bits).  Queries are the rows where
    ``is_query`` holds, candidates every row but the query's own.

    Returns ``query_id, rank, vec_id, score``: rank from 1, ties to the smaller id,
    fewer than ``k`` rows if there are fewer candidates.  Vectors that are null or
    hold null or non-finite components take no part; only vectors of one length are
    compared.  Repeated rows are rows of their own, also as queries; rows with a
    null id can be found, with rank after equal scores, and are queries only if
    ``is_query`` says so.  Other columns are ignored; an empty table gives no rows.

    Rows are dealt into blocks by number.  Every block of queries meets every block
    of candidates once, as one row of packed arrays, so a task's memory is one pair
    of blocks.  The first block of candidates comes first: the ``k``-th score that a
    query finds there is its floor in all others.  Each pair keeps at most ``k`` rows
    per query, merged by rank at the end.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(
        F.col(key).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), x.alias("x")
    ).where(F.col("x").isNotNull() & sound).select(
        "id", "asks", F.transform("x", lambda v: F.floor(scale * v).cast("long")).alias("v"),
        F.size("x").alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(rows, "vectors")
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"))
    most, asked = counts.agg(F.max("n"), F.max("q")).first()
    shards, parts = max(1, -(-(most or 0) // block)), max(1, -(-(asked or 0) // query_block))

    def packed(some: DataFrame, pieces: int, name: str, *more: str) -> DataFrame:
        dealt = some.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int"))
        return dealt.groupBy("dim", name).agg(F.collect_list(F.struct("row", "id", "v", *more)).alias(f"{name}s"))

    candidates = packed(rows, shards, "shard")
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"query_row long, query_id {kind}, `{key}` {kind}, score long"

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                dim = batch.column(0)[0].as_py()
                rows_q, q = _matrix(batch.column(1), batch.column(3), dim)
                floors = batch.column(4).flatten().to_pylist()
                rows_c, c = _matrix(batch.column(5), batch.column(7), dim)
                ids_q, ids_c = batch.column(2).flatten(), batch.column(6).flatten()
                order = ids_c.to_numpy(zero_copy_only=False) if not ids_c.null_count else \
                    np.array([(v is None, v if v is not None else 0) for v in ids_c.to_pylist()],
                             [("null", "?"), ("id", object if ids_c.type == pa.string() else "i8")])
                if order.dtype.names:
                    order = np.unique(order, return_inverse=True)[1]
                size = int(max(np.abs(q).max(initial=0), 1)) * int(max(np.abs(c).max(initial=0), 1)) * max(dim, 1)
                if size < 2**53:  # doubles are exact and faster
                    q, c = q.astype(float), c.astype(float)
                shard = Shard(rows_c, order, c)
                for j in range(len(q)):
                    places, score = shard.top(int(rows_q[j]), q[j], k, floors[j])
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, rows_q[j])), ids_q.take(pa.array(np.full(n, j))),
                         ids_c.take(pa.array(places)), pa.array(score.astype(np.int64))],
                        names=["query_row", "query_id", key, "score"])

    def met(asks: DataFrame, first: int, last: int) -> DataFrame:
        """What the queries find in the blocks ``first`` to ``last``."""
        asks = packed(asks, parts, "part", "floor").withColumn(
            "shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
        pairs = asks.join(candidates, ["dim", "shard"]).select(
            "dim", *[F.col(f"parts.{f}").alias(f"parts_{f}") for f in ("row", "id", "v", "floor")],
            *[F.col(f"shards.{f}").alias(f"shards_{f}") for f in ("row", "id", "v")])
        return pairs.mapInArrow(run, schema)

    asks = rows.where("asks")
    best = met(asks.withColumn("floor", F.lit(None).cast("long")), 0, 0)
    if shards > 1:
        best = cut_lineage(best, "first-block")
        floors = best.groupBy(F.col("query_row").alias("row")).agg(
            F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        best = best.unionByName(met(asks.join(floors, "row", "left"), 1, shards - 1))
    in_order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last(key))
    best = best.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", key, "score")
