"""Exact top-k inner products: ball-tree branch and bound in each shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows by a hash of their id. A task
builds a ball tree over its shard and streams the queries past it. No vector in a ball can
beat ``centre . q + radius * |q|``: nodes below the query's current k-th score go, the
leaves left are visited from the highest bound on, and a query stops at the first leaf
that cannot reach its k-th score. The k-th score is shared: each query first searches one
shard, and carries the score found there to all the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventledger.llm.common import written

SHARD_ROWS = 8192
LEAF_ROWS = 128
LOW = -(1 << 63)
_FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for vectors that cannot take part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fit, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class BallTree:
    """Nodes in breadth-first order; children of node i are ``first[i]`` and the next."""

    def __init__(self, vectors, ids):
        import numpy as np

        parts, self.first, self.rows = [np.arange(len(ids))], [], []
        centres, radii = [], []
        at = 0
        while at < len(parts):
            rows = parts[at]
            points = vectors[rows].astype(np.float64)
            centre = points.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
            if len(rows) > LEAF_ROWS and radii[-1] > 0:
                far = points[((points - points[0]) ** 2).sum(axis=1).argmax()]
                other = points[((points - far) ** 2).sum(axis=1).argmax()]
                order = np.argsort(points @ (other - far), kind="stable")
                half = len(rows) // 2
                self.first.append(len(parts))
                self.rows.append(None)
                parts += [rows[order[:half]], rows[order[half:]]]
            else:
                self.first.append(-1)
                self.rows.append(rows)
            at += 1
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.vectors, self.ids = vectors, ids

    def search(self, queries, query_ids, floor_scores, k: int):
        """(scores, ids) of each query's k best rows at or above its floor, padded with LOW."""
        import numpy as np

        n = len(queries)
        wide = queries.astype(np.float64)
        norms = np.sqrt((wide**2).sum(axis=1))
        kth = floor_scores.copy()
        best = np.full((n, k), LOW, np.int64)
        best_ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)

        def bounds(q, node):
            top = np.einsum("ij,ij->i", self.centres[node], wide[q]) + self.radii[node] * norms[q]
            return top + 1e-9 * np.abs(top) + 1e-6  # rounding must not hide a row

        q, node = np.arange(n), np.zeros(n, np.int64)
        first = np.array(self.first)
        leaves = []
        while len(q):
            top = bounds(q, node)
            live = top >= kth[q]
            q, node, top = q[live], node[live], top[live]
            leaf = first[node] < 0
            leaves.append((q[leaf], node[leaf], top[leaf]))
            q, node = np.repeat(q[~leaf], 2), first[node[~leaf]].repeat(2)
            node[1::2] += 1
        q, node, top = (np.concatenate(x) for x in zip(*leaves))
        order = np.lexsort((-top, q))
        q, node, top = q[order], node[order], top[order]
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(q)]
        while len(begins):
            going = top[begins] >= kth[q[begins]]
            begins, ends = begins[going], ends[going]
            for leaf in np.unique(node[begins]):
                own = q[begins[node[begins] == leaf]]
                self._visit(self.rows[leaf], own, queries, query_ids, kth, best, best_ids, k)
            begins = begins + 1
            more = begins < ends
            begins, ends = begins[more], ends[more]
        return best, best_ids

    def _visit(self, rows, own, queries, query_ids, kth, best, best_ids, k):
        import numpy as np

        scores = products(queries[own], self.vectors[rows])
        ids = self.ids[rows]
        scores[query_ids[own][:, None] == ids[None, :]] = LOW
        useful = (scores >= kth[own][:, None]).any(axis=1)
        own, scores = own[useful], scores[useful]
        if not len(own):
            return
        scores[scores < kth[own][:, None]] = LOW
        scores = np.hstack((best[own], scores))
        ids = np.hstack((best_ids[own], np.broadcast_to(ids, (len(own), len(ids)))))
        order = np.argsort(ids, axis=1, kind="stable")
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        order = np.argsort(~scores, axis=1, kind="stable")[:, :k]
        best[own] = np.take_along_axis(scores, order, 1)
        best_ids[own] = np.take_along_axis(ids, order, 1)
        kth[own] = np.maximum(kth[own], best[own, k - 1])


def products(left, right):
    """Exact integer inner products; what 64 bits cannot hold stays at their ends."""
    import numpy as np

    reach = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0))
    if reach * left.shape[1] < 2.0**52:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, LOW + 1, (1 << 63) - 1).astype(np.int64)


def _search(batches, k: int):
    """Rows sorted by (size, shard, kind, id): a shard's vectors come before its queries."""
    import numpy as np
    import pyarrow as pa

    shard, held, tree = None, [], None
    for batch in batches:
        size, part, kind, ids, floors = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        flat = batch.column(5).flatten().to_numpy(zero_copy_only=False)
        begin = np.r_[0, np.cumsum(size)]
        cuts = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]) if len(size) else []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(size)]):
            now = (int(size[lo]), int(part[lo]))
            vectors = flat[begin[lo] : begin[hi]].reshape(hi - lo, size[lo])
            if now != shard:
                shard, held, tree = now, [], None
            if kind[lo] == 0:
                held.append((vectors.copy(), ids[lo:hi].copy()))
                continue
            if not held:
                continue
            if tree is None:
                tree = BallTree(*(np.concatenate(x) for x in zip(*held)))
            for a in range(lo, hi, 2048):
                b = min(a + 2048, hi)
                scores, found = tree.search(vectors[a - lo : b - lo], ids[a:b], floors[a:b], k)
                real = scores > LOW
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(ids[a:b, None], scores.shape)[real]), pa.array(found[real]), pa.array(scores[real])],
                    ["query_id", "vec_id", "score"],
                )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products, ties to smaller ids.

    Both tables hold (vec_id long, v array<long>). A row with the query's own id is no
    candidate. Null ids and null vectors take no part; vectors of different length do not
    meet. Repeated candidates each take a rank; a query id that repeats is asked once, with
    its smallest vector. A query without candidates gives no row.
    """
    vectors = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    queries = queries.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    shards = -(-(vectors.count() if rows is None else rows) // SHARD_ROWS) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    held = vectors.select(
        F.size("v").alias("n"), home.alias("shard"), F.lit(0).alias("kind"), "vec_id", F.lit(LOW + 1).cast("long").alias("least"), "v"
    )

    def asked(questions: DataFrame) -> DataFrame:
        together = held.union(questions.select(F.size("v").alias("n"), "shard", F.lit(1).alias("kind"), "vec_id", "least", "v"))
        placed = together.repartition(parts, "n", "shard").sortWithinPartitions("n", "shard", "kind", "vec_id")
        return placed.mapInArrow(lambda batches: _search(batches, k), _FOUND)

    at_home = written(asked(queries.select("vec_id", "v", home.alias("shard"), F.lit(LOW + 1).cast("long").alias("least"))), "topk-home")
    found = at_home
    if shards > 1:
        scores = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        known = queries.join(scores, F.col("vec_id") == F.col("query_id"), "left").select(
            "vec_id", "v", home.alias("home"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(LOW + 1).cast("long")).alias("least")
        )
        away = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).where("shard <> home")
        found = at_home.union(asked(away))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
