"""Operator 10: nearest neighbours by inner product with vantage-point trees.

Inner products become distances of one metric space: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
Rows are dealt to shards of bounded size by a hash, each shard builds one tree,
and blocks of queries meet every shard. A subtree is skipped where the triangle
inequality's lower bound, times ``factor``, exceeds the k-th distance so far;
factor 1 is exact, ties included, a larger one prunes more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 20
QUERY_STEP = 20
#: Rows of a shard and of a query block at most (on average: both are dealt by a hash).
SHARD_ROWS = 65_536
BLOCK_ROWS = 16_384
#: Small tables get up to so many shards of at least so many rows, for parallel work.
SPREAD, SPREAD_ROWS = 16, 1024
LEAF = 128
FACTOR = 1.5
#: Fixed value: relative error that fast products and distances stay below.
SLACK = 1e-13


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, each summed in the same order wherever it stands."""
    return np.einsum("ij,ij->i", a, b)


class Tree:
    """A vantage-point tree over distinct vectors; equal vectors share an entry.

    An entry keeps the ``k + 1`` smallest ids of its vector: no answer of k
    neighbours without the query itself can need another.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, k: int = K) -> None:
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))) if len(ids) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        within = np.arange(len(ids)) - np.flatnonzero(new)[group]
        keep = within <= k
        self.ids, self.entry = ids[keep], group[keep]
        self.vectors, self.norm2 = vectors[new], norm2
        self.lift = np.sqrt(np.maximum(norm2 - (self.vectors**2).sum(1), 0))
        self.points: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(self.vectors))) if len(self.vectors) else None

    def _grow(self, at: np.ndarray):
        if len(at) <= LEAF:
            self.points.append(at)
            return len(self.points) - 1
        centre = at[np.argmax(self._distance(at[0], at))]
        d = self._distance(centre, at)
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        inner, outer = order[:half], order[half:]
        bounds = (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]])
        return centre, bounds, self._grow(at[inner]), self._grow(at[outer])

    def _distance(self, a: int, others: np.ndarray) -> np.ndarray:
        gap = self.vectors[others] - self.vectors[a]
        return np.sqrt((gap**2).sum(1) + (self.lift[others] - self.lift[a]) ** 2)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, score) of each query's k nearest entries, itself left out.

        Fast products choose what is scored exactly; of that the ``k + 1`` best
        entries by (score, smallest id) stay. No answer needs another: each of them
        gives an id that precedes all ids of the entries left out.
        """
        n, keep = len(queries), k + 1
        score = np.full((n, keep), -np.inf)
        entry = np.full((n, keep), -1)
        base = (queries**2).sum(1) + self.norm2
        near = SLACK * base
        lowest = self.ids[np.searchsorted(self.entry, np.arange(len(self.vectors)))] if len(self.vectors) else self.ids

        def leaf(q: np.ndarray, at: np.ndarray) -> None:
            fast = queries[q] @ self.vectors[at].T
            least = score[q, -1]
            if len(at) > keep:
                least = np.maximum(least, np.partition(fast, len(at) - keep, axis=1)[:, len(at) - keep])
            place, column = np.nonzero(fast >= (least - near[q])[:, None])
            touched = np.unique(place)
            held = q[touched]
            fresh = exact(queries[q[place]], self.vectors[at[column]])
            row = np.concatenate((np.repeat(np.arange(len(held)), keep), np.searchsorted(touched, place)))
            all_score = np.concatenate((score[held].ravel(), fresh))
            all_entry = np.concatenate((entry[held].ravel(), at[column]))
            order = np.lexsort((lowest[all_entry], -all_score, row))
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < keep]
            score[held] = all_score[order].reshape(-1, keep)
            entry[held] = all_entry[order].reshape(-1, keep)

        def visit(node, q: np.ndarray) -> None:
            if isinstance(node, int):
                leaf(q, self.points[node])
                return
            centre, (a, b, c, d), inner, outer = node
            far = np.sqrt(np.maximum(base[q] - 2 * (queries[q] @ self.vectors[centre]), 0))
            near_first = far <= (b + c) / 2
            for ahead, children in ((True, ((inner, a, b), (outer, c, d))), (False, ((outer, c, d), (inner, a, b)))):
                mine, gap = q[near_first == ahead], far[near_first == ahead]
                for child, low, high in children if len(mine) else ():
                    kth = score[mine, k]  # one place more than k: the query itself may be among them
                    reach = np.sqrt(np.maximum(base[mine] - 2 * np.where(np.isinf(kth), 0, kth), 0) + near[mine])
                    bound = np.maximum(gap - high, low - gap) - np.sqrt(near[mine])
                    asked = mine[np.isinf(kth) | (bound * factor <= reach)]
                    if len(asked):
                        visit(child, asked)

        if self.root is not None:
            visit(self.root, np.arange(n))
        place, column = np.nonzero(entry >= 0)
        entry, score = entry[place, column], score[place, column]
        first = np.searchsorted(self.entry, np.arange(len(self.vectors) + 1))
        size = np.diff(first)[entry]
        rows = np.repeat(first[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        place, score, ids = np.repeat(place, size), np.repeat(score, size), self.ids[rows]
        other = ids != own[place]
        place, score, ids = place[other], score[other], ids[other]
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        return place[rank < k], ids[rank < k], score[rank < k]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def _plant(k: int):
    def run(rows: pa.Table) -> pa.Table:
        dim, shard, norm2 = rows["dim"][0].as_py(), rows["shard"][0].as_py(), rows["norm2"][0].as_py()
        tree = Tree(np.asarray(rows["vec_id"]), _matrix(rows["v"], dim), norm2, k)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _ask(k: int, factor: float):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        if not trees.num_rows or not asked.num_rows:
            return schema.empty_table()
        own = np.asarray(asked["vec_id"])
        tree = pickle.loads(trees["tree"][0].as_py())
        place, ids, score = tree.search(own, _matrix(asked["v"], asked["dim"][0].as_py()), k, factor)
        return pa.table([pa.array(own[place]), pa.array(ids), pa.array(score)], schema=schema)

    return run


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product.

    Queries are the rows whose vec_id is divisible by ``query_step``; every other
    vector of the same dimension is a candidate. Score is the inner product in
    double precision; ties go to the smaller vec_id. A null, empty or zero vector,
    one with a null, NaN or infinite component, and a row without vec_id take no
    part; of rows that share a vec_id the one with the smallest vector counts; other
    columns are ignored; an empty table gives no rows. Fewer candidates than ``k``
    are all returned.

    A tree is sent once for every ``block_rows`` queries and a query once for every
    shard, so both are large: what is shuffled is the table and its queries some
    times over, and a task holds one tree and one block.
    """
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & sound).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    is_query = F.pmod("vec_id", F.lit(query_step)) == 0
    power = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked"), F.max(power).alias("norm2"))
    shards = F.greatest(F.ceil(F.col("n") / shard_rows), F.least(F.ceil(F.col("n") / min(SPREAD_ROWS, shard_rows)), F.lit(SPREAD)))
    facts = facts.select("dim", "norm2", shards.alias("shards"), F.greatest(F.ceil(F.col("asked") / block_rows), F.lit(1)).alias("blocks"))
    rows = rows.join(F.broadcast(facts), "dim")  # a row for each dimension that occurs
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    trees = dealt.select("dim", "shard", "norm2", "vec_id", "v").groupBy("dim", "shard").applyInArrow(_plant(k), "dim int, shard long, tree binary")
    trees = trees.join(F.broadcast(facts.select("dim", "blocks")), "dim").select("dim", "shard", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")))
    asked = asked.select("dim", "block", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    keys = ["dim", "shard", "block"]
    near = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_ask(k, factor), "query_id long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
