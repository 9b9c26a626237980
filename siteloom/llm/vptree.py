"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

For the largest inner product, candidates get one more coordinate, sqrt(M - |x|^2),
where M is the largest |x|^2, and queries get 0 there: the nearest by Euclidean
distance are then those with the largest product, and the triangle inequality holds.

All trees have two roots. Vectors are dealt by their distance to a first vantage point into
rings of about equally many, and a ring by the distance to a second one, the vector
farthest from the first, into cells; only what exceeds RINGS cells of a ring is dealt by
hash. A query goes to its home cell first, the nearest one of its nearest ring. What it finds
there bounds how far the rest may lie, and it goes on only to rings, and of these to cells,
within that bound; this is decided on numbers, before a vector moves. In a cell, the
same is done at each node. Left out is what the triangle inequality, relaxed by the factor,
puts beyond the k-th best so far: with h the least height of the points, which every
distance has in it, h^2 + factor^2 * (bound^2 - h^2) > distance^2. (Heights are near M where few
vectors are much longer than the rest; relaxing them too would leave out everything.)
At factor 1 nothing nearer is ever left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_row_key

SHARD, BLOCK, LEAF, RINGS = 4096, 8192, 256, 256
#: Candidates that a search returns besides the k best, for ties that rounding may hide.
SPARE = 12
#: See the README for the recall at this factor.
FACTOR = 3.0


def relaxed(bound, lowest, factor: float, larger=np.maximum):
    """The square of the relaxed bound, for points whose squared heights are `lowest` at least."""
    return lowest + factor**2 * larger(bound * bound - lowest, 0.0 * bound)


class Tree:
    """Points in tree order; a node is (start, end, vantage, ranges, inner, outer), a range the
    least and largest distance to the vantage point, and the least squared height."""

    def __init__(self, x: np.ndarray, largest: float):
        self.norm = np.einsum("ij,ij->i", x, x)
        self.x, self.largest = x, largest
        self.order = np.arange(len(x))
        self.root = self._build(0, len(x))

    def _between(self, i: int, j: np.ndarray) -> np.ndarray:
        """Distances in the raised space."""
        lift = np.sqrt(np.maximum(self.largest - self.norm, 0))
        square = self.norm[i] + self.norm[j] - 2 * (self.x[j] @ self.x[i]) + (lift[i] - lift[j]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def _build(self, lo: int, hi: int):
        if hi - lo <= LEAF:
            return lo, hi, None
        part = self.order[lo:hi]
        far = int(np.argmax(self._between(part[0], part)))  # a point at the rim tells most apart
        part[0], part[far] = part[far], part[0]
        d = self._between(part[0], part[1:])
        rank = np.argsort(d, kind="stable")
        part[1:], d = part[1:][rank], d[rank]
        mid = len(d) // 2
        height = self.largest - self.norm[part[1:]]
        ranges = ((d[0], d[mid - 1], max(0.0, height[:mid].min())), (d[mid], d[-1], max(0.0, height[mid:].min())))
        return lo, hi, int(part[0]), ranges, self._build(lo + 1, lo + 1 + mid), self._build(lo + 1 + mid, hi)


class Search:
    """The best of one tree for a block of queries; `floor`: what the k-th best is known to reach."""

    def __init__(self, tree: Tree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, factor: float):
        self.t, self.ids, self.q, self.own, self.k, self.factor = tree, ids, q, own, k, factor
        self.square = np.einsum("ij,ij->i", q, q) + tree.largest
        # Products are compared to so many decimals, that equal vectors tie.
        self.decimals = 13 - int(np.ceil(np.log10(max(1.0, float(self.square.max())))))
        self.floor = floor - 10.0 ** (1 - self.decimals)
        self.best = np.full((len(q), k + SPARE), -np.inf)
        self.best_id = np.full((len(q), k + SPARE), np.iinfo(np.int64).max)
        self._visit(tree.root, np.arange(len(q)))

    def _offer(self, at: np.ndarray, points: np.ndarray) -> np.ndarray:
        s = np.round(self.q[at] @ self.t.x[points].T, self.decimals)
        ids = np.broadcast_to(self.ids[points], s.shape)
        offered = np.where((ids == self.own[at, None]) | (s < self.floor[at, None]), -np.inf, s)
        # Few queries gain from a leaf; only theirs are sorted.
        gain = (offered >= np.maximum(self.best[at, -1:], np.finfo(float).min)).any(1)
        if gain.any():
            w = at[gain]
            s2 = np.concatenate((self.best[w], offered[gain]), 1)
            i2 = np.where(np.isneginf(s2), np.iinfo(np.int64).max, np.concatenate((self.best_id[w], ids[gain]), 1))
            top = np.lexsort((i2, -s2), axis=1)[:, : self.best.shape[1]]
            self.best[w], self.best_id[w] = np.take_along_axis(s2, top, 1), np.take_along_axis(i2, top, 1)
        return s

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if node[2] is None:
            self._offer(at, self.t.order[node[0] : node[1]])
            return
        _, _, vantage, ranges, inner, outer = node
        s = self._offer(at, np.array([vantage]))[:, 0]
        d = np.sqrt(np.maximum(self.square[at] - 2 * s, 0))
        near_inner = d < (ranges[0][1] + ranges[1][0]) / 2
        for first, second, chosen in ((0, 1, near_inner), (1, 0, ~near_inner)):
            for side in (first, second):
                lo, hi, lowest = ranges[side]
                bound = np.maximum(np.maximum(d - hi, lo - d), 0)
                kth = np.maximum(self.best[at, self.k - 1], self.floor[at])
                reach = np.sqrt(np.maximum(self.square[at] - 2 * kth, 0))
                self._visit((inner, outer)[side], at[chosen & (relaxed(bound, lowest, self.factor) <= (reach + 1e-6) ** 2)])


def usable(rows: DataFrame) -> DataFrame:
    """row_key, vec_id, v of rows with an id and a vector that is not null, empty or zero and
    has finite components only."""
    rows, key = with_row_key(rows)
    rows = rows.select(F.col(key).alias("row_key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _seen_from(points: DataFrame, vantage: DataFrame, away: str, seen: str) -> DataFrame:
    """`points` with the distances to the vantage point of their dim (far_v, far_square): of
    the point itself (raised), and of the query that it may be."""
    given = points.join(vantage, "dim").withColumn("product", _dot("v", "far_v"))
    lift = lambda c: F.sqrt(F.greatest(F.col("largest") - F.col(c), F.lit(0.0)))
    square = F.col("square") + F.col("far_square") - 2 * F.col("product") + F.pow(lift("square") - lift("far_square"), 2)
    # The query lies at height 0, the vantage point at its own.
    asked = F.col("square") + F.col("largest") - 2 * F.col("product")
    measured = given.withColumn(away, F.sqrt(F.greatest(square, F.lit(0.0)))).withColumn(seen, F.sqrt(F.greatest(asked, F.lit(0.0))))
    return measured.drop("product", "far_v", "far_square")


def _dealt(points: DataFrame, keys: list[str], away: str, parts: int, name: str) -> DataFrame:
    """`points` with `name`: which of `parts` about equal ranges of `away` a point lies in, by `keys`."""
    if parts == 1:
        return points.withColumn(name, F.lit(0))
    cuts = points.groupBy(*keys).agg(F.percentile_approx(away, [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
    return points.join(materialize(cuts, "cuts"), keys).withColumn(name, F.size(F.filter("cuts", lambda c: c < F.col(away)))).drop("cuts")


def _bound(seen: str, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - F.col(seen), F.col(seen) - hi, F.lit(0.0))


def nearest(rows: DataFrame, k: int = 20, divisor: int = 20, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK, rings: int = RINGS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for
    each row whose vec_id is divisible by `divisor`, ties to the smaller vec_id.

    Candidates are all rows but the query's own: rows that repeat a vec_id, or all of a row,
    are candidates and queries of their own. Vectors null, zero or with a null or non-finite
    component take no part. Vectors are compared with those of equal length only. Queries with
    no candidate are not returned. Other columns are ignored; an empty table gives an empty result.
    """
    good = materialize(usable(rows).withColumn("dim", F.size("v")).withColumn("square", _dot("v", "v")), "vectors")
    # One row for each length of vector that occurs. The first vantage point is a longest vector.
    of = good.groupBy("dim").agg((F.max("square") * (1 + 1e-12)).alias("largest"), F.max(F.struct("square", "row_key", "v")).alias("far"), F.count("*").alias("n"))
    of = materialize(of.select("dim", "largest", "n", F.col("far.square").alias("far_square"), F.col("far.v").alias("far_v")), "vantage")
    count = of.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    points = _seen_from(good, of.drop("n"), "away", "seen")
    parts = max(1, min(rings, -(-count // shard)))
    cells = max(1, min(rings, -(-count // (parts * shard))))
    if cells > 1:
        points = materialize(points, "points")
        second = points.groupBy("dim").agg(F.max(F.struct("away", "row_key", "square", "v")).alias("far"))
        second = materialize(second.select("dim", F.col("far.square").alias("far_square"), F.col("far.v").alias("far_v")), "vantage")
        points = _seen_from(points, second, "away2", "seen2")
    else:
        points = points.withColumn("away2", F.lit(0.0)).withColumn("seen2", F.lit(0.0))
    points = materialize(points.withColumn("sum", F.col("square") + F.col("largest")).withColumn("height", F.col("largest") - F.col("square")).drop("square"), "points")
    points = _dealt(_dealt(points, ["dim"], "away", parts, "ring"), ["dim", "ring"], "away2", cells, "cell")
    bounds = points.groupBy("dim", "ring", "cell").agg(
        F.min("away").alias("lo"), F.max("away").alias("hi"), F.min("away2").alias("lo2"), F.max("away2").alias("hi2"),
        F.greatest(F.min("height"), F.lit(0.0)).alias("lowest"), F.ceil(F.count("*") / shard).cast("int").alias("shards"),
    )
    bounds = materialize(bounds, "cells")
    every = bounds.groupBy("dim", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lowest").alias("lowest"))
    every = materialize(every.groupBy("dim").agg(F.collect_list(F.struct("ring", "lo", "hi", "lowest")).alias("rings")), "rings")  # at most `rings` entries
    queries = points.where(F.pmod("vec_id", F.lit(divisor)) == 0).select("dim", F.col("row_key").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "seen", "seen2", "sum")
    home = F.array_min(F.transform("rings", lambda r: F.struct(_bound("seen", r["lo"], r["hi"]).alias("bound"), r["ring"].alias("ring"))))["ring"]
    of_ring = bounds.select("dim", "ring", "cell", "lo2", "hi2", "lowest")
    at_home = queries.join(every, "dim").withColumn("ring", home).select("dim", "ring", "query", "seen2").join(of_ring, ["dim", "ring"])
    at_home = at_home.groupBy("query").agg(F.min(F.struct(_bound("seen2", F.col("lo2"), F.col("hi2")).alias("bound"), "ring", "cell")).alias("h"))
    queries = materialize(queries.join(at_home.select("query", F.col("h.ring").alias("home"), F.col("h.cell").alias("home_cell")), "query"), "queries")

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"query": none, "query_id": none, "vec_id": none, "row_key": none, "score": np.zeros(0)})
        p, q = p.sort_values(["vec_id", "row_key"]), q.sort_values("query")
        x, at = np.stack(p.v.to_list()).astype(np.float64), np.stack(q.q.to_list()).astype(np.float64)
        ids, keys = np.arange(len(p)), p.row_key.to_numpy()  # a point's place: ties go by vec_id
        by_key = np.argsort(keys)
        place = by_key[np.minimum(np.searchsorted(keys[by_key], q["query"].to_numpy()), len(keys) - 1)]
        own = np.where(keys[place] == q["query"].to_numpy(), place, -1)
        found = Search(Tree(x, float(p.largest.iloc[0])), ids, at, own, q.floor.to_numpy(), k, factor)
        row, col = np.nonzero(~np.isneginf(found.best))
        hit = found.best_id[row, col]
        exact = np.cumsum(at[row] * x[hit], axis=1)[:, -1]  # summed from left to right
        return pd.DataFrame({"query": q["query"].to_numpy()[row], "query_id": q.query_id.to_numpy()[row], "vec_id": p.vec_id.to_numpy()[hit], "row_key": keys[hit], "score": exact})

    def visit(asked: DataFrame) -> DataFrame:
        """The best of each cell for the queries (dim, ring, cell, query, query_id, q, floor) that ask
        it: shards of points meet blocks of queries, whatever one cell holds of either."""
        load = materialize(
            asked.groupBy("dim", "ring", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(
                bounds.select("dim", "ring", "cell", "shards"), ["dim", "ring", "cell"]
            ),
            "load",
        )
        part = lambda c, n, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        p = points.join(load, ["dim", "ring", "cell"]).select(
            "dim", "ring", "cell", "vec_id", "row_key", "v", "largest", part("row_key", "shards", 1).alias("shard"), each("blocks").alias("block"),
        )
        q = asked.join(load, ["dim", "ring", "cell"]).select(
            F.col("dim").alias("q_dim"), F.col("ring").alias("q_ring"), F.col("cell").alias("q_cell"), "query", "query_id", "q", "floor",
            each("shards").alias("q_shard"), part("query", "blocks", 2).alias("q_block"),
        )
        met = p.groupBy("dim", "ring", "cell", "shard", "block").cogroup(q.groupBy("q_dim", "q_ring", "q_cell", "q_shard", "q_block"))
        return met.applyInPandas(search, "query long, query_id long, vec_id long, row_key long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row_key")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = queries.select("dim", F.col("home").alias("ring"), F.col("home_cell").alias("cell"), "query", "query_id", "q", F.lit(float("-inf")).alias("floor"))
    first = materialize(top(visit(asked)), "found")
    known = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    rest = queries.join(known, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    reach = F.when(F.col("floor") == float("-inf"), F.lit(float("inf"))).otherwise(F.sqrt(F.greatest(F.col("sum") - 2 * F.col("floor"), F.lit(0.0))) + 1e-6)
    within = lambda bound, lowest: relaxed(bound, lowest, factor, F.greatest) <= F.col("reach") * F.col("reach")
    near = F.filter("rings", lambda r: within(_bound("seen", r["lo"], r["hi"]), r["lowest"]))
    rest = materialize(rest.withColumn("reach", reach), "rest")
    # Which cells a query asks is found without its vector.
    asks = rest.select("dim", "query", "home", "home_cell", "seen", "seen2", "reach").join(every, "dim")
    asks = asks.select("dim", "query", "home", "home_cell", "seen2", "reach", F.explode(near).alias("r")).withColumn("ring", F.col("r.ring")).drop("r")
    asks = asks.join(of_ring, ["dim", "ring"]).where(within(_bound("seen2", F.col("lo2"), F.col("hi2")), F.col("lowest")))
    asks = asks.where("ring <> home or cell <> home_cell").select("query", "ring", "cell")
    more = visit(materialize(rest.select("dim", "query", "query_id", "q", "floor").join(asks, "query"), "asked"))
    return top(first.drop("rank").union(more)).select("query_id", "rank", "vec_id", "score")
