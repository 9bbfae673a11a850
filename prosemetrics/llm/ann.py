"""Nearest neighbours by inner product through low-dimensional stable projections.

Inner products become distances: a vector x gets the coordinate sqrt(M^2 - |x|^2) (M the
largest norm), a query q is scaled to norm M and gets 0; then |x' - q'|^2 = 2M^2 - 2M<q,x>/|q|.
A Gaussian (2-stable) projection to ``DIMS`` dimensions turns a distance d into d times
the root of a chi-square variable with DIMS degrees of freedom. A kd-tree over the
projections hands out points in order of projected distance; they are verified on the
original vectors until the chi-square test holds: a point not yet seen, at projected
distance r or more, would be nearer than the k-th best found (at distance d) with a
probability of at most 1 - CONFIDENCE, that is P(chi2 < r^2 / d^2) >= CONFIDENCE.

The upper levels of the kd-tree are fitted on a bounded sample and cut the projected
space into cells; every vector is indexed, in blocks of bounded size. A query first
searches its home cell, which bounds d; then the cells that the test can't exclude.
Queries travel in chunks of neighbours (queries of one cell, or of cells beside each
other), and a cell's vectors are copied only to the chunks with a query that needs it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, QUERY_EVERY = 20, 20
DIMS, CONFIDENCE, SEED = 8, 0.9, 7
#: Bounds: vectors read to fit the cells, cells, vectors of a block, queries of a block, vectors of a leaf of a block's own tree.
SAMPLE, CELLS, BLOCK, QUERIES, LEAF = 20_000, 1_024, 8_192, 16_384, 128


def chi2_cdf(x, dims: int = DIMS):
    """Of an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, dims // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dims) < p else (low, mid)
    return high


def projection(width: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, dims))


def lifted_points(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0))[:, None]])


def lifted_queries(q: np.ndarray, most: float) -> np.ndarray:
    norms = np.sqrt((q * q).sum(1))
    return np.hstack([q * (most / norms)[:, None], np.zeros((len(q), 1))])


class Tree:
    """A kd-tree: boxes that tile the space, and the leaf of a point."""

    def __init__(self, points: np.ndarray, leaves: int):
        dims = points.shape[1]
        boxes, self.split = [], []

        def grow(at: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
            """The number of a node; leaves have negative ones."""
            spread = np.ptp(points[at], axis=0) if len(at) else np.zeros(dims)
            if n <= 1 or spread.max() == 0:
                boxes.append((low, high, at))
                return -len(boxes)
            axis = int(spread.argmax())
            values = points[at, axis]
            cut = float(np.median(values))
            left = values <= cut
            if left.all():
                cut = float(values[values < cut].max())
                left = values <= cut
            node = len(self.split)
            self.split.append(None)
            h, w = high.copy(), low.copy()
            h[axis], w[axis] = cut, cut
            self.split[node] = (axis, cut, grow(at[left], n - n // 2, low, h), grow(at[~left], n // 2, w, high))
            return node

        self.root = grow(np.arange(len(points)), leaves, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        self.rows = [b[2] for b in boxes]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), int)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            else:
                axis, cut, left, right = self.split[node]
                on = points[at, axis] <= cut
                todo += [(left, at[on]), (right, at[~on])]
        return out

    def squared(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of each box from the points q (a row a point)."""
        gap = np.maximum(np.maximum(self.low[None] - q[:, None], q[:, None] - self.high[None]), 0)
        return (gap * gap).sum(2)


def _dealt(ids: pd.Series, n: int) -> np.ndarray:
    """Numbers below n that depend on the ids alone."""
    return ((ids.to_numpy().astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(int) % n


def search(vectors: np.ndarray, ids: np.ndarray, projected: np.ndarray, queries: np.ndarray, at: np.ndarray, bounds: np.ndarray, k: int, most: float, radius: float):
    """ids and scores (a row a query, best first, ties to the smaller id, id -1: none) of the best k of ``vectors``, as far as the test wants them.

    at: the queries' projections; bounds: their k-th best squared distance so far. In each
    step every query that the test doesn't stop verifies its next leaf.
    """
    tree = Tree(projected, max(1, len(vectors) // LEAF))
    least = tree.squared(at)
    order = np.argsort(least, axis=1, kind="stable")
    norms = np.sqrt((queries * queries).sum(1))
    best, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
    bound, live = bounds.astype(float).copy(), np.arange(len(queries))
    for step in range(least.shape[1]):
        leaf = order[live, step]
        go = least[live, leaf] <= radius * bound[live]
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        for mine in np.split(live[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            rows = tree.rows[order[mine[0], step]]
            new = queries[mine] @ vectors[rows].T
            better = (new >= scores[mine, -1:]).any(1)
            mine, new = mine[better], new[better]
            both = np.hstack([scores[mine], new])
            names = np.hstack([best[mine], np.broadcast_to(ids[rows], new.shape)])
            top = np.lexsort((names, -both))[:, :k]
            scores[mine], best[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            worst = scores[mine, -1]
            seen = np.isfinite(worst)
            reached = np.maximum(2 * most**2 - 2 * most * worst[seen] / norms[mine[seen]], 0) * (1 + 1e-9)
            bound[mine[seen]] = np.minimum(bound[mine[seen]], reached)
    return best, scores


def distinct_vectors(table: DataFrame, k: int = K) -> DataFrame:
    """rid, vec, ids: each distinct usable vector with its smallest ids, as many as a result can hold, and ``rid`` the smallest.

    Unusable: null, without components, all zero, or with a null or non-finite component.
    """
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)  # limited before the shuffle too
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rid"), "vec", "ids")


def nearest(table: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``.

    Nearest by inner product in double precision, ties to the smaller id, never the
    query's own row. A vector is searched once however many rows hold it. Vectors of
    another width than most take no part, nor do null ids. Fewer than k candidates: all
    of them. Empty table: no rows.
    """
    spark = table.sparkSession
    reps = written(distinct_vectors(table, k))
    widths = reps.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    out = "qid long, rid long, score double"
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = widths[0]["width"], widths[0]["count"]
    reps = reps.filter(F.size("vec") == width)
    most = math.sqrt(reps.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]) * (1 + 1e-12)
    a = projection(width)
    share = min(1.0, SAMPLE / n)
    sample = reps.filter(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vec").limit(SAMPLE).toPandas()
    cells = max(1, min(CELLS, n // BLOCK))
    tree = Tree(lifted_points(np.stack(sample["vec"]), most) @ a, cells)
    blocks = max(1, math.ceil(n / (len(tree.rows) * BLOCK)))
    radius = chi2_quantile(CONFIDENCE)

    def placed(batches):
        for b in batches:
            x = np.stack(b["vec"])
            yield pd.DataFrame({"cell": tree.leaf(lifted_points(x, most) @ a), "block": _dealt(b["rid"], blocks), "rid": b["rid"], "vec": list(x)})

    points = written(reps.select("rid", "vec").mapInPandas(placed, "cell int, block int, rid long, vec array<double>"))
    asked = table.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec")).filter(F.col("query_id") % every == 0)
    queries = written(asked.join(reps.select("rid", "vec"), "vec").select("query_id", "rid"))
    distinct = written(queries.select("rid").distinct().join(reps.select("rid", "vec"), "rid").select(F.col("rid").alias("qid"), "vec"))

    def at_home(batches):
        for b in batches:
            yield pd.DataFrame({"cell": tree.leaf(lifted_queries(np.stack(b["vec"]), most) @ a)})

    homes = {r["cell"]: r["count"] for r in distinct.mapInPandas(at_home, "cell int").groupBy("cell").count().collect()}  # at most ``CELLS`` rows
    sizes = np.array([homes.get(i, 0) for i in range(len(tree.rows))])
    before = np.cumsum(sizes) - sizes

    def visits(home: bool):
        def run(batches):
            for b in batches:
                q = np.stack(b["vec"])
                at = lifted_queries(q, most) @ a
                inside = tree.leaf(at)
                if home:
                    row, cell = np.arange(len(q)), inside
                else:
                    near = tree.squared(at) <= radius * b["bound"].to_numpy()[:, None]
                    near[np.arange(len(q)), inside] = False
                    row, cell = np.nonzero(near)
                if not len(row):
                    continue
                chunk = (before[inside] + _dealt(b["qid"], 1 << 30) % np.maximum(sizes[inside], 1)) // QUERIES
                yield pd.DataFrame({"cell": cell, "chunk": chunk[row], "qid": b["qid"].to_numpy()[row], "bound": b["bound"].to_numpy()[row], "vec": [q[j] for j in row]})

        return run

    def look(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"qid": [], "rid": [], "score": []})
        x, y = np.stack(p["vec"]), np.stack(q["vec"])
        ids, scores = search(x, p["rid"].to_numpy(), lifted_points(x, most) @ a, y, lifted_queries(y, most) @ a, q["bound"].to_numpy(), k + 1, most, radius)
        row, nth = np.nonzero(np.isfinite(scores))
        return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "rid": ids[row, nth], "score": scores[row, nth]})

    def searched(asking: DataFrame, home: bool) -> DataFrame:
        to = written(asking.mapInPandas(visits(home), "cell int, chunk int, qid long, bound double, vec array<double>"))
        wanted = to.select("cell", F.col("chunk").alias("of")).distinct()  # at most ``CELLS`` rows a chunk
        spread = points.join(wanted, "cell").withColumnRenamed("of", "chunk")
        to = to.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ("cell", "block", "chunk")
        return spread.groupBy(*key).cogroup(to.groupBy(*key)).applyInPandas(look, out)

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "rid")
    top = lambda df: df.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    first = written(top(searched(distinct.withColumn("bound", F.lit(float("inf"))), True)).drop("nth"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    worst = first.groupBy("qid").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    bound = F.when(F.col("n") > k, F.greatest(F.lit(2 * most**2) - F.lit(2 * most) * F.col("worst") / norm, F.lit(0.0)) * (1 + 1e-9)).otherwise(F.lit(float("inf")))
    second = searched(distinct.join(worst, "qid", "left").withColumn("bound", bound).select("qid", "vec", "bound"), False)
    merged = top(first.unionByName(second)).select("qid", "rid", "score")
    expanded = merged.join(reps.select("rid", "ids"), "rid").select("qid", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    lists = expanded.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    own = queries.join(lists, queries["rid"] == lists["qid"]).withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("found").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
