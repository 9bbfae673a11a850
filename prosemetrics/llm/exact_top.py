"""Exact top-k search by three phases of a uniform threshold.

The components of a vector are cut into ``LISTS`` ranges; an inner product is the sum of a
score from each of these lists. First every task looks up the k best entries of each list
of its blocks and adds up their scores; the kth best of all tasks' sums is a safe cutoff t,
since k rows reach it. Then t is sent to all tasks, which collect what any list shows at t /
``LISTS`` or more: a row that no list shows sums to less than t. A row seen in some lists
may gain less than t / ``LISTS`` from each of the others; if it can't reach t so, it goes.
At last the scores that are still unknown are looked up for the rest, the sums are exact,
and the k best rows that reach t are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_blocks import AT_ONCE, FOUND, FOUND_ARROW, Best, Blocks, Shape, asked_column, first_of, sent, usable

SCALE, EVERY, K, LISTS = 256, 50, 5, 4
_NONE = np.iinfo(np.int64).min
_SUMS, _SUMS_ARROW = "question long, sums array<long>", pa.schema([("question", pa.int64()), ("sums", pa.list_(pa.int64()))])


class _Asked:
    def __init__(self, asked: pa.StructArray, shape: Shape):
        self.question, self.ids, self.cutoff = (asked_column(asked, c) for c in ("question", "query_id", "cutoff"))
        raw = b"".join(asked_column(asked, "packed"))
        self.vectors = shape.numbers(raw)
        edges = np.linspace(0, shape.width, min(LISTS, shape.width) + 1).astype(int)
        self.lists = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def scored(self, vectors: np.ndarray):
        """(which queries, their scores of every row in each list), some queries at a time."""
        for at in range(0, len(self.ids), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            yield some, [(self.vectors[some, of] @ vectors[:, of].T).astype(np.int64) for of in self.lists]


def _local_lists(blocks: Blocks, met: DataFrame, k: int) -> DataFrame:
    """First phase: for each task and query the k best sums of rows that lead a list."""

    shape = blocks.shape

    def state(asked):
        found = _Asked(asked, shape)
        return found, np.full((len(found.ids), k), _NONE)

    def add(state, ids, labels, vectors):
        asked, best = state
        for some, lists in asked.scored(vectors):
            own = asked.ids[some, None] == ids
            for scores in lists:
                scores[own] = _NONE // LISTS
            lead = np.hstack([np.argpartition(s, -min(k, len(ids)), axis=1)[:, -k:] for s in lists])
            lead.sort(axis=1)
            sums = np.take_along_axis(sum(lists), lead, 1)
            sums[:, 1:][lead[:, 1:] == lead[:, :-1]] = _NONE  # a row that leads several lists counts once
            sums[np.take_along_axis(own, lead, 1)] = _NONE
            both = np.hstack([best[some], sums])
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]

    def send(state):
        asked, best = state
        return {"question": asked.question, "sums": list(best)}

    return blocks.run(met, state, add, send, _SUMS, _SUMS_ARROW)


def _resolved(blocks: Blocks, met: DataFrame, k: int) -> DataFrame:
    """Second and third phase: rows that a list shows at the cutoff's share and that can reach it, with exact sums."""

    shape = blocks.shape

    def state(asked):
        return _Asked(asked, shape), Best(k)

    def add(state, ids, labels, vectors):
        asked, best = state
        for some, lists in asked.scored(vectors):
            cutoff, m = asked.cutoff[some, None], len(lists)
            least = -(-cutoff // m)  # whole scores reach cutoff / m exactly if they reach this
            known, seen = np.zeros_like(lists[0]), np.zeros(lists[0].shape, np.int8)
            for scores in lists:
                shown = scores >= least
                known += np.where(shown, scores, 0)
                seen += shown
            row, col = np.nonzero((seen > 0) & (known + (m - seen) * least >= cutoff) & (asked.ids[some, None] != ids))
            total = known[row, col]
            for scores in lists:  # what is still unknown of these
                s = scores[row, col]
                total += np.where(s >= least[row, 0], 0, s)
            fine = total >= cutoff[row, 0]
            best.add(asked.question[some][row[fine]], total[fine], ids[col[fine]])

    return blocks.run(met, state, add, lambda s: sent(s[1]), FOUND, FOUND_ARROW)


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose vec_id is divisible by ``every``.

    Inner products of whole numbers, floor(scale * x) of each component; ties go to the
    smaller vec_id. Candidates are all rows but those with the query's own id.

    Nulls, non-finite components and odd widths: :func:`vector_blocks.usable`. Queries that
    are equal in id and vector are one; candidates that repeat an id each count. Other
    columns don't matter. Fewer than k candidates: all of them. Empty table: no rows.
    """
    blocks = Blocks(usable(table, scale))
    asking = blocks.vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), blocks.packed().alias("packed"))
    queries = written(asking.distinct().withColumn("question", F.monotonically_increasing_id()))
    n = queries.count()
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = blocks.dealt(queries, n, F.col("question"))
    open_ = F.lit(-2 * blocks.bound)  # below every score: nothing is cut off
    lists = _local_lists(blocks, blocks.meet(queries.withColumn("cutoff", open_), n), k)
    best = Window.partitionBy("question").orderBy(F.desc("sum"))
    sums = lists.select("question", F.explode("sums").alias("sum")).filter(F.col("sum") > open_)
    kth = sums.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k).select("question", F.col("sum").alias("cutoff"))
    asked = written(queries.join(kth, "question", "left").withColumn("cutoff", F.coalesce("cutoff", open_)))
    hits = first_of(_resolved(blocks, blocks.meet(asked, n), k), k)
    return hits.join(queries.select("question", "query_id"), "question").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
