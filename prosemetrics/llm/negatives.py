"""Hard-negative mining by distributed radix selection.

Each anchor has windows of scores: one for its positives (rows of its own label), then one
for each positive found, in which negatives (rows of other labels) count as hard. The
scores of a window are never gathered. Instead every task counts them in a histogram of
``DIGITS`` buckets; the sums over all tasks locate the bucket of the kth best score, and the
next round spreads that bucket alone over as many again, digit by digit, until few rows lie
at or above it or the bucket is one score. Only rows that reach this score are gathered,
the k best of each task, ties by the smaller id; so ties of any number are bounded too.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vector_blocks import AT_ONCE, FOUND, FOUND_ARROW, Best, Blocks, Shape, asked_column, first_of, sent, usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Bits of a digit; a window is settled when this many times k rows lie in the located bucket and above.
BITS, FEW = 6, 4
DIGITS = 1 << BITS
#: A window: the question's number, its anchor's, id, label and vector; scores from ``low`` to ``high`` and a count still needed in them; the window's top.
WINDOW = "question long, chunk int, anchor long, anchor_id long, label long, packed binary, low long, high long, need long, top long, done boolean"
_COUNTS, _COUNTS_ARROW = "question long, counts array<long>", pa.schema([("question", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _shift(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits below the digit that spreads low .. high over at most ``DIGITS`` buckets."""
    return np.array([max(0, int(d).bit_length() - BITS) for d in high - low], np.int64)


class _Asked:
    """The windows of a chunk, those of one anchor side by side."""

    def __init__(self, asked: pa.StructArray, shape: Shape):
        order = np.argsort(asked_column(asked, "anchor"), kind="stable")
        take = lambda name: asked_column(asked, name)[order]
        self.question, self.low, self.high, self.top = (take(c) for c in ("question", "low", "high", "top"))
        self.shift = _shift(self.low, self.high)
        _, first, self.nth = np.unique(take("anchor"), return_index=True, return_inverse=True)
        self.ids, self.labels = take("anchor_id")[first], take("label")[first]
        raw = b"".join(take("packed")[first])
        self.vectors = shape.numbers(raw)

    def scored(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, same: bool):
        """(windows, their anchors' scores of the rows that may count, whether they do), some anchors at a time."""
        for at in range(0, len(self.ids), AT_ONCE):
            to = min(len(self.ids), at + AT_ONCE)
            scores = self.vectors[at:to] @ vectors.T
            alike = self.labels[at:to, None] == labels
            fits = alike & (self.ids[at:to, None] != ids) if same else ~alike
            a, b = np.searchsorted(self.nth, (at, to))
            # windows of one anchor in turn: the first of every anchor, the second, ...
            turn = np.arange(a, b) - np.searchsorted(self.nth, self.nth[a:b])
            for t in range(int(turn.max(initial=-1)) + 1):
                windows = np.arange(a, b)[turn == t]
                rows = self.nth[windows] - at
                yield windows, scores[rows], fits[rows]


def _counted(blocks: Blocks, windows: DataFrame, n: int, same: bool, each: int) -> DataFrame:
    shape = blocks.shape

    def state(asked):
        found = _Asked(asked, shape)
        return found, np.zeros((len(found.question), DIGITS), np.int64)

    def add(state, ids, labels, vectors):
        asked, counts = state
        for w, scores, fits in asked.scored(ids, labels, vectors, same):
            row, col = np.nonzero(fits & (scores >= asked.low[w, None]) & (scores <= asked.high[w, None]))
            digit = (asked.high[w[row]] - scores[row, col].astype(np.int64)) >> asked.shift[w[row]]
            counts[w] += np.bincount(row * DIGITS + digit, minlength=len(w) * DIGITS).reshape(-1, DIGITS)

    def send(state):
        asked, counts = state
        some = counts.any(1)
        return {"question": asked.question[some], "counts": list(counts[some])}

    found = blocks.run(blocks.meet(windows, n, each), state, add, send, _COUNTS, _COUNTS_ARROW)
    sums = found.groupBy("question").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(DIGITS)])
    return sums.select("question", F.array(*[f"c{i}" for i in range(DIGITS)]).alias("counts"))


def _located(windows: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The windows drawn together to the bucket of the kth best score; done where that is all they need."""

    def locate(batches):
        for b in batches:
            none = np.zeros(DIGITS, np.int64)
            sums = np.cumsum(np.vstack([none if c is None else c for c in b["counts"]] or [none]), axis=1)[: len(b)]
            low, high, need = (b[c].to_numpy() for c in ("low", "high", "need"))
            shift, rows = _shift(low, high), np.arange(len(b))
            enough = sums[:, -1] >= need
            digit = np.where(enough, (sums < need[:, None]).sum(1), 0).clip(0, DIGITS - 1)
            before = np.where(digit > 0, sums[rows, digit - 1], 0)
            to = high - (digit << shift)
            from_ = np.maximum(low, to - (np.int64(1) << shift) + 1)
            few = sums[rows, digit] + k - need <= FEW * k
            yield b.drop(columns="counts").assign(
                low=np.where(enough, from_, low), high=np.where(enough, to, high),
                need=np.where(enough, need - before, need), done=~enough | few | (shift == 0),
            )

    return windows.join(counts, "question", "left").select("*").mapInPandas(locate, WINDOW)


def select(blocks: Blocks, windows: DataFrame, anchors: int, k: int, same: bool, each: int = 1) -> DataFrame:
    """question, score, vec_id, rank: the k best rows of every window (``WINDOW``), of the anchor's label or of others.

    ``anchors``: how many anchors the windows belong to, ``each`` of them to one at most.
    """
    order = [c.split()[0] for c in WINDOW.split(", ")]
    windows = written(windows.select(order))
    live = windows.filter(~F.col("done"))
    while not live.isEmpty():  # as many rounds as digits at most
        drawn = _located(live, _counted(blocks, live, anchors, same, each), k)
        windows = written(windows.filter("done").unionByName(drawn.select(order)))
        live = windows.filter(~F.col("done"))

    shape = blocks.shape

    def state(asked):
        return _Asked(asked, shape), Best(k)

    def add(state, ids, labels, vectors):
        asked, best = state
        for w, scores, fits in asked.scored(ids, labels, vectors, same):
            row, col = np.nonzero(fits & (scores >= asked.low[w, None]) & (scores <= asked.top[w, None]))
            best.add(asked.question[w[row]], scores[row, col].astype(np.int64), ids[col])

    found = blocks.run(blocks.meet(windows, anchors, each), state, add, lambda s: sent(s[1]), FOUND, FOUND_ARROW)
    return first_of(found, k)


def hard_negatives(
    table: DataFrame, negatives: int = NEGATIVES, positives: int = POSITIVES, every: int = EVERY,
    scale: int = SCALE, low: int = 50, high: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors whose components are floor(scale * x). Anchors:
    rows whose vec_id is divisible by ``every``; positives: an anchor's best other rows of the
    same label, by score, ties by smaller vec_id; for each of them the best ``negatives`` rows
    of other labels with low * positive <= 100 * negative <= high * positive.

    Nulls, non-finite components and odd widths: :func:`vector_blocks.usable`, so rows with a
    null label take no part. A row is no positive of an anchor with its id. Rows that repeat
    an id, label and vector are one anchor, but as positives and negatives each counts. Equal
    scores go by id. Other columns don't matter. Too few rows: all there are; empty: no rows.
    """
    blocks = Blocks(usable(table.select("vec_id", "embedding", F.col("label").cast("long").alias("label")), scale, "label"), "label")
    asking = blocks.vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", blocks.packed().alias("packed"))
    anchors = written(asking.distinct().withColumn("anchor", F.monotonically_increasing_id()))
    n = anchors.count()
    if not n:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = blocks.dealt(anchors, n, F.col("anchor"))
    whole = F.lit(blocks.bound)
    opened = anchors.select(
        F.col("anchor").alias("question"), "*", (-whole).alias("low"), whole.alias("high"), F.lit(positives).cast("long").alias("need"),
        whole.alias("top"), F.lit(False).alias("done"),
    )
    near = select(blocks, opened, n, positives, True).withColumnsRenamed({"question": "anchor", "vec_id": "positive_id", "score": "positive_score", "rank": "nth"})
    near = written(near.withColumn("question", F.monotonically_increasing_id()))
    parts = F.lit(100)
    score = F.col("positive_score")
    # Quotients by whole numbers, rounded inwards.
    least, most = -_floor_of(-score, low, parts), _floor_of(score, high, parts)
    ranges = near.join(anchors, "anchor").select(
        "question", "chunk", "anchor", "anchor_id", "label", "packed", least.alias("low"), most.alias("high"),
        F.lit(negatives).cast("long").alias("need"), most.alias("top"), F.lit(False).alias("done"),
    )
    hard = select(blocks, ranges.filter("low <= high"), n, negatives, False, positives)
    out = hard.join(near.select("question", "anchor", "positive_id", "positive_score"), "question").join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_of(x, share: int, parts):
    """floor(share * x / parts) in whole numbers, without the product leaving a long."""
    rest = F.pmod(x, parts)
    whole = F.call_function("div", x - rest, parts)
    return whole * share + F.call_function("div", rest * share, parts)
