"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and those of the lines beside it;
transitions tie neighbouring labels. Forward-backward gives each line's marginal; the
mean of the marginals, weighted by the lines' lengths, is calibrated to the document's
label. Lines carry no labels of their own: in training each has its document's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, remove, written

#: Labelled documents and lines that the fit reads, at most; steps of its optimiser.
SAMPLE, LINES, STEPS, PENALTY = 3_000, 150_000, 150, 1e-3
THRESHOLD = 0.3
OWN = 11

_CLASS = np.full(256, 7, np.int64)  # 7: any other byte
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "#*$%&<>@^~{}[]\\=+_", "|", " \t\r\x0b\x0c")):
    _CLASS[[ord(c) for c in _chars]] = _k


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One row a line of ``text``, and the weight (1 + bytes) of each. Null counts as empty: one empty line."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    ends = raw == 10
    line = np.cumsum(ends) - ends
    n = int(ends.sum()) + 1
    counts = np.bincount(line * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.bincount(line[~ends], minlength=n).astype(float)
    counts[:-1, 7] -= 1  # the line ends themselves
    words, fresh, own = np.zeros(n), np.zeros(n), np.zeros(n)
    seen: set[str] = set()
    for i, x in enumerate((text or "").split("\n")):
        found = x.split()
        if found:
            here = set(found)
            words[i], own[i], fresh[i] = len(found), len(here), len(here - seen)
            seen |= here
    w, s = np.maximum(words, 1), np.maximum(size, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    out = np.column_stack([counts[:, 0] / letters, counts[:, 2] / s, counts[:, 3] / w, counts[:, 4] / w, counts[:, 5] / w, own / w, fresh / np.maximum(own, 1), np.log1p(size), size / w, words == 0, np.log1p(words)])
    return out.astype("float32"), 1 + size


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """own, the line before and the line after (zeros at a document's ends), side by side."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = 0
    after[np.append(starts[1:], len(own)) - 1] = 0
    return np.hstack([own, before, after])


def _positions(lengths: np.ndarray):
    """For each step of the chains, the chains that have it (longest first) and their rows."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.cumsum(lengths) - lengths
    for t in range(int(lengths.max()) if len(lengths) else 0):
        live = order[: np.searchsorted(-lengths[order], -t, side="left")]
        yield live, starts[live] + t


def marginals(score: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each row, the expected transitions and the log partition function.

    score: a row's log score of good against bad; move: 2 x 2 log scores of transitions
    (bad, good); lengths: rows of each chain, in order.
    """
    emit = np.column_stack([np.zeros(len(score)), score])
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    steps = list(_positions(lengths))
    for t, (_, rows) in enumerate(steps):
        if t:
            prior = ahead[rows - 1]
            ahead[rows] = emit[rows] + np.logaddexp(prior[:, :1] + move[0], prior[:, 1:] + move[1])
        else:
            ahead[rows] = emit[rows]
    last = np.cumsum(lengths) - 1
    z = np.logaddexp(ahead[last, 0], ahead[last, 1])
    pairs = np.zeros((2, 2))
    every = np.repeat(z, lengths)
    for t in range(len(steps) - 2, -1, -1):
        rows = steps[t + 1][1] - 1
        nxt = emit[rows + 1] + back[rows + 1]
        for a in (0, 1):
            back[rows, a] = np.logaddexp(move[a, 0] + nxt[:, 0], move[a, 1] + nxt[:, 1])
            for b in (0, 1):
                pairs[a, b] += np.exp(ahead[rows, a] + move[a, b] + nxt[:, b] - every[rows]).sum()
    good = np.exp(ahead[:, 1] + back[:, 1] - every)
    return np.clip(good, 0, 1), pairs, float(z.sum())


def train(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> dict:
    """The model from line features, line weights and label (0 or 1) of each document."""
    lengths = np.array([len(x) for x in features])
    starts = np.cumsum(lengths) - lengths
    x = np.vstack(features).astype(float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = with_neighbours((x - mean) / spread, starts)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat(labels, lengths).astype(float)
    # Documents count alike whatever their number of lines; so do both labels.
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)])
    same = (lengths > 1) & True
    theta, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (lengths[same & (labels == k)] - 1).sum()
    for step in range(1, STEPS + 1):
        p, pairs, _ = marginals(x @ theta, move, lengths)
        g = np.concatenate([(y - p) @ x, (seen - pairs).ravel()]) / len(y) - PENALTY * np.concatenate([theta, move.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        change = 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta, move = theta + change[:-4], move + change[-4:].reshape(2, 2)
    model = {"mean": mean, "spread": spread, "theta": theta, "move": move, "a": 1.0, "b": 0.0}
    raw = logit(quality(model, features, weights))
    a, b = 1.0, float(np.log(share[1] / share[0]))
    for _ in range(50):  # Newton's method for the two numbers of the calibration
        q = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        h = q * (1 - q) + 1e-6
        grad = np.array([((labels - q) * raw).sum() - 0.1 * a, (labels - q).sum()])
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return model | {"a": a, "b": b}


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def quality(model: dict, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The length-weighted mean of the marginals of each document's lines."""
    lengths = np.array([len(x) for x in features])
    starts = np.cumsum(lengths) - lengths
    x = with_neighbours((np.vstack(features) - model["mean"]) / model["spread"], starts)
    good, _, _ = marginals(x @ model["theta"][:-1] + model["theta"][-1], model["move"], lengths)
    w = np.concatenate(weights)
    return np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts)


def scored(model: dict, texts: list[str | None]) -> np.ndarray:
    pairs = [line_features(t) for t in texts]
    raw = quality(model, [p[0] for p in pairs], [p[1] for p in pairs])
    return 1 / (1 + np.exp(-np.clip(model["a"] * logit(raw) + model["b"], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> dict | None:
    """A model from at most ``sample`` labelled documents that are not held out, taken by a hash of the id.

    Of these, in that order, those that come to ``lines`` lines in all; whole documents
    only. Rows that repeat an id are one document, of which any row may be taken.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    known = known.filter(~F.coalesce(held_out(), F.lit(True)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                f, w = line_features(b.column("text")[i].as_py())
                fits = len(f) <= lines
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("quality").slice(i, 1), pa.array([len(f)], pa.int64()), pa.array([f.tobytes() if fits else None], pa.binary()), pa.array([w.astype("float32").tobytes() if fits else None], pa.binary())], ["doc_id", "quality", "n", "f", "w"])

    read = written(texts.mapInArrow(run, "doc_id long, quality int, n long, f binary, w binary").filter("f is not null").dropDuplicates(["doc_id"]))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # ``sample`` rows at most
    taken = read.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= lines).select("doc_id")
    rows = read.join(F.broadcast(taken), "doc_id").orderBy("doc_id").toPandas()
    remove(read)
    if rows.empty:
        return None
    features = [np.frombuffer(x, "float32").reshape(-1, OWN) for x in rows["f"]]
    return train(features, [np.frombuffer(x, "float32").astype(float) for x in rows["w"]], rows["quality"].to_numpy())


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, predicted. Without a model (nothing to learn from) every score is 0.5."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                s = scored(model, b.column("text").to_pylist()) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype("int32"))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    Null and empty texts are one empty line and get a score like any other. Null ids are
    held out. Repeated rows are scored alike; of labels that repeat an id the larger
    counts. Other columns of ``docs`` do not matter. Empty table: no rows.
    """
    out = score(docs, fit(docs, labels))
    return out.withColumn("held_out", F.coalesce(held_out(), F.lit(True))).select("doc_id", "held_out", "score", "predicted")
