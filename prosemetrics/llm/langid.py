"""Language identification by words first, then ever shorter character n-grams.

The model holds, per language, log frequencies of known words and of character n-grams.
A known word scores by its own log frequency; another one by the longest of its
n-grams that are known, each step down costing a constant factor.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, written

#: Characters of labelled documents that the fit reads; words and n-grams that it sees less often than ``LEAST`` times are unknown.
SAMPLE, LEAST = 4_000_000, 2
#: Into how many values ids are hashed for the sample.
SPAN = 1 << 40
LONGEST = 5
BACKOFF = float(np.log(0.4))
LETTERS = r"[^\p{L}]+"


def _words(text) -> "F.Column":
    return F.filter(F.split(F.lower(text), LETTERS), lambda w: F.length(w) > 0)


def _pieces(padded, k: int) -> "F.Column":
    """The k-character pieces of a word."""
    starts = F.sequence(F.lit(1), F.length(padded) - (k - 1))
    return F.when(F.length(padded) >= k, F.transform(starts, lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Counts over a bounded sample (by hash of the id) of the rows of ``docs`` with a language and a text.

    ``sample`` bounds its characters, on average: a language has its share of it, or an
    equal part if that is more, and one document at least; so about twice ``sample`` in
    all. Whole documents are taken. Returns ``langs`` and, for every word and n-gram seen
    ``LEAST`` times in the sample, its row of log frequencies.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(SPAN)))
    sizes = written(rows.groupBy("lang").agg(F.sum(F.length("text") + 1).alias("n"), F.min("at").alias("first")))  # written, so the plan knows its size: texts are not shuffled for it
    n, langs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not n:
        return {"langs": [], "words": {}, "grams": {}, "unseen": np.zeros(0)}
    share = F.least(F.lit(1.0), F.greatest(F.lit(sample / n), F.lit(sample / langs) / F.col("n")))
    most = sizes.select("lang", F.greatest((share * SPAN).cast("long") - 1, F.col("first")).alias("most"))
    rows = rows.join(most, "lang").filter("at <= most").select("lang", "text")
    counts = rows.select("lang", F.explode(_words(F.col("text"))).alias("word")).groupBy("lang", "word").count()
    counts = counts.repartition(F.col("word")).persist()
    try:
        known = _seen(counts.select("lang", F.col("word").alias("item"), "count"))
        padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        pieces = F.flatten(F.array(*[_pieces(padded, k) for k in range(1, LONGEST + 1)]))
        grammed = counts.select("lang", "count", F.explode(pieces).alias("item")).groupBy("lang", "item").agg(F.sum("count").alias("count"))
        parts = _seen(grammed)
    finally:
        counts.unpersist()
    langs = sorted(set(known["lang"]) | set(parts["lang"]))
    at = {x: i for i, x in enumerate(langs)}

    def table(frame: pd.DataFrame, order) -> dict:
        out: dict = {}
        for lang, item, count in zip(frame["lang"], frame["item"], frame["count"]):
            out.setdefault(item, np.zeros(len(langs)))[at[lang]] += count
        totals: dict = {}
        for item, row in out.items():
            totals[order(item)] = totals.get(order(item), 0) + row
        return {item: np.log((row + 0.5) / (totals[order(item)] + 0.5 * len(out))).astype("float32") for item, row in out.items()}

    return {"langs": langs, "words": table(known, lambda _: 0), "grams": table(parts, len)}


def _seen(counts: DataFrame) -> pd.DataFrame:
    """Rows of the items of ``LEAST`` counts over all languages; their number is bounded by the sample."""
    totals = counts.groupBy("item").agg(F.sum("count").alias("n")).filter(F.col("n") >= LEAST).select("item")
    return counts.join(totals, "item").select("lang", "item", "count").toPandas()


class Scorer:
    """Scores batches of texts; keeps the scores of words it has met, up to ``room`` of them."""

    def __init__(self, model: dict, room: int = 150_000):
        self.model, self.room, self.met = model, room, {}
        self.n = len(model["langs"])

    def word(self, w: str) -> np.ndarray:
        row = self.model["words"].get(w)
        if row is not None:
            return row
        grams, padded, cost = self.model["grams"], f"^{w}$", 0.0
        for k in range(min(LONGEST, len(padded)), 0, -1):
            rows = [r for i in range(len(padded) - k + 1) if (r := grams.get(padded[i : i + k])) is not None]
            if rows:
                return sum(rows[1:], rows[0]) / len(rows) + cost
            cost += BACKOFF
        return np.zeros(self.n, "float32")

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        size = len(texts)
        clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), LETTERS, " ")
        lists = pc.split_pattern(pc.utf8_trim(clean, " "), " ")
        offsets = np.asarray(lists.offsets)
        coded = pc.dictionary_encode(lists.flatten())
        codes = np.asarray(coded.indices)
        items = coded.dictionary.to_pylist()
        table = np.zeros((len(items) + 1, max(self.n, 1)), "float32")
        met = self.met
        for i, w in enumerate(items):
            row = met.get(w)
            if row is None:
                if len(met) >= self.room:
                    met.clear()
                row = met[w] = self.word(w) if w else np.zeros(self.n, "float32")
            table[i, : self.n] = row
        filled = np.array([bool(w) for w in items] + [False])
        if not self.n:
            return ["und"] * size, np.zeros(size)
        sums = np.zeros((size, self.n))
        owner = np.repeat(np.arange(size), np.diff(offsets))
        if len(codes):
            for j in range(self.n):
                sums[:, j] = np.bincount(owner, weights=table[codes, j], minlength=size)
        n_words = np.bincount(owner, weights=filled[codes], minlength=size) if len(codes) else np.zeros(size)
        best = sums.argmax(1)
        # A document of many words would always reach 1: the evidence counts as that of 20 words at most.
        mean = sums / np.maximum(n_words, 1)[:, None] * np.minimum(np.maximum(n_words, 1), 20)[:, None]
        odds = np.exp(mean - mean.max(1, keepdims=True))
        score = odds[np.arange(size), best] / odds.sum(1)
        none = n_words == 0
        return ["und" if none[i] else self.model["langs"][best[i]] for i in range(size)], np.where(none, 0.0, score)


@functools.lru_cache(maxsize=1)
def _scorer(key: str, holder) -> Scorer:
    return Scorer(holder.value)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """One row a document: doc_id, lang_pred, score. Texts that are null or have no letter: ``und``, 0."""
    holder = docs.sparkSession.sparkContext.broadcast(model)
    key = str(id(holder))

    def run(batches):
        scorer = _scorer(key, holder)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                lang, score = scorer(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out.

    Empty table, or no labelled row: ``und`` for all. Null ids are not held out.
    """
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
