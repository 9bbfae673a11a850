"""Quality rules with thresholds that adapt to each language and source.

A mergeable quantile sketch (the one behind ``percentile_approx``) of each measure is
built per (lang, source). Every measure is a count per unit: symbols per word, characters
per word, repeated lines per line. The quartiles of a group give the rates that are still
usual there (``quartile +- REACH * interquartile range``); a document of n units is an
outlier if its count lies more than ``SIGMAS`` standard deviations of a Poisson count, and
``SIGMAS`` besides (nothing seen at a rate of zero allows for three), beyond n times that
rate. So there is no fixed cutoff: a long document is held to its group's rates, a short
one gets the benefit of chance. The rates are a small table, one row a group, joined to
the documents. Two scans, no text is shuffled, no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, written

ACCURACY = 10_000
REACH, SIGMAS = 3.0, 3.0
#: measure: (its count, its units, whether too little of it is bad too).
MEASURES = {"symbols_per_word": ("n_symbols", "n_words", False), "chars_per_word": ("word_chars", "n_words", True), "dup_line_share": ("n_dup_lines", "n_lines", False)}
SYMBOL = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"


def repeat_words(words: Column) -> Column:
    """How many words lie in a 5-word window that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, j: F.get(p, j)["h"] == x["h"]
            return F.sort_array(F.filter(F.transform(p, lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull()))

        zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).cast("long").alias("n"))
        return F.aggregate(let(placed, starts), zero, step, lambda a: a["n"])

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 5)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def count(w: Column) -> Column:
        some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(w) > 5, let(windows(w), some)).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def _cheap(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
        "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))),
    }


def measured(docs: DataFrame, *, text: str = "text", repeats: bool = True) -> DataFrame:
    """``docs`` with the base counts and the three measures in columns that start with ``_``.

    Null text counts as empty. A measure is null where there is no word.
    """
    out = docs.withColumns({f"_{k.lstrip('_')}": v for k, v in _cheap(F.col(text)).items()})
    out = out.withColumns({"_n_dup_lines": F.col("_lines")["dup"], "_n_lines": F.col("_lines")["n"]})
    out = out.withColumns({f"_{m}": F.when(F.col(f"_{units}") > 0, F.col(f"_{count}") / F.col(f"_{units}")) for m, (count, units, _) in MEASURES.items()})
    if repeats:
        out = out.withColumn("_n_repeat_words", repeat_words(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))))
        out = out.withColumn("_base_failed", (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")))
    return out.drop("_lines")


def fences(docs: DataFrame) -> DataFrame:
    """lang, source and, for each measure, the least and largest rate that is usual there."""
    quartiles = {m: F.percentile_approx(f"_{m}", [0.25, 0.75], ACCURACY) for m in MEASURES}
    out = measured(docs, repeats=False).groupBy("lang", "source").agg(*[q.alias(f"q_{m}") for m, q in quartiles.items()])
    for m, (_, _, both) in MEASURES.items():
        q1, q3 = F.col(f"q_{m}")[0], F.col(f"q_{m}")[1]
        reach = F.lit(REACH) * (q3 - q1)
        out = out.withColumn(f"least_{m}", F.greatest(q1 - reach, F.lit(0.0)) if both else F.lit(0.0)).withColumn(f"most_{m}", q3 + reach)
    return out.drop(*[f"q_{m}" for m in MEASURES])


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts (``_n_words``, ...), ``_base_failed`` and ``_kept``.

    Null languages and sources are groups of their own. A document without words fails
    the base rules. Empty table: no rows. Repeated rows are judged alike.
    """
    d, f = measured(docs).alias("d"), written(fences(docs)).alias("f")  # written, so the plan knows its size: texts are not shuffled for it
    out = d.join(f, F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    inside = ~F.col("_base_failed")
    for m, (count, units, _) in MEASURES.items():
        low, high = (F.col(f"_{units}") * F.col(f"{end}_{m}") for end in ("least", "most"))
        chance = lambda x: F.lit(SIGMAS) * F.sqrt(x) + F.lit(SIGMAS)
        inside &= F.coalesce(F.col(f"_{count}") <= high + chance(high), F.lit(True)) & F.coalesce(F.col(f"_{count}") >= low - chance(low), F.lit(True))
    return out.withColumn("_kept", inside).select("d.*", "_kept")


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed and kept."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *[F.col(f"_{c}").alias(c) for c in counts], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns, whatever their names.

    Rows of null or empty text go, since they have no words. Empty table: no rows.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judged(row.select("row", *[F.col("row")[c].alias(c) for c in ("text", "lang", "source")])).filter("_kept").select("row.*")
