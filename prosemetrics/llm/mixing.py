"""Mixing sources to target weights.

Every row gets a hash-random key. Keys are uniform, so cutting the key space into
equal ranges sorts each source into ranges of like size without sampling it; the
range totals give the prefix sum before a range, a window inside the range gives
the rest. A source's budget is then a cut in its key order. No source, however
large, meets in one task: a task holds about sqrt(rows) rows of one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, key_ranges, random_key, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null text: 0)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. One row a source.

    Sources in code point order (null last) weigh ``weights``, repeating. Targets share
    ``share`` of all sizes by weight; none exceeds ``epochs`` times its source. What is
    above is shared again by weight until none is: the level at which that ends is the
    first one, in order of size a weight, that its own source can bear.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(kinds, (nth % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - before) / after)
    bearable = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))
    per = per.withColumn("level", F.min(bearable).over(everything)["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def mix(sizes: DataFrame, rows: int, **options) -> DataFrame:
    """The columns of ``sizes`` (doc_id, source, size and any others) with source_size, target, key, copies and taken.

    copies: times the mix takes the row. Whole epochs take every row; of the last,
    unfinished one it takes the rows, in key order, whose middle lies before the
    source's budget, so a source misses its target by half a row at most. Rows of
    the same id and size share a key; their order among each other makes no
    difference to the multiset of results. Empty table: no rows. Null sources are a
    source; null ids are a key like any other.
    """
    n = key_ranges(rows)
    keyed = sizes.withColumn("key", random_key("doc_id"))
    keyed = keyed.withColumn("range", F.shiftright(F.shiftright("key", 29) * F.lit(n), 31))
    per_range = keyed.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per_range = per_range.select("source", "range", F.coalesce(before, F.lit(0)).alias("before"))
    want = targets(sizes, **options)
    per_range = per_range.alias("r").join(want.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "range", "before", "source_size", "target")
    k, r = keyed.alias("k"), per_range.alias("r")
    joined = k.join(r, F.col("k.source").eqNullSafe(F.col("r.source")) & (F.col("k.range") == F.col("r.range"))).select("k.*", "r.before", "r.source_size", "r.target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = joined.withColumn("start", start).withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (rest > 0) & (F.col("start") + F.col("size") / 2 <= rest)
    out = out.withColumn("copies", (F.col("epochs") + extra.cast("long")).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("before", "range", "start", "epochs")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of ``docs``: their rows, with the same columns, each as many times as the mix takes it.

    The first pass finds, for each source, the whole epochs and the key of the last row
    that the unfinished epoch takes; the second deals every row by those alone, so no
    text is shuffled. Rows that share key, id and size with that last row are ranked
    among each other, and as many are taken as :func:`mix` takes. Null and empty texts
    have no words and may be taken; null sources are a source. Empty table: no rows.
    """
    sizes = written(sized(docs))
    mixed = mix(sizes, sizes.count())
    at = F.struct("key", "doc_id", "size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    same = mixed.withColumn("whole", whole).groupBy("source", at.alias("at")).agg(F.first("whole").alias("whole"), F.count("*").alias("n"), F.sum((F.col("copies") > F.col("whole")).cast("long")).alias("extra"))
    last = F.max(F.when(F.col("extra") > 0, F.struct("at", "n", "extra")))
    cuts = written(same.groupBy("source").agg(F.first("whole").alias("whole"), last.alias("last")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    here = F.struct(random_key("row.doc_id").alias("key"), F.col("row.doc_id").alias("doc_id"), F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    dealt = row.withColumn("here", here).join(cuts.alias("c"), F.col("row.source").eqNullSafe(F.col("c.source")))
    tied = F.coalesce((F.col("here") == F.col("c.last.at")) & (F.col("c.last.extra") < F.col("c.last.n")), F.lit(False))
    sure = dealt.filter(~tied).select("row", (F.col("c.whole") + F.coalesce(F.col("here") <= F.col("c.last.at"), F.lit(False)).cast("long")).alias("copies"))
    # Equal rows at a cut, of which the mix takes some: the rows of one id of one source.
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.to_json("row")))
    some = dealt.filter(tied).select("row", F.col("row.source").alias("source"), "c.whole", F.col("c.last.extra").alias("extra"))
    some = some.select("row", (F.col("whole") + (nth <= F.col("extra")).cast("long")).alias("copies"))
    split = cuts.filter("last.extra < last.n").limit(1).count()  # else there is nothing to rank, and one scan does
    taken = (sure.unionByName(some) if split else sure).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
