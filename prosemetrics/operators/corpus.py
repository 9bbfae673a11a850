"""How often checks fire on a corpus, and whether that tells corpora apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks.base import Ruleset
from ..plans.registry import ruleset
from ..plans.shared import kept
from .lint import flag_arrays, merged_kinds
from .structure import blank_words

DISCRIMINATES, BACKWARDS = 2.0, 0.5


def activity(docs: DataFrame, merged: DataFrame, checks: DataFrame, by: tuple[str, ...] = (), *, key: str = "doc_id", text: str = "text", include_mechanical: bool = False) -> DataFrame:
    """by, check_id, kind, hits, files, words, documents, per_1k, share: a row for every check, also those that never fired.

    Hits are merged flags, of the semantic bucket unless asked otherwise; per 1000 words
    between blanks, to two decimals. ``by``: columns of ``docs`` that make corpora.
    """
    by = [*by]
    totals = docs.groupBy(*by).agg(F.sum(blank_words(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("words"), F.count("*").alias("documents"))
    hits = merged if include_mechanical else merged.filter("bucket = 'semantic'")
    hits = hits.select(key, F.col("kind").alias("check_id"))
    hits = hits.join(docs.select(key, *by), key) if by else hits
    per = hits.groupBy(*by, "check_id").agg(F.count("*").alias("hits"), F.count_distinct(key).alias("files"))
    grid = totals.crossJoin(F.broadcast(checks.select("check_id", "kind")))  # corpora by declared checks
    same = F.col("g.check_id") == F.col("p.check_id")
    for c in by:  # a null is a corpus of its own
        same &= F.col(f"g.`{c}`").eqNullSafe(F.col(f"p.`{c}`"))
    out = grid.alias("g").join(per.alias("p"), same, "left").select("g.*", "p.hits", "p.files").fillna(0, ["hits", "files"])
    rate = F.coalesce(F.round(F.try_divide(F.col("hits") * 1000.0, F.col("words")), 2), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.sum("hits").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))), F.lit(0.0))
    return out.select(*by, "check_id", "kind", "hits", "files", "words", "documents", rate.alias("per_1k"), share.alias("share"))


def _each_kind() -> Column:
    """array<struct<kind, n>> of the kinds that are in ``kinds`` or ``labelled`` of a row."""
    some = F.transform(F.array_distinct("kinds"), lambda k: F.struct(k.alias("kind"), F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias("n")))
    return F.concat(some, F.filter("labelled", lambda x: x["n"] > 0))


def activity_of(docs: DataFrame, rules: str | Ruleset = "prose", by: tuple[str, ...] = (), context: dict | None = None, *, key: str = "doc_id", text: str = "text", include_mechanical: bool = False, **options) -> DataFrame:
    """``activity`` of ``docs``, from one pass over them and one small shuffle.

    A document gives a row for each check that fired and one for its words; tasks add them
    up before the shuffle, so that holds by corpus and check. Checks left out by
    ``disabled`` have no row.
    """
    declared, by = ruleset(rules), [*by]
    off = set(options.get("disabled", ()))
    with_words = docs.withColumn("_words", blank_words(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    found = flag_arrays(with_words, declared, context, key=key, text=text, keep=(*by, "_words"), counted=True, **options)
    kinds = merged_kinds(F.filter("found", lambda f: F.lit(include_mechanical) | ~f["mechanical"]), declared)
    per = F.transform(_each_kind(), lambda x: F.struct(x["kind"].alias("check_id"), x["n"].alias("hits"), F.lit(0).cast("long").alias("words")))
    own = F.struct(F.lit(None).cast("string").alias("check_id"), F.lit(0).cast("long").alias("hits"), F.col("_words").alias("words"))
    rows = found.select(*by, "_words", "labelled", kinds.alias("kinds")).select(*by, F.explode(F.concat(F.array(own), per)).alias("r")).select(*by, "r.*")
    sums = rows.groupBy(*by, "check_id").agg(F.sum("hits").alias("hits"), F.count("*").alias("files"), F.sum("words").alias("words"))
    # A corpus becomes one row: its totals, and a map of the checks that fired.
    some = F.col("check_id").isNotNull()
    corpora = sums.groupBy(*by).agg(F.sum("words").alias("words"), F.sum(F.when(~some, F.col("files")).otherwise(0)).alias("documents"), F.map_from_entries(F.collect_list(F.when(some, F.struct("check_id", F.struct("hits", "files").alias("n"))))).alias("fired"))  # one entry a check
    dim = F.array(*[F.struct(F.lit(c.id).alias("check_id"), F.lit(c.kind).alias("kind")) for c in declared.checks if c.id not in off])
    out = corpora.filter("documents > 0").select(*by, "words", "documents", "fired", F.explode(dim).alias("c")).select(*by, "words", "documents", "c.*", F.try_element_at("fired", F.col("c.check_id")).alias("n"), F.aggregate(F.map_values("fired"), F.lit(0).cast("long"), lambda a, x: a + x["hits"]).alias("all_hits"))
    out = out.withColumns({"hits": F.coalesce("n.hits", F.lit(0)), "files": F.coalesce("n.files", F.lit(0))})
    rate = F.coalesce(F.round(F.try_divide(F.col("hits") * 1000.0, F.col("words")), 2), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("all_hits")), F.lit(0.0))
    return out.select(*by, "check_id", "kind", "hits", "files", "words", "documents", rate.alias("per_1k"), share.alias("share"))


def compare(measured: DataFrame, control: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """check_id, by, per_1k, control_per_1k, ratio, verdict. ``by``: columns of ``control`` that make several controls.

    The ratio is of the rounded rates; it is null where the control's is zero.
    """
    m = measured.select("check_id", "per_1k")
    c = control.select("check_id", *by, F.col("per_1k").alias("control_per_1k"))
    grid = m.crossJoin(F.broadcast(control.select(*by).distinct())) if by else m
    out = grid.join(c, ["check_id", *by], "left").fillna(0.0, ["control_per_1k"])
    ratio = F.when(F.col("control_per_1k") > 0, F.try_divide(F.col("per_1k"), F.col("control_per_1k")))
    verdict = F.when((F.col("per_1k") == 0) & (F.col("control_per_1k") == 0), "silent").when(F.col("control_per_1k") == 0, "discriminates").when(ratio >= DISCRIMINATES, "discriminates").when(ratio <= BACKWARDS, "backwards").otherwise("no signal")
    return out.select("check_id", *by, "per_1k", "control_per_1k", ratio.alias("ratio"), verdict.alias("verdict"))


def consensus(compared: DataFrame) -> DataFrame:
    """check_id, verdict, controls: the verdict that all controls share, else ``disputed``."""
    return compared.groupBy("check_id").agg(F.when(F.count_distinct("verdict") == 1, F.min("verdict")).otherwise("disputed").alias("verdict"), F.count("*").alias("controls"))


def calibrate(compared: DataFrame, headroom: float = 1.0, gated: DataFrame | None = None) -> DataFrame:
    """check_id, control_per_1k, measured_per_1k, gated_per_1k, target_per_1k, direction, skipped: for checks on which all controls agree.

    The target is the most permissive control's rate times the headroom. A rate of zero is
    no evidence: such checks are skipped, with the reason.
    """
    agreed = consensus(compared).filter("verdict = 'discriminates'").select("check_id")
    out = compared.join(agreed, "check_id", "left_semi").groupBy("check_id").agg(F.max("control_per_1k").alias("control_per_1k"), F.first("per_1k").alias("measured_per_1k"))
    out = out.join(gated.select("check_id", F.col("per_1k").alias("gated_per_1k")), "check_id", "left") if gated is not None else out.withColumn("gated_per_1k", F.lit(None).cast("double"))
    target = F.when(F.col("control_per_1k") > 0, F.col("control_per_1k") * headroom)
    direction = F.when(target.isNull() | F.col("gated_per_1k").isNull(), None).when(F.col("gated_per_1k") < target * 0.5, "loosen").when(F.col("gated_per_1k") > target * 2, "tighten").otherwise("at the band")
    return out.select("check_id", F.round("control_per_1k", 3).alias("control_per_1k"), "measured_per_1k", "gated_per_1k", F.round(target, 3).alias("target_per_1k"), direction.alias("direction"), F.when(target.isNull(), "no control evidence").alias("skipped"))


def scan_summary(verdicts: DataFrame) -> DataFrame:
    """clean, with_notes, failed, total."""
    return verdicts.agg(F.count_if(F.col("status") == "clean").alias("clean"), F.count_if((F.col("status") != "clean") & ~F.col("would_block")).alias("with_notes"), F.count_if("would_block").alias("failed"), F.count("*").alias("total"))


def kind_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("kind").agg(F.count("*").alias("flags")).orderBy(F.desc("flags"), "kind")


def kind_counts_of(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, **options) -> DataFrame:
    """``kind_counts(merged_flags(docs))``, where a document gives a row for each kind that it has, not one for each flag with its text."""
    declared = ruleset(rules)
    kinds = flag_arrays(docs, declared, context, counted=True, **options).select("labelled", merged_kinds(F.col("found"), declared).alias("kinds"))
    # By an outer explode, as in lint: the other one gets a filter on the array, which would be computed again for it.
    rows = kinds.select(F.explode_outer(_each_kind()).alias("r")).filter("r is not null")
    return rows.groupBy("r.kind").agg(F.sum("r.n").alias("flags")).orderBy(F.desc("flags"), "kind")


#: Digests that are joined into one.
MANIFEST_RANGE = 10_000


def manifest(docs: DataFrame, label: str = "source", text: str = "text", order: str = "doc_id", per_range: int = MANIFEST_RANGE) -> DataFrame:
    """One row a source: documents, words, sha256 of its labelled texts in order of the id (ties by their digests).

    The digest of a list: that of its members joined, if these are ``per_range`` at most,
    else that of the digests of its ranges of so many members. Ranges go by exact rank: rows
    are range-sorted, parts counted, and the counts before a part added to places in it. So
    the result depends on the rows alone, and no task joins more than ``per_range`` digests.
    """
    one = F.sha2(F.concat(F.coalesce(F.col(label), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), 256)
    rows = docs.select(F.col(label).alias("source"), F.col(order).alias("o"), one.alias("d"), blank_words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The ranges come from a sample, so the parted rows are written before anything counts them.
    placed = kept(rows.repartitionByRange(parts, "source", "o", "d").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("w").cast("long").alias("words"))
    counts = placed.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("o", "d")) - 1
    ranked = placed.select("source", "part", "d", place.alias("place")).join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    level = ranked.select("source", (F.col("place") + F.col("start")).alias("rank"), "d")
    most = totals.agg(F.max("documents")).first()[0] or 0
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"]), ""), 256)
    again = False
    while most > 1 or not again:
        many = F.max("rank").over(Window.partitionBy("source")) > 0 if again else F.lit(True)
        marked = level.withColumn("many", many)  # a source that is down to one digest keeps it
        range_ = F.floor(F.col("rank") / per_range).cast("long")
        ups = marked.filter("many").groupBy("source", range_.alias("range")).agg(joined.alias("d")).select("source", F.col("range").alias("rank"), "d")
        level = ups.unionByName(marked.filter("not many").select("source", "rank", "d"))
        most, again = -(-most // per_range), True
    whole = level.select(F.col("source").alias("of"), F.col("d").alias("sha256"))
    return totals.join(whole, F.col("source").eqNullSafe(F.col("of"))).select("source", "documents", "words", "sha256")
