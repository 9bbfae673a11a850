"""The report of a run: totals by arm, over all prompts and the revised ones, and by turn, from one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(rows: DataFrame, metrics: tuple[str, ...] = ("words", "enforced_flags", "held_out_flags"), gated: str = "gated") -> DataFrame:
    """scope, arm, turn, prompts, generations, passed, revised and for each metric its sum and ``mean_`` of it.

    rows: arm, prompt_id, turn, iterations, passed and the metrics; turn null for the end of
    a prompt, and one row an arm, prompt and turn. scope: ``all`` prompts, those that the gated arm ``revised`` (more
    than one generation), or a ``turn``. One window by prompt finds the revised ones, one
    aggregate makes all three groupings. Nulls count as no value.
    """
    mine = F.max(F.when((F.col("arm") == gated) & F.col("turn").isNull(), F.col("iterations") > 1)).over(Window.partitionBy("prompt_id"))
    marked = rows.withColumn("touched", F.coalesce(mine, F.lit(False)))
    # A row counts in up to two scopes; these are groups of one aggregate, summed in each task before they travel.
    scopes = F.when(F.col("turn").isNotNull(), F.array(F.lit("turn"))).when(F.col("touched"), F.array(F.lit("all"), F.lit("revised"))).otherwise(F.array(F.lit("all")))
    some = marked.select(F.explode(scopes).alias("scope"), "arm", "turn", "iterations", "passed", "touched", *metrics)
    sums = [x for m in metrics for x in (F.sum(F.col(m).cast("double")).alias(m), F.avg(F.col(m).cast("double")).alias(f"mean_{m}"))]
    return some.groupBy("scope", "arm", "turn").agg(
        F.count("*").alias("prompts"), F.avg("iterations").alias("generations"), F.count_if("passed").alias("passed"), F.count_if("touched").alias("revised"), *sums
    )


def comparison(total: DataFrame, metrics: dict[str, bool], arms: tuple[str, ...] = ("ungated", "control", "blind", "instructed", "gated"), base: str = "ungated", gated: str = "gated", control: str = "control") -> DataFrame:
    """scope, metric, a column of means for each of ``arms``, change, percent, direction, noise, finding; scopes ``all`` and ``revised``.

    metrics: whether less is better, by name. The pivot comes last, over a row an arm. An
    arm that the run lacks is null. A change not above the noise is no finding.
    """
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(less).alias("less"), F.col(f"mean_{m}").alias("mean")) for m, less in metrics.items()])
    long = total.filter("scope <> 'turn'").select("scope", "arm", F.explode(named).alias("m")).select("scope", "arm", "m.*")
    wide = long.groupBy("scope", "metric", "less").agg(*[F.max(F.when(F.col("arm") == a, F.col("mean"))).alias(a) for a in arms])
    change = F.col(gated) - F.col(base)
    better = F.when(F.col("less"), change < 0).otherwise(change > 0)
    direction = F.when(change.isNull(), None).when(F.abs(change) < 1e-9, "no change").when(better, "better").otherwise("WORSE")
    noise = F.abs(F.col(control) - F.col(base))
    out = wide.withColumns({"change": change, "percent": F.round(F.try_divide(change * 100, F.col(base))), "direction": direction, "noise": noise})
    return out.withColumn("finding", F.abs("change") > F.coalesce("noise", F.lit(0.0))).drop("less")


def board(total: DataFrame, metric: str, base: str = "ungated") -> DataFrame:
    """arm, total, percent (against the base arm), generations, rank: fewest first, ties by name; over all prompts."""
    rows = total.filter("scope = 'all'").select("arm", F.col(metric).alias("total"), "generations")
    whole = Window.partitionBy(F.lit(1))  # a row an arm
    of = F.max(F.when(F.col("arm") == base, F.col("total"))).over(whole)
    ranked = rows.withColumns({"percent": F.round(F.try_divide((F.col("total") - of) * 100, of)), "rank": F.row_number().over(whole.orderBy("total", "arm"))})
    return ranked.select("arm", "total", "percent", "generations", "rank")


def drift_table(total: DataFrame, metric: str) -> DataFrame:
    """arm, turns (array of the sums at the turns that the arm reached, in order), change (last minus first)."""
    at = F.array_sort(F.collect_list(F.struct("turn", F.col(metric).alias("v"))))  # one a turn
    rows = total.filter("scope = 'turn'").groupBy("arm").agg(at.alias("t"))
    sums = F.transform("t", lambda x: x["v"])
    return rows.select("arm", sums.alias("turns"), (F.element_at(sums, -1) - F.element_at(sums, 1)).alias("change"))


def save_report(total: DataFrame, path: str, run: str) -> None:
    """The totals of a run beside its rows; saving a run's report again replaces it and leaves the others."""
    total.withColumn("run", F.lit(run)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)
