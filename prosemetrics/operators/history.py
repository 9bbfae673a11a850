"""Analytics of the event log of gate decisions. events: seq, ts (seconds), action, file, kinds, ruleset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOUBLE_FIRE_SECONDS, NEARBY_ROWS, NEARBY_SECONDS, RETRY_CAP, LEAST_EVENTS = 2.0, 20, 300.0, 3, 25
GATE_ACTIONS = ("deny", "auto_fix", "clean")
EVENT = "seq long, ts double, action string, file string, kinds array<string>, ruleset string"


#: Events of a log that one task orders.
RANGE = 100_000


def _ordered(events: DataFrame, by: tuple[str, ...], before: int, add) -> DataFrame:
    """``add(events, window)`` over each log in order of seq, where a row looks back on ``before`` rows at most.

    One long log is dealt to ranges of seq; each range also gets the last ``before`` rows of
    the one before it, to look back on, and drops them again. So no task orders a whole log.
    """
    if by:
        return add(events, Window.partitionBy(*by).orderBy("seq"))
    n = events.count()
    cuts = events.agg(F.percentile_approx("seq", [i / 1000 for i in range(1, 1000)], 10_000).alias("at")).first()["at"] or []
    step = max(1, -(-1000 * RANGE // max(n, 1)))
    cuts = sorted(set(cuts[step - 1 :: step])) if n > RANGE else []
    if not cuts:
        return add(events.withColumn("_range", F.lit(0)), Window.partitionBy("_range").orderBy("seq")).drop("_range")
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("seq")))
    placed = events.withColumns({"_range": number, "_own": F.lit(True)})
    last = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("seq")))).filter(F.col("_nth") <= before).drop("_nth")
    # What a range holds may be fewer rows than are looked back on; then the ranges before it lend theirs too.
    lent = last.withColumns({"_range": F.explode(F.sequence(F.col("_range") + 1, F.least(F.col("_range") + before, F.lit(len(cuts))))) if before > 1 else F.col("_range") + 1, "_own": F.lit(False)}) if len(cuts) else last.limit(0)
    lent = lent.filter(F.col("_range") <= len(cuts))
    return add(placed.unionByName(lent), Window.partitionBy("_range").orderBy("seq")).filter("_own").drop("_range", "_own")


def dedupe_double_fire(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Without events that repeat the file and action of the row just before, less than two seconds later.

    Compared with the row before in the log, kept or not. The log is one sequence; ``by``
    names columns (a log's name) that split several logs.
    """

    def add(rows: DataFrame, w) -> DataFrame:
        before = lambda c: F.lag(c).over(w)
        gap = F.coalesce("ts", F.lit(0.0)) - F.coalesce(before("ts"), F.lit(0.0))
        again = F.lag(F.lit(True)).over(w) & F.col("file").isNotNull() & F.col("file").eqNullSafe(before("file")) & F.col("action").eqNullSafe(before("action")) & (gap < DOUBLE_FIRE_SECONDS)
        return rows.withColumn("_again", F.coalesce(again, F.lit(False)))

    return _ordered(events, by, 1, add).filter("not _again").drop("_again")


def deny_streaks(events: DataFrame) -> DataFrame:
    """file, streak, capped: denials of each file since its last other event."""
    last = events.groupBy("file").agg(F.max(F.when(~F.col("action").eqNullSafe(F.lit("deny")), F.col("seq"))).alias("last_other"))
    out = events.join(last, "file").groupBy("file").agg(F.count_if((F.col("action") == "deny") & (F.col("seq") > F.coalesce("last_other", F.lit(-(2**62))))).alias("streak"))
    return out.withColumn("capped", F.col("streak") >= RETRY_CAP)


def recent_deny(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """events with nearby_deny: whether one of the last 20 rows of the raw log, this one included, denied less than 300 seconds before it."""

    def add(rows: DataFrame, w) -> DataFrame:
        latest = F.max(F.when(F.col("action") == "deny", F.coalesce("ts", F.lit(0.0)))).over(w.rowsBetween(-(NEARBY_ROWS - 1), 0))
        return rows.withColumn("nearby_deny", F.coalesce(F.coalesce("ts", F.lit(0.0)) - latest < NEARBY_SECONDS, F.lit(False)))

    return _ordered(events, by, NEARBY_ROWS - 1, add)


def hit_counts(events: DataFrame, checks: DataFrame, ruleset: str | None = None) -> DataFrame:
    """check_id, hits, gate_events, last_fired for every check. events: after ``dedupe_double_fire``."""
    judged = events.filter(F.col("action").isin(*GATE_ACTIONS))
    judged = judged.filter(F.col("ruleset") == ruleset) if ruleset else judged
    per = judged.select("ts", F.explode("kinds").alias("check_id")).groupBy("check_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last_fired"))
    total = judged.agg(F.count("*").alias("gate_events"))
    return checks.select("check_id").join(per, "check_id", "left").fillna(0, ["hits"]).crossJoin(F.broadcast(total))  # one row


def never_fired(counts: DataFrame, least: int = LEAST_EVENTS) -> DataFrame:
    """Checks without a hit, once there were enough events to judge by."""
    return counts.filter((F.col("hits") == 0) & (F.col("gate_events") >= least)).select("check_id")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("action").agg(F.count("*").alias("events"))


def top_kinds(events: DataFrame, k: int = 5) -> DataFrame:
    """The k kinds with most hits, ties by the first time seen."""
    per = events.select("seq", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("hits"), F.min("seq").alias("first_seq"))
    return per.orderBy(F.desc("hits"), "first_seq", "kind").limit(k)


def feed(events: DataFrame, now: float, ruleset: str | None = None, file_part: str | None = None, action: str | None = None, k: int = 50) -> DataFrame:
    """The newest k events that pass the filters, with how long ago they were."""
    out = events.filter(F.col("ruleset") == ruleset) if ruleset else events
    out = out.filter(F.contains(F.lower("file"), F.lit(file_part.lower()))) if file_part else out
    out = out.filter(F.col("action") == action) if action else out
    s = F.lit(now) - F.col("ts")
    ago = F.when(s < 60, "just now").when(s < 3600, F.concat((s / 60).cast("int").cast("string"), F.lit("m ago"))).when(s < 86400, F.concat((s / 3600).cast("int").cast("string"), F.lit("h ago"))).otherwise(F.concat((s / 86400).cast("int").cast("string"), F.lit("d ago")))
    return out.withColumn("ago", ago).orderBy(F.desc("seq")).limit(k)
