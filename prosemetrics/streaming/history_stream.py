"""The event log as a stream: double fires, deny streaks and summaries kept up to date."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import DOUBLE_FIRE_SECONDS, NEARBY_ROWS, NEARBY_SECONDS, RETRY_CAP
from ..sources.event_log import swap_in


def deny_streaks(events: DataFrame, output: str = "append") -> DataFrame:
    """file, seq, streak, capped after every event, with one number of state a file."""

    def update(key, batches, state: GroupState):
        streak = state.get[0] if state.exists else 0
        rows = []
        for p in batches:
            for seq, action in zip(p["seq"], p["action"]):
                rows.append((seq, action))
        out = []
        for seq, action in sorted(rows):
            streak = streak + 1 if action == "deny" else 0
            out.append((key[0], seq, streak, streak >= RETRY_CAP))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["file", "seq", "streak", "capped"])

    return events.filter(F.col("file").isNotNull()).groupBy("file").applyInPandasWithState(update, "file string, seq long, streak long, capped boolean", "streak long", output, GroupStateTimeout.NoTimeout)


def without_double_fires(events: DataFrame, by: str = "file") -> DataFrame:
    """seq, ts, action, file of events that do not repeat the one before, less than two seconds later.

    The batch form compares with the row before in the whole log, which needs one order
    for all; here the row before is that of the same ``by``, so that files run in parallel.
    Group by a constant column to get the batch form's answer.
    """

    def update(key, batches, state: GroupState):
        last = state.get if state.exists else (None, None, 0.0)
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = []
        for r in rows.itertuples(index=False):
            ts = 0.0 if pd.isna(r.ts) else float(r.ts)
            keep.append(not (r.file is not None and last[0] == r.file and last[1] == r.action and ts - last[2] < DOUBLE_FIRE_SECONDS))
            last = (r.file, r.action, ts)
        state.update(last)
        yield rows[keep][["seq", "ts", "action", "file"]]

    return events.groupBy(by).applyInPandasWithState(update, "seq long, ts double, action string, file string", "file string, action string, ts double", "append", GroupStateTimeout.NoTimeout)


def recent_denials(events: DataFrame, by: str = "ruleset") -> DataFrame:
    """seq, nearby_deny of each event: whether one of the last 20 events of its ``by``, itself included, denied less than 300 seconds before.

    The state is those events' times; group by a constant column for one log.
    """

    def update(key, batches, state: GroupState):
        times = list(state.get[0]) if state.exists else []
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for r in rows.itertuples(index=False):
            ts = 0.0 if pd.isna(r.ts) else float(r.ts)
            times = [*times, ts if r.action == "deny" else float("-inf")][-NEARBY_ROWS:]
            out.append((r.seq, ts - max(times) < NEARBY_SECONDS))
        state.update((times,))
        yield pd.DataFrame(out, columns=["seq", "nearby_deny"])

    return events.groupBy(by).applyInPandasWithState(update, "seq long, nearby_deny boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)


HISTORY = "log string, seq long, file string, action string, streak long, capped boolean, nearby_deny boolean, double_fire boolean"


class _Log(StatefulProcessor):
    """State of one log: its last event, the times of its last denials, and the streak of each file, which may expire."""

    def __init__(self, forget: timedelta | None):
        self.forget = None if forget is None else int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "file string, action string, ts double")
        self.times = handle.getListState("times", "ts double")
        self.streaks = handle.getMapState("streaks", "file string", "streak long", self.forget)

    def handleInputRows(self, key, rows, timerValues):
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last = self.last.get() if self.last.exists() else None
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        known: dict[str, int] = {}
        out = []
        for r in given.itertuples(index=False):
            ts = 0.0 if pd.isna(r.ts) else float(r.ts)
            file, action = (None if pd.isna(x) else x for x in (r.file, r.action))
            again = last is not None and file is not None and (last[0], last[1]) == (file, action) and ts - last[2] < DOUBLE_FIRE_SECONDS
            times = [*times, ts if action == "deny" else float("-inf")][-NEARBY_ROWS:]
            streak = None
            if file is not None:
                if file not in known:
                    known[file] = self.streaks.getValue((file,))[0] if self.streaks.containsKey((file,)) else 0
                streak = known[file] = known[file] + 1 if action == "deny" else 0
            out.append((key[0], r.seq, file, action, streak, None if streak is None else streak >= RETRY_CAP, ts - max(times) < NEARBY_SECONDS, again))
            last = (file, action, ts)
        self.last.update(last)
        self.times.put([(t,) for t in times])
        for file, streak in known.items():
            if streak:
                self.streaks.updateValue((file,), (streak,))
            elif self.streaks.containsKey((file,)):
                self.streaks.removeKey((file,))
        columns = [c.split()[0] for c in HISTORY.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"streak": "Int64", "capped": "boolean"})

    def close(self) -> None:
        pass


def decision_history(events: DataFrame, by: str = "ruleset", forget: timedelta | None = None) -> DataFrame:
    """``HISTORY`` of each event: its file's streak of denials after it, whether the log denied nearby, whether it is a double fire.

    One stateful operator for all three: a value, a list of twenty and a map, a log each
    (``by``; a constant column for one log). State holds the files that are being denied, not
    all there ever were; with ``forget`` a file's streak also expires so long after its last
    denial, by the clock of the machine, and the stream then wants a trigger that goes on (one
    of ``availableNow`` would never find its state clean). An event without a file has no streak. The session's state store becomes RocksDB, which
    this operator needs; streams begun before keep theirs.
    """
    conf = events.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("log"), "seq", F.col("ts").cast("double").alias("ts"), "file", "action")
    return rows.groupBy("log").transformWithStateInPandas(_Log(forget), HISTORY, "Append", "None" if forget is None else "ProcessingTime")


_SUMS = "kind string, hits long, first_seq long"


def _generations(spark, path: str) -> list[int]:
    """Numbers of the generations of sums at ``path`` that are whole, oldest first."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(of(path)):
        return []
    names = [str(s.getPath().getName()) for s in system.listStatus(of(path))]
    return sorted(int(n.removeprefix("to=")) for n in names if n.startswith("to=") and system.exists(of(f"{path}/{n}/_SUCCESS")))


def keep_summary(events: DataFrame, path: str, checkpoint: str, k: int = 5):
    """Keeps the top kinds at ``path/summary`` up to date.

    ``path/sums/to=n`` holds the sums by kind of all batches up to number n. A batch adds its
    own sums to the generation before it and leaves a new one; one that is tried again starts
    from the same generation, so nothing counts twice. Generations before that one go. So a
    batch reads and writes one row a kind besides its events, however many batches there were.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [g for g in _generations(spark, f"{path}/sums") if g < number]
        sums = batch.select("seq", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("hits"), F.min("seq").alias("first_seq"))
        if before:
            sums = sums.unionByName(spark.read.schema(_SUMS).parquet(f"{path}/sums/to={before[-1]}"))
        total = sums.groupBy("kind").agg(F.sum("hits").alias("hits"), F.min("first_seq").alias("first_seq"))
        total.write.mode("overwrite").parquet(f"{path}/sums/to={number}")
        whole = spark.read.schema(_SUMS).parquet(f"{path}/sums/to={number}")
        swap_in(whole.orderBy(F.desc("hits"), "first_seq", "kind").limit(k), f"{path}/summary")
        of = spark._jvm.org.apache.hadoop.fs.Path
        for g in before[:-1]:
            of(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(of(f"{path}/sums/to={g}"), True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by action and tumbling window of their time, for late data up to ``late``. An addition of ours."""
    timed = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "action").agg(F.count("*").alias("events"))
