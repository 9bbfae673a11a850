"""Stateful streams held against batch, over all events, after restarts and replays."""

import json
import time
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from prosemetrics.operators import history
from prosemetrics.sources import event_log
from prosemetrics.streaming import history_stream

SF = "/root/testdata/sf0.001"


def log(spark):
    """All events of the table as a log of gate decisions, two logs, a null file and time among them."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    action = F.when((F.col("event_id") % 3 < 2) & (F.col("event_id") % 120 < 60), "deny").when(F.col("event_id") % 5 == 0, "auto_fix").otherwise("clean")
    kinds = F.when(F.col("event_id") % 4 > 0, F.array(F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 41 != 0, (F.floor(F.col("event_id") / 30) * 400 + F.col("event_id") % 30 * 0.3).cast("double")).alias("ts"), action.alias("action"),
        F.when(F.col("user_id") % 9 != 0, (F.col("user_id") % 4).cast("string")).alias("file"), kinds.alias("kinds"), F.when(F.col("event_id") % 2 == 0, "prose").otherwise("code").alias("ruleset"),
    )


def in_batch(events):
    """The same by windows: runs of denials of a file, the row before, the last twenty."""
    w = Window.partitionBy("ruleset").orderBy("seq")
    of_file = Window.partitionBy("ruleset", "file").orderBy("seq")
    others = F.sum((F.col("action") != "deny").cast("int")).over(of_file)
    rows = events.withColumn("stretch", others)
    streak = F.sum((F.col("action") == "deny").cast("long")).over(Window.partitionBy("ruleset", "file", "stretch").orderBy("seq"))
    ts = F.coalesce("ts", F.lit(0.0))
    again = (F.lag("file").over(w) == F.col("file")) & (F.lag("action").over(w) == F.col("action")) & (ts - F.lag(ts).over(w) < history.DOUBLE_FIRE_SECONDS)
    rows = rows.withColumns({"streak": F.when(F.col("file").isNotNull(), streak), "double_fire": F.coalesce(again, F.lit(False))})
    near = history.recent_deny(events, ("ruleset",)).select("seq", "nearby_deny")
    return rows.join(near, "seq").select(F.col("ruleset").alias("log"), "seq", "file", "action", "streak", (F.col("streak") >= history.RETRY_CAP).alias("capped"), "nearby_deny", "double_fire")


def test_one_processor_gives_streaks_recency_and_double_fires_after_restarts(spark, tmp_path):
    events = log(spark).filter("seq < 600")
    for i in range(3):  # the log grows, the stream starts anew each time
        event_log.append_events(events.filter(F.col("seq").between(i * 200, i * 200 + 199)), f"file:{tmp_path}/log")
        out = history_stream.decision_history(event_log.stream_events(spark, f"file:{tmp_path}/log"))
        q = out.writeStream.format("parquet").option("path", f"file:{tmp_path}/out").option("checkpointLocation", f"file:{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got, want = spark.read.parquet(f"file:{tmp_path}/out"), in_batch(events)
    assert got.count() == events.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.filter("double_fire").count() and got.filter("capped").count() and got.filter("not nearby_deny").count()


def test_streaks_expire(spark, tmp_path):
    rows = [(i, float(i), "deny", "a", ["k"], "prose") for i in range(4)]
    events = spark.createDataFrame(rows, history.EVENT)
    event_log.append_events(events.filter("seq < 2"), f"file:{tmp_path}/log")
    stream = event_log.stream_events(spark, f"file:{tmp_path}/log")
    out = history_stream.decision_history(stream, forget=timedelta(milliseconds=1))
    q = out.writeStream.format("memory").queryName("forgetful").option("checkpointLocation", f"file:{tmp_path}/c").trigger(processingTime="0 seconds").start()

    def wait(n):  # the stream never rests, since state may expire at any time
        end = time.time() + 60
        while spark.sql("select * from forgetful").count() < n and time.time() < end:
            time.sleep(0.5)

    wait(2)
    event_log.append_events(events.filter("seq >= 2"), f"file:{tmp_path}/log")
    wait(4)
    q.stop()
    assert {r["seq"]: r["streak"] for r in spark.sql("select * from forgetful").collect()} == {0: 1, 1: 2, 2: 1, 3: 2}


def test_summary_of_fifty_batches_keeps_two_generations(spark, tmp_path):
    events = log(spark).filter("seq < 500").persist()
    rows = [r.asDict() for r in events.collect()]
    (tmp_path / "log").mkdir()
    def put(i):
        (tmp_path / "log" / f"{i:03}.json").write_text("\n".join(json.dumps(r) for r in rows[i * 10 : i * 10 + 10]))

    def run():
        stream = spark.readStream.schema(event_log.SCHEMA).option("maxFilesPerTrigger", 1).json(f"file:{tmp_path}/log")
        q = history_stream.keep_summary(stream, f"file:{tmp_path}/sum", f"file:{tmp_path}/c")
        q.awaitTermination()

    for i in range(49):
        put(i)
    run()
    assert len(history_stream._generations(spark, f"file:{tmp_path}/sum/sums")) <= 2
    # The last batch again, as after a failure before its end was noted.
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    put(49)
    run()
    got = spark.read.parquet(f"file:{tmp_path}/sum/summary").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, history.top_kinds(events).collect()))
    assert len(history_stream._generations(spark, f"file:{tmp_path}/sum/sums")) <= 2
