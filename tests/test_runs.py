import math

import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import arms, corpus, experiment, report, runs

PROMPTS = [("p1", "bad bad text", None), ("p2", "good text", None), ("p3", "bad bad bad bad bad", None), ("p4", "bad start", ["more", "bad end"]), ("p5", None, None), ("p6", "good text", [])]


def prompts(spark):
    return spark.createDataFrame(PROMPTS, "prompt_id string, prompt string, turns array<string>")


def generate(calls):
    """Echoes the request; a revision leaves out one bad word."""
    last, text = F.element_at("messages", -1)["content"], F.get("messages", F.size("messages") - 2)["content"]
    fewer = F.regexp_replace(text, r"^(.*?)bad ?", "$1")
    revised = F.when(last.startswith("Revise"), fewer).when(last == arms.BLIND_REVISION, text).otherwise(last)
    return calls.select("call_id", F.when(F.size("messages") == 1, last).otherwise(revised).alias("text"))


def judge(rows):
    n = F.regexp_count("text", F.lit("bad")).cast("long")
    return rows.select("call_id", n.alias("flags"), (n + 1).alias("total"), F.lit("no bad").alias("note"))


def expected(rounds=4):
    """A run in plain Python: (arm, prompt) to (text, iterations, passed, flags)."""
    out, gated_calls = {}, {}
    told = {"ungated": "", "control": "", "told": "Be good. ", "gated": "", "told+gated": "Be good. ", "blind": ""}
    for pid, prompt, turns in PROMPTS:
        for arm, instruction in told.items():
            asked = [arms.BLIND_REVISION if arm == "blind" else t for t in turns or []]
            calls = 0
            for i, request in enumerate([prompt or "", *asked]):
                text = text if request == arms.BLIND_REVISION and i else instruction + request  # noqa: F821
                calls, spent = calls + 1, 1
                while arm in ("gated", "told+gated") and "bad" in text and spent < rounds:
                    text, calls, spent = text.replace("bad ", "", 1) if "bad " in text else text.replace("bad", "", 1), calls + 1, spent + 1
            if arm == "gated":
                gated_calls[pid] = calls
            if arm == "blind" and not turns:
                calls = gated_calls[pid]
            out[arm, pid] = (text, calls, text.count("bad") == 0 if arm in ("gated", "told+gated") else None, text.count("bad"))
    return out


def told(frame):
    return {(r["arm"], r["prompt_id"]): (r["text"], r["iterations"], r["passed"], r["flags"]) for r in frame.collect()}


def test_a_run_that_stops_goes_on(spark, tmp_path):
    options = {"instructions": {"told": "Be good. "}, "combined": ("told",)}
    whole = runs.run(prompts(spark), generate, judge, str(tmp_path / "whole"), **options)
    assert told(whole) == expected()

    path, asked = str(tmp_path / "stopped"), []

    def fails_at(step):
        def ask(calls):
            asked.append(calls.count())
            if len(asked) == step:
                raise RuntimeError("the machine went away")
            return generate(calls)

        return ask

    with pytest.raises(RuntimeError):
        runs.run(prompts(spark), fails_at(3), judge, path, **options)
    assert runs.calls_of(spark, path).agg(F.max("step")).first()[0] == 1
    with pytest.raises(ValueError, match="no answer"):  # an answer that is missing is no step
        runs.run(prompts(spark), lambda c: generate(c).filter("call_id not like 'gated%'"), judge, path, **options)
    again = runs.run(prompts(spark), fails_at(0), judge, path, **options)
    assert told(again) == told(whole)
    per_step = [r["count"] for r in runs.calls_of(spark, str(tmp_path / "whole")).groupBy("step").count().orderBy("step").collect()]
    assert asked == [*per_step[:3], *per_step[2:]]  # the first two steps were asked once
    before = len(asked)
    assert told(runs.run(prompts(spark), fails_at(0), judge, path, **options)) == told(whole) and len(asked) == before


def test_calls_are_numbered_over_the_run(spark, tmp_path):
    path = str(tmp_path / "run")
    runs.run(prompts(spark), generate, judge, path)
    calls = runs.calls_of(spark, path).collect()
    by = {}
    for r in calls:
        by.setdefault(r["digest"], []).append((r["occurrence"], r["step"]))
    assert all(sorted(o for o, _ in v) == list(range(len(v))) for v in by.values())
    assert all(sorted(v) == sorted(v, key=lambda x: (x[1], x[0])) for v in by.values())  # earlier steps come first
    first = {(r["arm"], r["occurrence"]) for r in calls if r["prompt_id"] == "p1" and r["step"] == 0}
    assert first == {("ungated", 0), ("control", 1), ("gated", 2), ("blind", 3)}
    shared = [r["occurrence"] for r in calls if r["prompt_id"] in ("p2", "p6") and r["step"] == 0]  # two prompts that ask the same
    assert sorted(shared) == list(range(8))
    replayed = runs.run(prompts(spark), runs.recorded(runs.recordings_of(spark, path)), judge, str(tmp_path / "replay"))
    assert told(replayed) == told(runs.results(spark, path))
    turns = {(r["arm"], r["turn"]): r["enforced_flags"] for r in runs.turns_of(spark, path).filter("prompt_id = 'p4'").collect()}
    assert turns["ungated", 0] == 1 and turns["ungated", 2] == 1 and turns["gated", 2] == 0 and ("blind", 2) in turns


def test_an_empty_run_and_odd_prompts(spark, tmp_path):
    none = spark.createDataFrame([], "prompt_id string, prompt string")
    assert runs.run(none, generate, judge, str(tmp_path / "none")).count() == 0
    odd = spark.createDataFrame([(None, "x", 1), ("a", "bad", 2)], "prompt_id string, prompt string, text int")
    assert {r["prompt_id"] for r in runs.run(odd, generate, judge, str(tmp_path / "odd")).collect()} == {"a"}
    with pytest.raises(ValueError):
        runs.run(odd, generate, judge, str(tmp_path / "bad"), combined=("nothing",))


def test_judge_by_a_ruleset(spark):
    rows = spark.createDataFrame([("a", "It is very very robust."), ("b", None), ("c", "It is robust.")], "call_id string, text string")
    got = {r["call_id"]: (r["flags"], r["total"], r["note"]) for r in runs.lint_judge("prose", ["vague_intensifier"])(rows).collect()}
    assert got == {"a": (1, 2, "- vague_intensifier: very"), "b": (0, 0, ""), "c": (0, 1, "")}


def test_resuming_counts_equal_requests(spark):
    asked = spark.createDataFrame([(p, [("user", "same")]) for p in ("a", "b", "c")], f"prompt_id string, messages {arms.MESSAGES}")
    digest = asked.select(experiment.message_digest(F.col("messages"))).first()[0]
    known = spark.createDataFrame([(digest, 0, "first"), (digest, 1, "second")], "digest string, occurrence int, output string")
    saved = []
    answer = arms.resuming(lambda rows: rows.select("prompt_id", F.lit("new").alias("text")), known, save=lambda df: saved.extend(df.collect()))
    assert {r["prompt_id"]: r["text"] for r in answer(asked).collect()} == {"a": "first", "b": "second", "c": "new"}
    assert [(r["digest"], r["occurrence"], r["output"]) for r in saved] == [(digest, 2, "new")]


ROWS = "arm string, prompt_id string, turn int, iterations int, passed boolean, words long, enforced_flags long, held_out_flags long"


def test_report(spark, tmp_path):
    rows = [
        ("ungated", "a", None, 1, None, 100, 4, 2), ("ungated", "b", None, 1, None, 50, 0, 1), ("control", "a", None, 1, None, 90, 3, 2), ("control", "b", None, 1, None, 50, 1, None),
        ("gated", "a", None, 3, True, 80, 0, 1), ("gated", "b", None, 1, True, 60, 0, 1), ("gated", "a", 0, None, None, 0, 4, 0), ("gated", "a", 2, None, None, 0, 1, 0), ("gated", "b", 0, None, None, 0, 2, 0),
    ]
    total = report.totals(spark.createDataFrame(rows, ROWS))
    by = {(r["scope"], r["arm"], r["turn"]): r for r in total.collect()}
    assert len(by) == 8 and by["all", "ungated", None]["enforced_flags"] == 4 and by["all", "ungated", None]["prompts"] == 2
    assert by["revised", "ungated", None]["words"] == 100 and by["revised", "gated", None]["prompts"] == 1
    assert by["all", "gated", None]["generations"] == 2 and by["all", "gated", None]["passed"] == 2 and by["all", "gated", None]["revised"] == 1
    assert by["all", "control", None]["mean_held_out_flags"] == 2
    wide = {(r["scope"], r["metric"]): r for r in report.comparison(total, {"enforced_flags": True, "words": False}).collect()}
    one = wide["revised", "enforced_flags"]
    assert (one["ungated"], one["gated"], one["change"], one["percent"], one["direction"], one["noise"], one["finding"], one["blind"]) == (4, 0, -4, -100, "better", 1, True, None)
    assert wide["revised", "words"]["direction"] == "WORSE" and wide["all", "words"]["finding"] is False
    assert [(r["arm"], r["total"], r["percent"]) for r in report.board(total, "enforced_flags").orderBy("rank").collect()] == [("gated", 0, -100), ("control", 4, 0), ("ungated", 4, 0)]
    assert [tuple(r) for r in report.drift_table(total, "enforced_flags").collect()] == [("gated", [6.0, 1.0], -5.0)]
    path = str(tmp_path / "report")
    for name in ("one", "two", "one"):
        report.save_report(total, path, name)
    assert {r["run"]: r["count"] for r in spark.read.parquet(path).groupBy("run").count().collect()} == {"one": 8, "two": 8}
    assert report.totals(spark.createDataFrame([], ROWS)).count() == 0


def test_merged_bootstrap_agrees_with_the_exact_one(spark):
    rows = [("r", f"p{i}", 0.0, math.sin(i) + 0.2) for i in range(400)] + [("s", f"p{i}", float(i % 7), float(i % 5)) for i in range(300)]
    pairs = spark.createDataFrame(rows, "run string, prompt_id string, a double, b double")
    exact = {r["run"]: r for r in experiment.bootstrap(pairs, draws=4000).collect()}
    merged = {r["run"]: r for r in experiment.bootstrap_merged(pairs, draws=4000).collect()}
    for run, e in exact.items():
        m, width = merged[run], e["high"] - e["low"]
        assert m["mean"] == pytest.approx(e["mean"]) and abs(m["low"] - e["low"]) < 0.06 * width and abs(m["high"] - e["high"]) < 0.06 * width
        assert abs(m["favour"] - e["favour"]) < 0.03
    parted = {r["run"]: r for r in experiment.bootstrap_merged(pairs.repartition(5), draws=4000).collect()}
    assert all(parted[k]["low"] == pytest.approx(m["low"]) and parted[k]["high"] == pytest.approx(m["high"]) for k, m in merged.items())
    odd = spark.createDataFrame([(None, "a", 1.0, 3.0), (None, "b", 1.0, 3.0)], "run string, prompt_id string, a double, b double")
    assert [tuple(r) for r in experiment.bootstrap_merged(odd, draws=200).collect()] == [(None, 2.0, 2.0, 2.0, 1.0)]
    assert experiment.bootstrap_merged(odd.limit(0), draws=200).count() == 0


def test_weights_are_poisson():
    import numpy as np

    w = experiment._poisson(np.arange(-500, 500, dtype=np.int64), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.shape == (1000, 200)
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.3 and (w[3:4] == experiment._poisson(np.array([-497]), 200)).all()


def test_manifest_is_a_tree_of_exact_ranges(spark):
    import hashlib

    rows = [(i, f"text {i}", "s" if i % 3 else None) for i in range(250)] + [(7, "text 7", "s"), (7, "again", "s"), (9, None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def tree(digests, n):
        return sha("".join(digests)) if len(digests) <= n else tree([sha("".join(digests[i : i + n])) for i in range(0, len(digests), n)], n)

    for n in (5, 10, 1000):
        want = {}
        for source in ("s", None, "one"):
            mine = sorted((i, sha(f"{s or ''}\n{t or ''}")) for i, t, s in rows if s == source)
            want[source] = (len(mine), tree([d for _, d in mine], n))
        for parted in (docs, docs.repartition(7, "text"), docs.coalesce(1)):
            assert {r["source"]: (r["documents"], r["sha256"]) for r in corpus.manifest(parted, per_range=n).collect()} == want
    assert corpus.manifest(docs.limit(0)).count() == 0


def test_no_join_of_a_run_is_broadcast(spark, tmp_path):
    """Both sides of each grow with the prompts; a driver that collects one for a broadcast runs out of memory."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    path = str(tmp_path / "run")
    out = runs.run(prompts(spark), generate, judge, path)
    step, earlier = runs._step(spark, path, 0), runs.calls_of(spark, path).select("digest", "occurrence")
    asked = runs.numbered(runs.next_calls(step, 4, lambda note: note), earlier)
    replayed = runs.recorded(runs.recordings_of(spark, path), generate)(asked.withColumn("call_id", F.col("prompt_id")))
    for df in (out, asked, replayed):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)
