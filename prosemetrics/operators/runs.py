"""A whole run of an experiment: all arms over all prompts, step by step, saved so that it can go on.

A run is a table of calls (arm, prompt, step). In a step every arm that has something to ask
asks at once, so the generator sees all prompts of all arms together. A step's table alone
says what the next one asks: a run that stopped starts again after its last whole step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checks.base import Ruleset
from ..plans.registry import ruleset
from .arms import BLIND_REVISION, MESSAGES, message
from .experiment import message_digest
from .lint import flag_arrays, merged_array

#: Into how many parts the calls of one message list are dealt to be numbered.
PARTS = 64
STEP = (
    "arm string, arm_ord int, prompt_id string, gated boolean, blind boolean, instruction string, follow_ups array<string>, "
    f"turn int, in_turn int, history {MESSAGES}, messages {MESSAGES}, digest string, occurrence long, text string, flags long, total long, note string"
)
Ask = Callable[[DataFrame], DataFrame]


def lint_judge(rules: str | Ruleset, enforced: list[str], context: dict | None = None, **options) -> Ask:
    """A judge by a ruleset: call_id, flags (enforced ones), total (all), note (a line an enforced flag). Semantic flags count, merged.

    One projection: no shuffle.
    """
    rules = ruleset(rules)

    def judge(rows: DataFrame) -> DataFrame:
        found = flag_arrays(rows, rules, context, key="call_id", **options)
        kinds = F.transform(F.filter(merged_array(F.col("found"), rules), lambda m: ~m["flag"]["mechanical"]), lambda m: m["flag"])
        found = found.select("call_id", kinds.alias("all"))
        on = F.filter("all", lambda f: f["kind"].isin(*enforced) if enforced else F.lit(False))
        said = F.transform("on", lambda f: F.concat(F.lit("- "), f["kind"], F.lit(": "), F.coalesce(f["hit"]["label"], f["text"], F.lit(""))))
        found = found.select("call_id", F.size("all").cast("long").alias("total"), on.alias("on"))
        return found.select("call_id", F.size("on").cast("long").alias("flags"), "total", F.array_join(said, "\n").alias("note"))

    return judge


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never broadcast: both sides grow with the prompts, and what the files of a step weigh says little of their rows."""
    return left.join(right.hint("merge"), on, how)


def recorded(recordings: DataFrame, otherwise: Ask | None = None) -> Ask:
    """A generator that answers from recordings (digest, occurrence, output); what they lack is asked of ``otherwise``."""
    known = recordings.select("digest", F.col("occurrence").cast("long").alias("occurrence"), F.col("output").alias("text"))

    def ask(calls: DataFrame) -> DataFrame:
        have = _met(calls, known, ["digest", "occurrence"]).select("call_id", "text")
        if otherwise is None:
            return have
        return have.unionByName(otherwise(_met(calls, known, ["digest", "occurrence"], "left_anti")).select("call_id", "text"))

    return ask


def _arms(instructions: dict[str, str], combined) -> list[tuple]:
    """(arm, gated, blind, instruction), in the order in which the calls of one prompt count."""
    unknown = [c for c in combined if c not in instructions]
    if unknown:
        raise ValueError(f"no instruction named {', '.join(unknown)}")
    told = [(name, False, False, text) for name, text in instructions.items()]
    both = [(f"{name}+gated", True, False, instructions[name]) for name in combined]
    return [("ungated", False, False, ""), ("control", False, False, ""), *told, ("gated", True, False, ""), *both, ("blind", False, True, "")]


def first_calls(prompts: DataFrame, instructions: dict[str, str] | None = None, combined=()) -> DataFrame:
    """The calls that open a run. prompts: prompt_id, prompt and perhaps turns (array of follow-up requests).

    The blind arm of a prompt with turns is told to rewrite at each of them instead. A null
    prompt counts as empty; rows without an id take no part.
    """
    names = _arms(dict(instructions or {}), combined)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).alias("arm_ord"), F.lit(g).alias("gated"), F.lit(b).alias("blind"), F.lit(t).alias("instruction")) for i, (a, g, b, t) in enumerate(names)])
    turns = F.coalesce(F.col("turns"), F.array().cast("array<string>")) if "turns" in prompts.columns else F.array().cast("array<string>")
    rows = prompts.filter("prompt_id is not null").select(F.col("prompt_id").cast("string").alias("prompt_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), turns.alias("turns"), F.explode(arms).alias("a"))
    rewrites = F.transform("turns", lambda _: F.lit(BLIND_REVISION))
    opening = F.array(message("user", F.concat("a.instruction", "prompt"))).cast(MESSAGES)
    return rows.select(
        "a.arm", "a.arm_ord", "prompt_id", "a.gated", "a.blind", "a.instruction", F.when(F.col("a.blind"), rewrites).otherwise(F.col("turns")).alias("follow_ups"),
        F.lit(0).alias("turn"), F.lit(1).alias("in_turn"), opening.alias("history"), opening.alias("messages"),
    )


def next_calls(step: DataFrame, rounds: int, revise: Callable[[Column], Column]) -> DataFrame:
    """What a step's rows ask next: a revision while a gated text has flags, else the next turn, else nothing.

    Matched compute: a blind arm without turns rewrites whenever the gated arm of its prompt revises.
    """
    again = F.col("gated") & (F.col("flags") > 0) & (F.col("in_turn") < rounds)
    more = F.col("turn") < F.size("follow_ups")
    said = lambda request: F.concat("history", F.array(message("assistant", F.col("text")), message("user", request)).cast(MESSAGES))
    request = F.concat("instruction", F.get("follow_ups", F.col("turn")))
    carried = ("arm", "arm_ord", "prompt_id", "gated", "blind", "instruction", "follow_ups")
    revised = step.filter(again).select(*carried, "turn", (F.col("in_turn") + 1).alias("in_turn"), "history", said(revise(F.col("note"))).alias("messages"))
    onward = step.filter(~again & more).select(*carried, (F.col("turn") + 1).alias("turn"), F.lit(1).alias("in_turn"), said(request).alias("history"), said(request).alias("messages"))
    spends = step.filter(again & (F.col("arm") == "gated")).select("prompt_id")
    blind = _met(step.filter(F.col("blind") & (F.size("follow_ups") == 0)), spends, "prompt_id", "left_semi")
    blind = blind.select(*carried, "turn", (F.col("in_turn") + 1).alias("in_turn"), "history", said(F.lit(BLIND_REVISION)).alias("messages"))
    return revised.unionByName(onward).unionByName(blind)


def numbered(calls: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``calls`` with digest and occurrence: how often their message list was asked before in the run.

    By prompt and arm inside each of ``PARTS`` parts of the prompts, part after part: a list
    that very many prompts share is numbered by many tasks. earlier: digest, occurrence.
    """
    keyed = calls.withColumns({"digest": message_digest(F.col("messages")), "part": F.pmod(F.xxhash64("prompt_id"), F.lit(PARTS))})
    counts = keyed.groupBy("digest", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("digest", "part", before.alias("start"))
    if earlier is not None:
        asked = earlier.groupBy("digest").agg((F.max("occurrence") + 1).alias("asked"))
        starts = _met(starts, asked, "digest", "left").select("digest", "part", (F.col("start") + F.coalesce("asked", F.lit(0))).alias("start"))
    nth = F.row_number().over(Window.partitionBy("digest", "part").orderBy("prompt_id", "arm_ord")) - 1
    return _met(keyed.withColumn("nth", nth), starts, ["digest", "part"]).withColumn("occurrence", (F.col("nth") + F.col("start")).cast("long")).drop("part", "nth", "start")


def _whole_steps(spark: SparkSession, path: str) -> int:
    """How many steps of the run are whole."""
    try:
        last = spark.read.schema("step int").parquet(f"{path}/whole").agg(F.max("step")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return 0 if last is None else last + 1


def _step(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema(STEP).parquet(f"{path}/calls/step={n}")


def calls_of(spark: SparkSession, path: str) -> DataFrame:
    """All calls of the whole steps of a run, with their step."""
    n = _whole_steps(spark, path)
    if n == 0:
        return spark.createDataFrame([], STEP + ", step int")
    return spark.read.schema(STEP + ", step int").option("basePath", f"{path}/calls").parquet(*[f"{path}/calls/step={i}" for i in range(n)])


def run(prompts: DataFrame, generate: Ask, judge: Ask, path: str, *, instructions: dict[str, str] | None = None, combined=(), rounds: int = 4, revise: Callable[[Column], Column] | None = None) -> DataFrame:
    """arm, prompt_id, text, iterations, passed, flags, total: every arm over every prompt, kept under ``path``.

    generate(call_id, messages, digest, occurrence) gives call_id and text; judge(call_id,
    text) gives call_id, flags, total and note. Arms: ungated, control, one an instruction,
    gated, those of ``combined`` told and gated, and blind. A gated text is revised until it
    has no flags, ``rounds`` generations a turn at most.

    Each step is written before the next; one that stands whole is never asked again, so
    running a stopped run once more goes on where it stopped. A call that the generator does
    not answer is an error, and its step doesn't count. passed is null for arms without a gate.
    """
    spark = prompts.sparkSession
    revise = revise or (lambda note: F.concat(F.lit("Revise the text above.\n"), note))
    n = _whole_steps(spark, path)
    while True:
        calls = first_calls(prompts, instructions, combined) if n == 0 else next_calls(_step(spark, path, n - 1), rounds, revise)
        if n > 0 and calls.isEmpty():
            return results(spark, path)
        asked = numbered(calls, calls_of(spark, path).select("digest", "occurrence") if n else None)
        asked = asked.withColumn("call_id", F.concat_ws("\x1f", "arm", "prompt_id"))
        said = _met(asked, generate(asked.select("call_id", "messages", "digest", "occurrence")).select("call_id", "text"), "call_id", "left")
        # The answers are kept before they are judged: a generator is asked once.
        said.write.mode("overwrite").parquet(f"{path}/answers/step={n}")
        said = spark.read.schema(said.schema).parquet(f"{path}/answers/step={n}")
        open_ = said.filter("text is null").count()
        if open_:
            raise ValueError(f"{open_} calls of step {n} have no answer")
        judged = _met(said, judge(said.select("call_id", "text")).select("call_id", "flags", "total", "note"), "call_id", "left").fillna(0, ["flags", "total"]).fillna("", ["note"])
        names = [f.name for f in spark.createDataFrame([], STEP).schema]
        judged.select(*names).write.mode("overwrite").parquet(f"{path}/calls/step={n}")
        spark.createDataFrame([(n,)], "step int").coalesce(1).write.mode("append").parquet(f"{path}/whole")
        n += 1


def results(spark: SparkSession, path: str) -> DataFrame:
    """One row an arm and prompt: its last text. An arm that asks goes on asking at every step, so iterations is that step's number."""
    calls = calls_of(spark, path)
    last = calls.groupBy("arm", "prompt_id").agg(F.max("step").alias("step"))
    out = _met(calls, last, ["arm", "prompt_id", "step"])
    passed = F.when(F.col("gated"), F.col("flags") == 0)
    return out.select("arm", "prompt_id", "text", (F.col("step") + 1).alias("iterations"), passed.alias("passed"), "flags", "total")


def turns_of(spark: SparkSession, path: str) -> DataFrame:
    """arm, prompt_id, turn, enforced_flags, total: what was left after each turn."""
    last = F.struct("flags", "total")
    out = calls_of(spark, path).groupBy("arm", "prompt_id", "turn").agg(F.max_by(last, "in_turn").alias("v"))
    return out.select("arm", "prompt_id", "turn", F.col("v.flags").alias("enforced_flags"), F.col("v.total").alias("total"))


def recordings_of(spark: SparkSession, path: str) -> DataFrame:
    """digest, occurrence, messages, output: what :func:`recorded` replays."""
    return calls_of(spark, path).select("digest", "occurrence", "messages", F.col("text").alias("output"))
