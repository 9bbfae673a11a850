"""Arms of an experiment over prompts. Text comes from a generator that the caller gives.

A generator takes rows (prompt_id, messages: array<struct<role, content>>) and gives
prompt_id and text. All prompts of a step are asked at once; a step waits for the one
before it, since its messages hold that one's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .experiment import message_digest

MESSAGES = "array<struct<role:string,content:string>>"
# What the blind arm is told.
BLIND_REVISION = "Rewrite the text above. Keep the same length and the same purpose. Return only the rewritten text."
Generate = Callable[[DataFrame], DataFrame]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def single(prompts: DataFrame, generate: Generate, instruction: str = "", cut=_cut) -> DataFrame:
    """prompt_id, text, iterations, passed: one generation a prompt. The control arm is this arm once more."""
    asked = prompts.select("prompt_id", F.array(message("user", F.concat(F.lit(instruction), "prompt"))).cast(MESSAGES).alias("messages"))
    return cut(generate(asked).select("prompt_id", "text", F.lit(1).alias("iterations"), F.lit(None).cast("boolean").alias("passed")))


def blind(prompts: DataFrame, generate: Generate, spent: DataFrame, cut=_cut) -> DataFrame:
    """As many generations as another arm ``spent`` (prompt_id, iterations), told only to rewrite."""
    rows = single(prompts, generate, cut=cut).select("prompt_id", "text").join(prompts, "prompt_id").join(spent.select("prompt_id", "iterations"), "prompt_id")
    for i in range(2, (spent.agg(F.max("iterations")).first()[0] or 1) + 1):
        more = rows.filter(F.col("iterations") >= i)
        asked = more.select("prompt_id", F.array(message("user", F.col("prompt")), message("assistant", F.col("text")), message("user", F.lit(BLIND_REVISION))).cast(MESSAGES).alias("messages"))
        new = generate(asked).select("prompt_id", F.col("text").alias("new"))
        rows = cut(rows.join(new, "prompt_id", "left").withColumn("text", F.coalesce("new", "text")).drop("new"))
    return rows.select("prompt_id", "text", "iterations", F.lit(None).cast("boolean").alias("passed"))


def turns(prompts: DataFrame, requests: list[str], generate: Generate, judge: Callable[[DataFrame], DataFrame], *, instruction: str = "", gate_rounds: int = 1, revise: Callable[[DataFrame], Column] | None = None, cut=_cut) -> DataFrame:
    """prompt_id, text, iterations, passed, per_turn: a document's whole life, scored after every turn.

    judge(prompt_id, text) gives prompt_id, flags and note. The instruction leads every
    turn. With ``gate_rounds`` above 1 each turn's text is revised until it has no flags,
    at most so many generations a turn; ``revise`` makes the request from note.
    """
    revise = revise or (lambda note: F.concat(F.lit("Revise the text above. "), note))
    state = prompts.select("prompt_id", F.array(message("user", F.concat(F.lit(instruction), "prompt"))).cast(MESSAGES).alias("messages"), F.lit(0).alias("iterations"), F.array().cast("array<long>").alias("per_turn"))

    def judged(rows: DataFrame) -> DataFrame:
        found = judge(rows.select("prompt_id", "text")).select("prompt_id", "flags", "note")
        return cut(rows.join(found, "prompt_id", "left").fillna(0, ["flags"]).fillna("", ["note"]))

    def answered(rows: DataFrame) -> DataFrame:
        return rows.join(generate(rows.select("prompt_id", "messages")).select("prompt_id", "text"), "prompt_id").withColumn("iterations", F.col("iterations") + 1)

    for request in [None, *requests]:
        if request is not None:
            said = F.array(message("assistant", F.col("text")), message("user", F.lit(instruction + request)))
            state = state.withColumn("messages", F.concat("messages", said.cast(MESSAGES))).drop("text", "flags", "note")
        state = judged(answered(state))
        for _ in range(gate_rounds - 1):
            open_ = state.filter("flags > 0")
            if not open_.limit(1).count():
                break
            asked = open_.withColumn("messages", F.concat("messages", F.array(message("assistant", F.col("text")), message("user", revise(F.col("note")))).cast(MESSAGES)))
            again = judged(answered(asked.drop("text", "flags", "note")).drop("messages").join(open_.select("prompt_id", "messages"), "prompt_id"))
            state = cut(state.filter("flags = 0").unionByName(again.select(*state.columns)))
        state = state.withColumn("per_turn", F.array_append("per_turn", F.col("flags").cast("long")))
    passed = F.when(F.lit(gate_rounds > 1), F.col("flags") == 0)
    return state.select("prompt_id", "text", "iterations", passed.alias("passed"), "per_turn")


def resuming(generate: Generate, recordings: DataFrame, occurrence: int = 0, save: Callable[[DataFrame], None] | None = None) -> Generate:
    """A generator that replays what ``recordings`` (digest, occurrence, output) hold and asks only for the rest.

    A recording belongs to one message list and to the nth time it is asked in a run: prompts
    of one step that ask the same are numbered by their id, from ``occurrence`` on. What
    is asked anew goes to ``save`` (digest, occurrence, messages, output).
    """

    def ask(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("prompt_id")) - 1
        keyed = rows.select("prompt_id", "messages", message_digest(F.col("messages")).alias("digest"))
        keyed = keyed.withColumn("occurrence", (nth + occurrence).cast("int"))
        known = recordings.select("digest", "occurrence", F.col("output").alias("text"))
        have = keyed.join(known, ["digest", "occurrence"]).select("prompt_id", "text")
        missing = keyed.join(known, ["digest", "occurrence"], "left_anti")
        new = _cut(generate(missing.select("prompt_id", "messages")))
        if save is not None:
            save(missing.join(new, "prompt_id").select("digest", "occurrence", "messages", F.col("text").alias("output")))
        return have.unionByName(new.select("prompt_id", "text"))

    return ask


def run_arms(arms: dict[str, DataFrame], score: Callable[[DataFrame], DataFrame], run: str = "run") -> DataFrame:
    """run, arm, prompt_id, iterations, passed and the columns of ``score`` (rows of prompt_id, text; gives prompt_id and scores)."""
    out = None
    for name, texts in arms.items():
        one = texts.join(score(texts.select("prompt_id", "text")), "prompt_id").withColumns({"run": F.lit(run), "arm": F.lit(name)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def save_run(rows: DataFrame, path: str) -> None:
    """The rows of a run as Parquet, by run and arm; saving a run again replaces it and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "arm").parquet(path)


def changes(scored: DataFrame, value: str, base: str = "ungated", control: str = "control", *, lower_is_better: bool = True) -> DataFrame:
    """arm, mean, base_mean, change, percent, direction, noise_floor, finding: each arm's mean against the base arm's.

    noise_floor: how far the control, a second sample of the base, lies from it; a change
    that is not above it is no finding. percent is null where the base is zero.
    """
    means = scored.groupBy("arm").agg(F.avg(value).alias("mean"))
    one = means.agg(F.max(F.when(F.col("arm") == base, F.col("mean"))).alias("base_mean"), F.max(F.when(F.col("arm") == control, F.col("mean"))).alias("control_mean"))
    out = means.crossJoin(F.broadcast(one))  # one row
    change = F.col("mean") - F.col("base_mean")
    better = change < 0 if lower_is_better else change > 0
    direction = F.when(F.abs(change) < 1e-9, "no change").when(better, "better").otherwise("WORSE")
    noise = F.abs(F.col("control_mean") - F.col("base_mean"))
    out = out.withColumns({"change": change, "percent": F.round(F.try_divide(change * 100, F.col("base_mean"))), "direction": direction, "noise_floor": noise})
    return out.withColumn("finding", F.abs("change") > F.coalesce("noise_floor", F.lit(0.0))).filter(F.col("arm") != base).drop("control_mean").orderBy("arm")


def load_instruction(spark: SparkSession, name: str, catalogue: dict[str, str], suffix: str = "\n\n") -> str:
    """The text of a catalogued instruction, or of a file that is named by its path; an unknown name is an error."""
    if "/" in name or name.endswith((".md", ".txt")):
        rows = spark.read.option("wholetext", True).text(name).limit(1).collect()  # one file
        return (rows[0]["value"] if rows else "").rstrip() + suffix
    if name not in catalogue:
        raise ValueError(f"no instruction {name!r}; there are {', '.join(sorted(catalogue))}")
    return catalogue[name].rstrip() + suffix
