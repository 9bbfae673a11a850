"""Text shape, arm scores and paired statistics. Arms are rows: run, prompt_id, arm, ..."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import let
from .structure import metric_sentences, metric_words


def text_shape(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rounded: bool = True) -> DataFrame:
    """key, words, sentences, mean_sentence_words, sentence_length_stdev (sample; 0 for one), type_token_ratio."""
    t = F.coalesce(F.col(text), F.lit(""))
    lengths = F.filter(F.transform(metric_sentences(t), lambda s: F.size(metric_words(s)).cast("double")), lambda n: n > 0)

    def stats(xs: Column) -> Column:
        n = F.size(xs).cast("double")
        mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))
        squares = let(mean, lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))
        return F.struct(F.size(xs).alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(F.sqrt(squares / F.nullif(n - 1, F.lit(0.0))), F.lit(0.0)).alias("stdev"))

    found = let(metric_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("types")))
    out = docs.select(key, found.alias("w"), let(lengths, stats).alias("s"))
    r = (lambda c, d: F.round(c, d)) if rounded else (lambda c, d: c)
    return out.select(key, F.col("w.n").alias("words"), F.col("s.n").alias("sentences"), r(F.col("s.mean"), 2).alias("mean_sentence_words"), r(F.col("s.stdev"), 2).alias("sentence_length_stdev"), r(F.coalesce(F.try_divide(F.col("w.types").cast("double"), F.col("w.n")), F.lit(0.0)), 4).alias("type_token_ratio"))


def arm_scores(shape: DataFrame, merged: DataFrame, enforced: list[str], *, key: str = "doc_id") -> DataFrame:
    """``shape`` with enforced_flags, held_out_flags and their rates per 1000 words. Semantic flags count."""
    on = F.col("kind").isin(*enforced)
    per = merged.filter("bucket = 'semantic'").groupBy(key).agg(F.count_if(on).alias("enforced_flags"), F.count_if(~on).alias("held_out_flags"))
    out = shape.join(per, key, "left").fillna(0, ["enforced_flags", "held_out_flags"])
    rate = lambda c: F.coalesce(F.try_divide(F.col(c) * 1000.0, F.col("words")), F.lit(0.0))
    return out.withColumns({"enforced_per_1k": rate("enforced_flags"), "held_out_per_1k": rate("held_out_flags")})


def paired(arms: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """run, prompt_id, a, b: the values of two arms for prompts that have both."""
    one = lambda arm, name: arms.filter(F.col("arm") == arm).select("run", "prompt_id", F.col(value).cast("double").alias(name))
    return one(a, "a").join(one(b, "b"), ["run", "prompt_id"]).filter("a is not null and b is not null")


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins: the terms from k down, each from the one above by their ratio.

    Twelve standard deviations below k nothing counts any more, so the terms grow with the
    root of n only.
    """
    x = lambda c: c.cast("double")

    def log_factorial(m: Column) -> Column:
        """Exact for small m, else Stirling's series (relative error below 1e-16 from 32 on)."""
        exact = F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(33)]), m.cast("int"))
        d = x(m)
        series = d * F.log(d) - d + 0.5 * F.log(F.lit(2 * math.pi) * d) + 1 / (12 * d) - 1 / (360 * d * d * d) + 1 / (1260 * F.pow(d, F.lit(5.0)))
        return F.when(m <= 32, exact).otherwise(series)

    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - x(n) * F.log(F.lit(2.0)))
    start = F.struct(top.alias("term"), top.alias("sum"))

    def step(acc, i):
        term = acc["term"] * x(k - i) / x(n - k + i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    few = F.filter(F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(6 * F.sqrt(x(n))) + 60).cast("long")), lambda i: i < k)
    return F.aggregate(few, start, step, lambda a: a["sum"])


def sign_test(pairs: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """by, wins (a < b), losses, ties, p: two-sided exact sign test; ties do not count; without any pair p is 1."""
    out = pairs.groupBy(*by).agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
    n = F.col("wins") + F.col("losses")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, F.least("wins", "losses"))))
    return out.withColumn("p", p)


def _resampled(diffs: list[float], draws: int, seed: int):
    """The mean of each resample, with the indices that ``random.Random(seed).randrange`` gives, drawn in bulk."""
    n, start = len(diffs), random.Random(seed).getstate()[1]
    source = np.random.RandomState()
    source.set_state(("MT19937", np.array(start[:-1], np.uint32), start[-1]))
    values, whole = np.array(diffs), all(float(d).is_integer() for d in diffs)
    left = np.zeros(0, np.uint32)
    for _ in range(draws):
        parts, have = [left], len(left)
        while have < n:
            raw = source.randint(0, 1 << 32, max(1024, 2 * (n - have)), np.uint32) >> np.uint32(32 - n.bit_length())
            parts.append(raw[raw < n])
            have += len(parts[-1])
        at = np.concatenate(parts)
        at, left = at[:n], at[n:]
        yield (float(values[at].sum()) if whole else sum(values[at].tolist())) / n


def bootstrap(pairs: DataFrame, by: tuple[str, ...] = ("run",), draws: int = 10_000, seed: int = 0) -> DataFrame:
    """by, mean, low, high, favour: the mean of b - a, its 95 % interval by resampling, and the share of resamples above zero.

    A group is the pairs of one experiment (prompts of a prompt set), which a person wrote.
    """

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        diffs = list((p.sort_values("prompt_id")["b"] - p.sort_values("prompt_id")["a"]))
        n = len(diffs)
        means = sorted(_resampled(diffs, draws, seed))
        return pd.DataFrame([(*key, sum(diffs) / n, means[int(0.025 * draws)], means[int(0.975 * draws) - 1], sum(m > 0 for m in means) / draws)])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.groupBy(*by).applyInPandas(run, f"{kinds}, mean double, low double, high double, favour double")


#: Draw counts by which Poisson(1) weights are read off a uniform number: P(X <= k).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: Weights that a task holds at a time.
_WEIGHTS_AT_ONCE = 1 << 21


def _poisson(keys: np.ndarray, draws: int) -> np.ndarray:
    """Weights (rows by draws) that depend on a row's key and the draw's number alone, by a mixing of 64 bits."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right").astype(np.float64)


def bootstrap_merged(pairs: DataFrame, by: tuple[str, ...] = ("run",), draws: int = 10_000, seed: int = 0) -> DataFrame:
    """by, mean, low, high, favour as :func:`bootstrap`, for any number of pairs.

    Each pair takes part in a resample with a Poisson(1) weight that hashing its prompt_id
    deals, so tasks add up their own pairs and only sums travel: one a group, draw and task.
    A resample without any weight is left out. Rows of one prompt_id and group share weights.
    Against the exact form the bounds differ by resampling noise, some 3 % of the interval's
    width at 10 000 draws, from a hundred pairs on.
    """
    key = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in (*by, "prompt_id")]).alias("key")
    rows = pairs.select(*by, key, (F.col("b") - F.col("a")).cast("double").alias("x"))
    step = max(1, _WEIGHTS_AT_ONCE // draws)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for name, group in batch.groupby([*by], dropna=False, sort=False):
                name = tuple(None if pd.isna(v) else v for v in (name if isinstance(name, tuple) else (name,)))
                sums, weights = held.setdefault(name, (np.zeros(draws), np.zeros(draws)))
                for at in range(0, len(group), step):
                    part = group.iloc[at : at + step]
                    w = _poisson(part["key"].to_numpy(), draws)
                    sums += part["x"].to_numpy() @ w
                    weights += w.sum(axis=0)
            if len(held) * draws > _WEIGHTS_AT_ONCE:  # many groups: what is summed so far goes on
                yield from told(held)
                held = {}
        yield from told(held)

    def told(held):
        for name, (sums, weights) in held.items():
            yield pd.DataFrame({**{c: [v] * draws for c, v in zip(by, name)}, "draw": np.arange(draws), "s": sums, "w": weights})

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in by)
    sums = rows.mapInPandas(partial, f"{kinds}, draw long, s double, w double")
    means = sums.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m")).filter("m is not null")
    drawn = means.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # one number a draw
    n = F.size("ms")
    low, high = F.get("ms", F.floor(n * 0.025).cast("int")), F.get("ms", F.greatest(F.lit(0), F.floor(n * 0.975).cast("int") - 1))
    drawn = drawn.select(*[F.col(c).alias(f"_{c}") for c in by], low.alias("low"), high.alias("high"), (F.size(F.filter("ms", lambda m: m > 0)) / n).alias("favour"))
    centre, same = rows.groupBy(*by).agg(F.avg("x").alias("mean")), F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return centre.join(drawn, same, "left").select(*by, "mean", "low", "high", "favour")


def leaderboard(arms: DataFrame, value: str = "enforced_flags") -> DataFrame:
    """arm, prompts, total, mean, rank: the arms by their total, ties by name."""
    out = arms.groupBy("arm").agg(F.count("*").alias("prompts"), F.sum(value).cast("double").alias("total"), F.avg(value).alias("mean"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("total", "arm")))


def revised_only(arms: DataFrame, gated: str = "gated") -> DataFrame:
    """The rows of prompts that the gated arm revised at least once."""
    return arms.join(arms.filter((F.col("arm") == gated) & (F.col("iterations") > 1)).select("run", "prompt_id").distinct(), ["run", "prompt_id"], "left_semi")


def drift(turns: DataFrame, value: str = "total") -> DataFrame:
    """arm, turn, total, prompts, change: sums at each turn; a missing turn is left out, and change is from the arm's first turn."""
    out = turns.groupBy("arm", "turn").agg(F.sum(value).cast("double").alias("total"), F.count("*").alias("prompts"))
    return out.withColumn("change", F.col("total") - F.first("total").over(Window.partitionBy("arm").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))


def instruction(checks: DataFrame) -> DataFrame:
    """One row: the instruction that names the given checks, in order of their ids."""
    return checks.agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("- avoid "), F.replace("check_id", F.lit("_"), F.lit(" ")))))).alias("instruction"))


def replay(requests: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (call_seq, digest, ...) with the recorded output, and those without one.

    The nth call with a digest takes the recording of occurrence n - 1.
    """
    w = Window.partitionBy("digest").orderBy("call_seq")
    numbered = requests.withColumn("occurrence", (F.row_number().over(w) - 1).cast("int"))
    return numbered.join(recordings.select("digest", "occurrence", "output"), ["digest", "occurrence"]), numbered.join(recordings.select("digest", "occurrence"), ["digest", "occurrence"], "left_anti")


def message_digest(messages: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of messages (array<struct<role, content>>) as JSON with sorted keys.

    The JSON has ``", "`` and ``": "`` between its parts, which to_json does not write.
    """
    # JSON's short escapes; other control characters are written as \\u and four digits.
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}

    def quoted(s: Column) -> Column:
        for raw, escaped in (short | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in short}).items():
            s = F.replace(s, F.lit(raw), F.lit(escaped))
        return F.concat(F.lit('"'), s, F.lit('"'))

    one = lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]")), 256), 1, 16)


def gated_loop(prompts: DataFrame, generate, judge, rounds: int = 4, cut=None) -> DataFrame:
    """prompt_id, text, iterations, passed: texts revised until no enforced flag is left, at most ``rounds`` times.

    generate(rows with prompt_id, text or null, iteration) gives prompt_id and text;
    judge(rows) gives prompt_id and flags. ``cut`` ends the lineage of a round (checkpoint).
    """
    cut = cut or (lambda df: df.checkpoint())
    active, done = prompts.select("prompt_id", F.lit(None).cast("string").alias("text")), None
    for i in range(1, rounds + 1):
        texts = generate(active.withColumn("iteration", F.lit(i)))
        judged = cut(texts.join(judge(texts), "prompt_id", "left").fillna(0, ["flags"]))
        over = judged.filter(F.col("flags") == 0) if i < rounds else judged
        over = over.select("prompt_id", "text", F.lit(i).alias("iterations"), (F.col("flags") == 0).alias("passed"))
        done = over if done is None else done.unionByName(over)
        active = judged.filter(F.col("flags") > 0).select("prompt_id", "text")
        if i < rounds and not active.limit(1).count():
            break
    return done
