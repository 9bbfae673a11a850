"""What happens to a write: denied, fixed, or let through. One row a write, from its edit to its decision.

Flags are judged on the file as it will be where that can be told, else on what is written;
fixes act on what is written. A file that is there already may keep the flags it has: a
write is denied only if the weight of its blocking flags grows. All of it happens inside the
row, in batch and on streams alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.literals import prose_literals
from .fix import apply_edit, fix
from .history import RETRY_CAP, deny_streaks
from .lint import flag_arrays, gates, merged_array
from .routing import DEFAULT_RULES, Judge, judges, route

#: A write: tool is ``write`` (content), ``edit`` (old, new, every) or ``shell`` (content; what the file will be can't be told).
WRITE = "path string, tool string, before string, content string, old string, new string, every boolean"
SHOWN = 8
DECISION = "path string, rule_ord int, ruleset string, decision string, before_weight long, after_weight long, flags int, kinds array<string>, shown array<string>, fixed string"


def resulting(writes: DataFrame) -> DataFrame:
    """``writes`` with chunk (what is written), after (the file then; null if it can't be told) and judged."""
    edited = F.when(F.coalesce(F.col("old"), F.lit("")) != "", apply_edit(F.coalesce("before", F.lit("")), F.col("old"), F.coalesce("new", F.lit("")), F.coalesce("every", F.lit(False))))
    after = F.when(F.col("tool") == "write", F.coalesce("content", F.lit(""))).when(F.col("tool") == "edit", edited)
    chunk = F.coalesce(F.when(F.col("tool") == "edit", F.col("new")).otherwise(F.col("content")), F.lit(""))
    return writes.withColumns({"chunk": chunk, "after": after}).withColumn("judged", F.coalesce("after", "chunk"))


def _judged(rows: DataFrame, judge: Judge, text: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the merged flags of ``text`` (null: none), and their gates as ``name``_gates."""
    kept = [c for c in rows.columns if c != "path"]
    given = rows.withColumn("_text", text)
    arrays = flag_arrays(given, judge.rules, judge.context, key="path", text="_text", keep=tuple(kept), disabled=judge.disabled)
    built = judge.context["built"]
    if "merged" not in built:
        built |= {"merged": merged_array(F.col("found"), judge.rules), "gates": gates(F.col("_merged"), judge.limits, F.col("rule_ord"))}
    out = arrays.withColumn("_merged", built["merged"]).drop("found").withColumn("_gates", built["gates"])
    return out.withColumnsRenamed({"_merged": name, "_gates": f"{name}_gates"})


def _blocking(name: str) -> Column:
    """The semantic flags of kinds that block."""
    kinds = F.transform(F.filter(f"{name}_gates", lambda g: g["blocks"]), lambda g: g["kind"])
    return F.filter(name, lambda m: ~m["flag"]["mechanical"] & F.array_contains(kinds, m["flag"]["kind"]))


def _weight(name: str) -> Column:
    return F.aggregate(F.filter(f"{name}_gates", lambda g: g["blocks"]), F.lit(0).cast("long"), lambda a, g: a + g["weight"])


def _line_of(segments: Column, text: Column) -> Column:
    return F.get(F.filter(segments, lambda s: F.contains(s["segment"], text) & (text != "")), F.lit(0))["line"]


def _shown(flags: Column, where) -> Column:
    """``[kind] label``: the label, else 80 characters of the sentence or the note, else the kind."""

    def line(m: Column) -> Column:
        f = m["flag"]
        said = [F.nullif(x, F.lit("")) for x in (f["hit"]["label"], F.substring(f["text"], 1, 80), F.substring(f["hit"]["note"], 1, 80))]
        return F.concat(F.lit("["), f["kind"], F.lit("] "), F.coalesce(*said, f["kind"]), where(f))

    return F.transform(flags, line)


def _decided(rows: DataFrame, host: Judge, inner: Judge | None) -> DataFrame:
    none = F.array().cast("array<string>")
    if inner is not None:  # of both texts, and before all else, so that no plan of checks hangs below a Python worker
        of = lambda c: F.when(F.endswith("path", F.lit(".py")), prose_literals(c))
        rows = rows.withColumns({"segments": of("judged"), "was_segments": of(F.coalesce("before", F.lit("")))})
    rows = _judged(rows, host, F.col("judged"), "now")
    rows = _judged(rows, host, F.when(F.col("judged") != F.col("chunk"), F.col("chunk")), "part")
    rows = rows.withColumn("blocking", _blocking("now"))
    lines, inner_count, weight = none, F.lit(0), _weight("now")
    if inner is not None:
        rows = _judged(rows, inner, F.array_join(F.transform("segments", lambda s: s["segment"]), "\n\n"), "inner").withColumn("inner_blocking", _blocking("inner"))
        at = lambda f: F.coalesce(F.concat(F.lit(" (embedded prose, line "), _line_of(F.col("segments"), f["text"]).cast("string"), F.lit(")")), F.lit(" (embedded prose)"))
        lines, inner_count, weight = _shown(F.col("inner_blocking"), at), F.size("inner_blocking"), weight + _weight("inner")
    rows = rows.withColumns({"weight": weight, "n": F.size("blocking") + inner_count, "lines": F.concat(_shown(F.col("blocking"), lambda f: F.lit("")), lines)})
    # Only what would be denied is weighed against the file as it was.
    had = (F.col("n") > 0) & F.col("after").isNotNull() & (F.coalesce(F.trim("before"), F.lit("")) != "")
    rows = rows.withColumn("had", had)
    was = F.when(F.col("had"), F.col("before"))
    rows = _judged(rows, host, was, "was").withColumn("before_weight", F.when(F.col("had"), _weight("was")))
    if inner is not None:
        joined = F.array_join(F.transform("was_segments", lambda s: s["segment"]), "\n\n")
        rows = _judged(rows, inner, F.when(F.col("had"), joined), "was_inner")
        rows = rows.withColumn("before_weight", F.col("before_weight") + _weight("was_inner"))
    worse = (F.col("n") > 0) & (~F.col("had") | (F.col("weight") > F.col("before_weight")))
    changed = F.col("judged") != F.col("chunk")
    mechanical = F.filter(F.when(changed, F.col("part")).otherwise(F.col("now")), lambda m: m["flag"]["mechanical"])
    rows = rows.withColumns({"worse": worse, "mechanical": mechanical})
    shell = F.col("tool") == "shell"
    decision = F.when(F.col("worse") | ((F.size("mechanical") > 0) & shell), "deny").when(F.size("mechanical") > 0, "auto_fix").otherwise("clean")
    rows = rows.withColumn("decision", decision)
    kinds_of = lambda c: F.transform(c, lambda m: m["flag"]["kind"])
    flagged = F.concat(kinds_of("blocking"), kinds_of("inner_blocking") if inner is not None else none)
    kinds = F.when(F.col("worse"), flagged).otherwise(kinds_of("mechanical"))
    rows = rows.withColumns({"kinds": kinds, "_fix": F.when(F.col("decision") == "auto_fix", F.col("chunk"))})
    extra = host.context.get("extra", {}).get("stock_adverb", ())
    rows = fix(rows, host.rules.id, text="_fix", extra=extra, allowed=frozenset(host.context.get("allowed", ())), disabled=host.disabled)
    return rows.select(
        "path", "rule_ord", "ruleset", "decision", F.col("before_weight").cast("long").alias("before_weight"), F.when(F.col("had"), F.col("weight")).cast("long").alias("after_weight"),
        F.size("kinds").alias("flags"), "kinds", F.when(F.col("worse"), F.slice("lines", 1, SHOWN)).otherwise(none).alias("shown"), "fixed",
    )


def decide_writes(
    writes: DataFrame, rules: list[dict] = DEFAULT_RULES, overrides: DataFrame | None = None, disabled: dict[str, list[str]] | None = None,
    packs: DataFrame | None = None, context: dict[str, dict] | None = None, *, root: str = "/",
) -> DataFrame:
    """One row a write (``WRITE``), as ``DECISION``: deny, auto_fix, clean, out_of_scope or blank.

    deny: there are blocking flags (of the file's ruleset, or of its embedded prose's) and the
    file is new, or their weight grows; or a shell command writes what a fix would change.
    auto_fix: ``fixed`` is what to write instead. flags, kinds: those that deny or get fixed;
    shown: the first eight that deny. Weights are there where a file is weighed against what
    it was. Rules, overrides, disabled, packs and context: as in ``routing.lint_routed``.
    Null texts count as empty; an edit whose ``old`` is not in the file is judged as written.
    No shuffle and no job over ``writes``, so it also runs on streams.
    """
    given = resulting(writes.select(*[c.split()[0] for c in WRITE.split(", ")]))
    routed = route(given, rules, root=root)
    blank = F.trim(F.regexp_replace("judged", r"(?U)\s", "")) == ""
    idle = F.when(F.col("ruleset").isNull(), "out_of_scope").when(blank, "blank")
    no = {"before_weight": "long", "after_weight": "long", "shown": "array<string>", "kinds": "array<string>", "fixed": "string"}
    rest = routed.withColumn("decision", idle).filter(F.col("decision").isNotNull()).withColumns({c: F.lit(None).cast(k) for c, k in no.items()} | {"flags": F.lit(0)})
    names = [c.split()[0] for c in DECISION.split(", ")]
    out = rest.select(*names)
    for ordinals, host, inner in judges(writes.sparkSession, rules, overrides, disabled, packs, context):
        out = out.unionByName(_decided(routed.filter(F.col("rule_ord").isin(*ordinals) & ~blank), host, inner).select(*names))
    return out


def with_attempts(decided: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions with attempt (denials in a row of the file, this one included; null if not denied) and stop: to ask a person instead."""
    streaks = deny_streaks(events.filter(F.col("file").isNotNull())).select(F.col("file").alias("path"), "streak")
    out = decided.join(streaks, "path", "left").withColumn("attempt", F.when(F.col("decision") == "deny", F.coalesce("streak", F.lit(0)) + 1))
    return out.withColumn("stop", F.coalesce(F.col("attempt") >= RETRY_CAP, F.lit(False))).drop("streak")


def as_events(decided: DataFrame, first: int, ts: Column) -> DataFrame:
    """Decisions as events of the log, numbered from ``first`` in the order of their paths within a partition."""
    logged = decided.filter(F.col("decision").isin("deny", "auto_fix", "clean"))
    kinds = F.when(F.col("decision") == "clean", F.array().cast("array<string>")).otherwise(F.col("kinds"))
    return logged.select((F.lit(first) + F.monotonically_increasing_id()).alias("seq"), ts.alias("ts"), F.col("decision").alias("action"), F.col("path").alias("file"), kinds.alias("kinds"), "ruleset")
