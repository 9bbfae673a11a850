"""Which rule, ruleset, disabled checks and thresholds a path gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checks.base import Ruleset
from ..functions.patterns import glob_regex
from ..plans.registry import TERM_LISTS, check_table, ruleset, rulesets
from ..sources.literals import prose_literals
from .lint import flag_arrays, judged
from .vocabulary import ready

#: Terms of packs that rules may bind in all.
PACK_TERMS = 20_000

RULE = "ord int, glob string, ruleset string, packs map<string,array<string>>, disable array<string>, embedded_prose string"
# The rules of a project that has none of its own; the first is out of scope.
DEFAULT_RULES = (
    {"glob": ".claude/*", "ruleset": None}, {"glob": "*.md", "ruleset": "prose"}, {"glob": "*.txt", "ruleset": "prose"},
    {"glob": "*.rst", "ruleset": "prose"}, {"glob": "*.py", "ruleset": "code"},
)


def relative(path, root: str):
    """The path below ``root``, with forward slashes; null outside it."""
    root = root.rstrip("/") + "/"
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(root)), F.substring(p, len(root) + 1, 1 << 20)).when(~F.startswith(p, F.lit("/")), p)


def route(paths: DataFrame, rules: list[dict], *, path: str = "path", root: str = "/") -> DataFrame:
    """``paths`` with rule_ord and ruleset of the first rule whose glob matches; both null if none does.

    Rules are few and known when the plan is made, so they become one CASE chain: no join.
    A rule without a ruleset puts what it matches out of scope: rule_ord is set, ruleset null.
    """
    for r in rules:
        if r.get("ruleset"):
            ruleset(r["ruleset"])  # a typo raises here
    rel = relative(F.col(path), root)
    ord_ = F.coalesce(*[F.when(rel.rlike(glob_regex(r["glob"])), F.lit(i)) for i, r in enumerate(rules)], F.lit(None).cast("int"))
    names = F.array(*[F.lit(r.get("ruleset")).cast("string") for r in rules]) if rules else F.array().cast("array<string>")
    return paths.withColumn("rule_ord", ord_).withColumn("ruleset", F.get(names, F.col("rule_ord")))


def route_table(paths: DataFrame, rules: DataFrame, *, path: str = "path") -> DataFrame:
    """As ``route``, for rules in a table (ord, pattern, ruleset): every rule is tried on every path, the first match stays.

    The rules are broadcast; there are as many as a person writes.
    """
    hits = paths.join(F.broadcast(rules.select("ord", "pattern", F.col("ruleset").alias("to"))), F.col(path).rlike(F.col("pattern")), "left")
    return hits.groupBy(*paths.columns).agg(F.min("ord").alias("rule_ord"), F.min_by("to", "ord").alias("ruleset"))


def drop_disabled(found: DataFrame, rules: list[dict], project: tuple = (), *, rule: str = "rule_ord") -> DataFrame:
    """Flags (with their rule's ordinal) without the checks that the project or the rule disables."""
    lists = F.array(*[F.array(*[F.lit(c) for c in (*project, *r.get("disable", ()))]).cast("array<string>") for r in rules]) if rules else F.array().cast("array<array<string>>")
    off = F.coalesce(F.get(lists, F.col(rule)), F.array(*[F.lit(c) for c in project]).cast("array<string>"))
    return found.filter(~F.array_contains(off, F.col("kind")))


def overrides_of(spark: SparkSession, config: dict) -> DataFrame:
    """check_id, glob, field, value of a configuration: ``check_config`` by ruleset and check, and a rule's own by check.

    Only thresholds and actions of checks that the ruleset has; of rules with one glob, the first counts.
    """
    out, seen = [], set()

    def add(glob: str | None, name: str, some: dict) -> None:
        known = ruleset(name).table()
        for check, fields in some.items():
            if check in known and isinstance(fields, dict):
                out.extend((check, glob, f, str(fields[f])) for f in ("threshold", "action") if f in fields and not isinstance(fields[f], bool))

    for name, some in (config.get("check_config") or {}).items():
        if name in rulesets():
            add(None, name, some or {})
    for rule in config.get("rulesets") or []:
        if rule.get("ruleset") and rule["glob"] not in seen:
            seen.add(rule["glob"])
            add(rule["glob"], rule["ruleset"], rule.get("check_config") or {})
    return spark.createDataFrame(out, "check_id string, glob string, field string, value string")


def set_override(overrides: DataFrame, checks: DataFrame, check_id: str, field: str, value: str | int | None, glob: str | None = None) -> DataFrame:
    """``overrides`` with one field of a check set for the project, or for the rule of a glob; null takes the setting away.

    Fields are threshold, action and the check's own parameters; another one, an unknown
    check or a value that :func:`effective_config` would pass over is an error.
    """
    declared = checks.filter(F.col("check_id") == check_id).select("params").head(1)
    if not declared:
        raise ValueError(f"no check {check_id!r}")
    fields = ("threshold", "action", *(declared[0]["params"] or {}))
    if field not in fields:
        raise ValueError(f"{check_id!r} has no {field!r}; there are {', '.join(fields)}")
    whole = isinstance(value, int) and not isinstance(value, bool) and 1 <= value < 10**9
    if value is not None and not (value in ("warn", "block") if field == "action" else whole):
        raise ValueError(f"{field} can't be {value!r}")
    same = (F.col("check_id") == check_id) & (F.col("field") == field) & F.col("glob").eqNullSafe(F.lit(glob))
    rest = overrides.filter(~same)
    if value is None:
        return rest
    one = overrides.sparkSession.createDataFrame([(check_id, glob, field, str(value))], "check_id string, glob string, field string, value string")
    return rest.unionByName(one)


def effective_config(checks: DataFrame, overrides: DataFrame, glob: str | None = None) -> DataFrame:
    """check_id, threshold, action, params: defaults, then the project's overrides, then those of the rule's glob, field by field.

    overrides: check_id, glob (null: project), field, value. An invalid value leaves the
    field as it was: numbers are whole and at least 1, an action is ``warn`` or ``block``.
    """
    valid = F.when(F.col("field") == "action", F.col("value").isin("warn", "block")).otherwise(F.col("value").rlike("^[1-9][0-9]{0,8}$"))
    here = overrides.filter(valid & (F.col("glob").isNull() | (F.col("glob") == F.lit(glob))))
    last = here.groupBy("check_id", "field").agg(F.max_by("value", F.col("glob").isNotNull().cast("int")).alias("value"))
    fields = last.groupBy("check_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("set"))
    out = checks.join(fields, "check_id", "left").withColumn("set", F.coalesce("set", F.create_map().cast("map<string,string>")))
    params = F.transform_values("params", lambda k, v: F.coalesce(F.try_element_at("set", k).cast("int"), v))
    return out.select("ruleset", "check_id", "ord", "unit", "kind", "bucket", F.coalesce(F.try_element_at("set", F.lit("threshold")).cast("int"), "threshold").alias("threshold"), F.coalesce(F.try_element_at("set", F.lit("action")), "action").alias("action"), params.alias("params"), "terms_list")


def split_checks(checks: DataFrame, enforced: list[str]) -> tuple[DataFrame, DataFrame]:
    """The enforced checks and the held-out rest; it is an error if none is enforced."""
    on = checks.filter(F.col("check_id").isin(*enforced)) if enforced else checks.limit(0)
    if not on.limit(1).count():
        raise ValueError("no check of this ruleset is enforced")
    return on, checks.join(F.broadcast(on.select("check_id")), "check_id", "left_anti")


def complement(checks: DataFrame) -> DataFrame:
    """The checks that do not block."""
    return checks.filter("action <> 'block'")


def explain(spark, path: str, rules: list[dict], checks: DataFrame) -> DataFrame:
    """The rule of one path and the checks that run on it."""
    one = route(spark.createDataFrame([(path,)], "path string"), rules)
    out = one.join(F.broadcast(checks), "ruleset", "left")
    return drop_disabled(out.withColumnRenamed("kind", "check_kind").withColumn("kind", F.coalesce("check_id", F.lit(""))), rules).drop("kind")


def unused(rules: DataFrame) -> DataFrame:
    """Rules that no path can reach because an earlier rule has the same glob."""
    return rules.withColumn("nth", F.row_number().over(Window.partitionBy("glob").orderBy("ord"))).filter("nth > 1").drop("nth")


@dataclass(frozen=True)
class Judge:
    """A ruleset as it is configured for some rules. limits: threshold and action by the rule's ordinal and check."""

    rules: Ruleset
    context: dict
    limits: dict[str, tuple[int, str]]
    disabled: tuple[str, ...]


def pack_terms_by_rule(rules: list[dict], packs: DataFrame) -> dict[int, dict[tuple[str, str], tuple[str, ...]]]:
    """By the rule's ordinal, then (ruleset, check): the terms of the packs that the rule binds to lists which feed that check.

    packs: pack, term. Only packs that a rule names are read, each once: a table of the
    plan, as large as what people bind to rules, and an error beyond ``PACK_TERMS``.
    """
    feeds = {(r, lst): check for r, lst, check, _, _, accepts, _ in TERM_LISTS if accepts}
    bound = {(i, name, lst, p) for i, r in enumerate(rules) for name in (r.get("ruleset"), r.get("embedded_prose")) if name for lst, ids in (r.get("packs") or {}).items() for p in ids if (name, lst) in feeds}
    wanted = sorted({p for *_, p in bound})
    if not wanted:
        return {}
    rows = packs.filter(F.col("pack").isin(*wanted)).select("pack", F.lower("term").alias("term")).distinct().limit(PACK_TERMS + 1).collect()
    if len(rows) > PACK_TERMS:
        raise ValueError(f"the packs bound to rules have over {PACK_TERMS} terms; give them as a dictionary")
    out: dict[int, dict[tuple[str, str], tuple[str, ...]]] = {}
    for i, name, lst, p in sorted(bound):
        mine, at = out.setdefault(i, {}), (name, feeds[name, lst])
        mine[at] = tuple(sorted({*mine.get(at, ()), *(r["term"] for r in rows if r["pack"] == p)}))
    return out


def judges(spark: SparkSession, rules: list[dict], overrides: DataFrame | None = None, disabled: dict[str, list[str]] | None = None, packs: DataFrame | None = None, context: dict[str, dict] | None = None, extra: dict[int, dict] | None = None):
    """(ordinals, judge, judge of embedded prose or None) of rules that are judged alike, for all rules with a ruleset."""
    disabled, extra = disabled or {}, extra or {}
    context = {name: ready(c) for name, c in (context or {}).items()}
    bound = pack_terms_by_rule(rules, packs) if packs is not None else {}

    def terms(i: int, name: str) -> dict[str, tuple[str, ...]]:
        own = dict(extra.get(i, {})) if name == rules[i].get("ruleset") else {}
        for (owner, check), some in bound.get(i, {}).items():
            if owner == name:
                own[check] = (*own.get(check, ()), *some)
        return own

    def off(i: int, name: str) -> tuple[str, ...]:
        mine = {*disabled.get(name, ()), *(rules[i].get("disable") or ())}
        return tuple(c.id for c in ruleset(name).checks if c.id in mine)

    def limits(ordinals: list[int], name: str) -> dict[str, tuple[int, str]]:
        out = {}
        for i in ordinals:
            table = {c.id: (c.threshold, c.action) for c in ruleset(name).checks}
            if overrides is not None:
                config = effective_config(check_table(spark, name), overrides, rules[i]["glob"])
                table |= {x["check_id"]: (x["threshold"], x["action"]) for x in config.select("check_id", "threshold", "action").collect()}  # one row a check
            out |= {f"{i}/{c}": v for c, v in table.items()}
        return out

    def judge(ordinals: list[int], name: str) -> Judge:
        some = terms(ordinals[0], name)
        given = dict(context.get(name, {})) | ({"extra": some} if some else {})
        if some.get("vocabulary"):  # an allow list: project terms
            given["project"] = spark.createDataFrame([(t,) for t in some["vocabulary"]], "word string")
            given.pop("vocabulary", None)
            given = ready(given)
        given["built"] = {}  # a judge sees several texts of a row
        return Judge(ruleset(name), given, limits(ordinals, name), off(ordinals[0], name))

    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        if r.get("ruleset"):
            both = [(n, repr(sorted(terms(i, n).items())), off(i, n)) for n in (r["ruleset"], r.get("embedded_prose")) if n]
            groups.setdefault(tuple(both), []).append(i)
    for both, ordinals in groups.items():
        yield ordinals, judge(ordinals, both[0][0]), judge(ordinals, both[1][0]) if len(both) > 1 else None


def lint_routed(
    files: DataFrame, rules: list[dict] = DEFAULT_RULES, overrides: DataFrame | None = None, disabled: dict[str, list[str]] | None = None, extra: dict[int, dict] | None = None,
    packs: DataFrame | None = None, context: dict[str, dict] | None = None, *, path: str = "path", text: str = "text", root: str = "/",
) -> DataFrame:
    """One row a file: path, rule_ord, ruleset, status, semantic, mechanical, would_block.

    The first matching rule gives a file its ruleset; the checks disabled for the project
    (``disabled``: by ruleset) or on the rule don't count, and thresholds and actions are
    the defaults, then ``overrides`` of the project, then those of the rule's glob. Terms
    come from the packs (``packs``: pack, term) that the rule binds to lists; ``extra`` has
    more of them by check, by the rule's ordinal. context: by ruleset, as for ``lint``, such
    as the dictionary. Where a rule names a ruleset for embedded prose, the literals of a
    .py file are judged by that one as well, as one document: its semantic flags count, and
    either of the two can block. Files of no rule, or of one without a ruleset, are
    ``out_of_scope``; texts of blanks alone are ``blank``. One pass over the files of each
    group of rules that are judged alike; no shuffle.
    """
    routed = route(files.select(path, text), rules, path=path, root=root)
    blank = F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s", "")), F.lit("")) == ""
    none = [F.lit(0).cast("long").alias("semantic"), F.lit(0).cast("long").alias("mechanical"), F.lit(False).alias("would_block")]
    idle = F.when(F.col("ruleset").isNull(), "out_of_scope").when(blank, "blank")
    names = (path, "rule_ord", "ruleset", "status", "semantic", "mechanical", "would_block")
    out = routed.withColumn("status", idle).filter("status is not null").select(path, "rule_ord", "ruleset", "status", *none)
    for ordinals, host, inner in judges(files.sparkSession, rules, overrides, disabled, packs, context, extra):
        mine = routed.filter(F.col("rule_ord").isin(*ordinals) & ~blank)
        kept = ("rule_ord", "ruleset")
        if inner is not None:
            literals_ = F.when(F.endswith(path, F.lit(".py")), prose_literals(text))
            mine, kept = mine.withColumn("_prose", F.array_join(F.transform(literals_, lambda s: s["segment"]), "\n\n")), (*kept, "_prose")
        arrays = flag_arrays(mine, host.rules, host.context, key=path, text=text, keep=kept, disabled=host.disabled)
        done = judged(arrays, host.rules, host.limits, F.col("rule_ord"))
        if inner is not None:
            own = ("rule_ord", "ruleset", *[f"_{c}" for c in names[3:]])
            done = done.select(path, "rule_ord", "ruleset", "_prose", *[F.col(c).alias(f"_{c}") for c in names[3:]])
            arrays = flag_arrays(done, inner.rules, inner.context, key=path, text="_prose", keep=own, disabled=inner.disabled)
            done = judged(arrays, inner.rules, inner.limits, F.col("rule_ord"))
            worst = F.when(F.col("_semantic") + F.col("semantic") > 0, "semantic_flags").otherwise(F.col("_status"))
            done = done.select(
                path, "rule_ord", "ruleset", worst.alias("status"), (F.col("_semantic") + F.col("semantic")).alias("semantic"),
                F.col("_mechanical").alias("mechanical"), (F.col("_would_block") | F.col("would_block")).alias("would_block"),
            )
        out = out.unionByName(done.select(*names))
    return out


def routed_summary(verdicts: DataFrame) -> DataFrame:
    """scanned, out_of_scope, blank, clean, with_notes, failed of ``lint_routed``'s rows."""
    n = F.col("status")
    judged_ = ~n.isin("out_of_scope", "blank")
    return verdicts.agg(F.count_if(judged_).alias("scanned"), F.count_if(n == "out_of_scope").alias("out_of_scope"), F.count_if(n == "blank").alias("blank"), F.count_if(n == "clean").alias("clean"), F.count_if(judged_ & (n != "clean") & ~F.col("would_block")).alias("with_notes"), F.count_if("would_block").alias("failed"))
