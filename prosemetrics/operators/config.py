"""Routing rules and enablement as tables: read, bound, saved and checked.

Rules are rows of :data:`~prosemetrics.operators.routing.RULE`; there are as many as a
person writes. Every function gives a new table; writing it is the caller's step.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import ruleset
from .routing import DEFAULT_RULES, RULE, route

# Keys of a configuration that something reads.
KNOWN_KEYS = ("rulesets", "terms", "disabled_checks", "check_config", "custom_term_lists")
_PACKS, _IDS = "map<string,array<string>>", "array<string>"
_RULES = f"array<struct<glob:string,ruleset:string,packs:{_PACKS},disable:{_IDS},embedded_prose:string>>"


def rules_table(spark: SparkSession, rules: list[dict] = DEFAULT_RULES) -> DataFrame:
    rows = [(i, r["glob"], r.get("ruleset"), r.get("packs"), r.get("disable"), r.get("embedded_prose")) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def load_rules(configs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The rules of a configuration (value: its JSON text); the default ones if there is none or it names none.

    Read anew each time: nothing is kept between calls.
    """
    spark = spark or configs.sparkSession
    given = configs.select(F.posexplode(F.from_json(F.get_json_object("value", "$.rulesets"), _RULES)).alias("ord", "r")).select("ord", "r.*")
    named = configs.filter(F.get_json_object("value", "$.rulesets").isNotNull()).limit(1).count()
    return given if named else rules_table(spark)


def stray_keys(configs: DataFrame) -> DataFrame:
    """key: top-level keys of the configuration (value: its JSON text) that nothing reads, sorted."""
    keys = F.explode(F.json_object_keys("value")).alias("key")
    return configs.select(keys).filter(~F.col("key").isin(*KNOWN_KEYS)).distinct().orderBy("key")


def packs_for_path(paths: DataFrame, rules: list[dict], list_id: str | None = None, *, path: str = "path", root: str = "/") -> DataFrame:
    """``paths`` with rule_ord and packs: those that the first matching rule binds to the list, or to any, each once, in order.

    One rule explains a path: bindings of other rules are not merged in. No rule: no packs.
    """
    of = [list(dict.fromkeys((r.get("packs") or {}).get(list_id, []) if list_id else [p for ids in (r.get("packs") or {}).values() for p in ids])) for r in rules]
    bound = F.array(*[F.array(*[F.lit(p) for p in ids]).cast(_IDS) for ids in of]) if of else F.array().cast(f"array<{_IDS}>")
    return route(paths, rules, path=path, root=root).drop("ruleset").withColumn("packs", F.coalesce(F.get(bound, F.col("rule_ord")), F.array().cast(_IDS)))


def _with_glob(rules: DataFrame, glob: str) -> Column:
    globs = [r["glob"] for r in rules.select("glob").distinct().collect()]  # as many as rules
    if glob not in globs:
        raise ValueError(f"no rule with glob {glob!r}; there are {', '.join(sorted(globs))}")
    return F.col("glob") == glob


def set_rule_packs(rules: DataFrame, glob: str, list_id: str, packs: list[str], known: list[str] | None = None) -> DataFrame:
    """The rules with ``packs`` bound to the list on the rule of this glob; none takes the binding away. Unknown packs are an error."""
    for p in packs:
        if known is not None and p not in known:
            raise ValueError(f"no pack {p!r}; there are {', '.join(sorted(known))}")
    here, empty = _with_glob(rules, glob), F.create_map().cast(_PACKS)
    rest = F.map_filter(F.coalesce("packs", empty), lambda k, _: k != list_id)
    new = F.map_concat(rest, F.create_map(F.lit(list_id), F.array(*[F.lit(p) for p in packs]))) if packs else rest
    return rules.withColumn("packs", F.when(here, F.when(F.size(new) > 0, new)).otherwise(F.col("packs")))


def set_rule_disable(rules: DataFrame, glob: str, checks: list[str], known: list[str] | None = None) -> DataFrame:
    """The rules with exactly these checks disabled on the rule of this glob. Unknown checks are an error."""
    for c in checks:
        if known is not None and c not in known:
            raise ValueError(f"no check {c!r}; there are {', '.join(sorted(known))}")
    here = _with_glob(rules, glob)
    return rules.withColumn("disable", F.when(here, F.array(*[F.lit(c) for c in checks]) if checks else F.lit(None).cast(_IDS)).otherwise(F.col("disable")))


def _known(rules: DataFrame, checks: DataFrame, lists: DataFrame) -> DataFrame:
    """``rules`` with lists (of its ruleset) and ids (checks of its ruleset and of that for embedded prose)."""
    by_list = lists.groupBy(F.col("ruleset").alias("of")).agg(F.collect_set("list_id").alias("lists"))
    by_check = checks.groupBy(F.col("ruleset").alias("of")).agg(F.collect_set("check_id").alias("ids"))
    none = F.array().cast(_IDS)
    out = rules.join(F.broadcast(by_list), F.col("ruleset") == F.col("of"), "left").drop("of")  # one row a ruleset
    out = out.join(F.broadcast(by_check.withColumnRenamed("ids", "own")), F.col("ruleset") == F.col("of"), "left").drop("of")
    out = out.join(F.broadcast(by_check.withColumnRenamed("ids", "inner")), F.col("embedded_prose") == F.col("of"), "left").drop("of")
    return out.withColumns({"lists": F.coalesce("lists", none), "ids": F.array_union(F.coalesce("own", none), F.coalesce("inner", none))}).drop("own", "inner")


def orphaned_extras(rules: DataFrame, checks: DataFrame, lists: DataFrame) -> DataFrame:
    """glob, packs, disable: what a rule still carries for lists and checks that its rulesets don't have. Rules out of scope carry nothing."""
    known = _known(rules.filter(F.col("ruleset").isNotNull()), checks, lists)
    packs = F.map_filter(F.coalesce("packs", F.create_map().cast(_PACKS)), lambda k, v: ~F.array_contains("lists", k) & (F.size(v) > 0))
    dead = F.filter(F.coalesce("disable", F.array().cast(_IDS)), lambda c: ~F.array_contains("ids", c))
    out = known.select("ord", "glob", F.when(F.size(packs) > 0, packs).alias("packs"), F.when(F.size(dead) > 0, dead).alias("disable"))
    return out.filter("packs is not null or disable is not null").orderBy("ord").drop("ord")


def pruned(rules: DataFrame, checks: DataFrame, lists: DataFrame, which: Column | None = None) -> DataFrame:
    """The rules without their orphaned extras, or those of ``which`` rows only."""
    known = _known(rules, checks, lists)
    here = (F.col("ruleset").isNotNull() if which is None else which) & F.lit(True)
    packs = F.map_filter("packs", lambda k, v: F.array_contains("lists", k) & (F.size(v) > 0))
    disable = F.filter("disable", lambda c: F.array_contains("ids", c))
    out = known.withColumns({"packs": F.when(here, packs).otherwise(F.col("packs")), "disable": F.when(here, disable).otherwise(F.col("disable"))})
    return out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("packs", "disable")}).select(*rules.columns)


def save_rules(new: DataFrame, old: DataFrame, checks: DataFrame, lists: DataFrame) -> DataFrame:
    """The rules to write for ``new`` (columns of RULE; null where it says nothing) over ``old``.

    A rule inherits what it says nothing about from the old rule of its glob. If its
    rulesets change, packs and disabled checks that these don't know go. An unknown ruleset,
    or embedded prose for files that have none, is an error.
    """
    for r in new.select("ruleset", "embedded_prose", "glob").collect():  # as many as rules
        for name in (r["ruleset"], r["embedded_prose"]):
            if name is not None:
                ruleset(name)
        if r["embedded_prose"] and not r["glob"].endswith(".py"):
            raise ValueError(f"no literals are read from {r['glob']!r}")
    was = old.groupBy("glob").agg(*[F.first(c).alias(f"old_{c}") for c in ("ruleset", "packs", "disable", "embedded_prose")])
    both = new.join(F.broadcast(was), "glob", "left").withColumns({c: F.coalesce(c, f"old_{c}") for c in ("packs", "disable", "embedded_prose")})
    moved = ~(F.col("ruleset").eqNullSafe(F.col("old_ruleset")) & F.col("embedded_prose").eqNullSafe(F.col("old_embedded_prose")))
    return pruned(both, checks, lists, moved).select(*new.columns).orderBy("ord")


def enable_exactly(checks: DataFrame, ids: list[str]) -> DataFrame:
    """``checks`` with enabled: these and only these. For a caller who sees all checks."""
    _all_known(checks, ids)
    return checks.withColumn("enabled", F.col("check_id").isin(*ids) if ids else F.lit(False))


def enable(checks: DataFrame, states: dict[str, bool]) -> DataFrame:
    """``checks`` (with enabled, or all on) with these turned on or off and all others as they were. For a partial view."""
    _all_known(checks, list(states))
    was = F.col("enabled") if "enabled" in checks.columns else F.lit(True)
    for c, on in states.items():
        was = F.when(F.col("check_id") == c, F.lit(on)).otherwise(was)
    return checks.withColumn("enabled", was)


def _all_known(checks: DataFrame, ids: list[str]) -> None:
    have = {r["check_id"] for r in checks.select("check_id").distinct().collect()}  # as many as are declared
    if set(ids) - have:
        raise ValueError(f"unknown checks: {', '.join(sorted(set(ids) - have))}")


def add_term_list(lists: DataFrame, rules: str, list_id: str, *, feeds: str | None = None, content: str = "word", polarity: str = "deny", packs: bool = False, additions: bool = True) -> DataFrame:
    """``lists`` with a list of one's own; a bad id, one that is there already, or an unknown check to feed is an error."""
    list_id = list_id.strip().lower()
    if not re.fullmatch(r"[a-z][a-z0-9_]*", list_id):
        raise ValueError(f"list id {list_id!r}: a letter, then letters, digits and underscores")
    if lists.filter((F.col("ruleset") == rules) & (F.col("list_id") == list_id)).limit(1).count():
        raise ValueError(f"{rules} has a list {list_id!r} already")
    if feeds is not None and feeds not in ruleset(rules).table():
        raise ValueError(f"{rules} has no check {feeds!r}")
    row = (rules, list_id, feeds, content, polarity if polarity in ("allow", "deny") else "deny", packs, additions)
    return lists.unionByName(lists.sparkSession.createDataFrame([row], lists.schema))


def extra_by_check(resolved: DataFrame, lists: DataFrame) -> DataFrame:
    """ruleset, check_id, terms: for each check, the terms in force of all lists that feed it, sorted.

    resolved: ruleset, list_id, term. This is what a run takes as ``extra``.
    """
    fed = lists.filter(F.col("feeds").isNotNull()).select("ruleset", "list_id", F.col("feeds").alias("check_id"))
    return resolved.join(F.broadcast(fed), ["ruleset", "list_id"]).groupBy("ruleset", "check_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # one row a list
