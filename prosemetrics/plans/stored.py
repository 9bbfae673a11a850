"""Rulesets as rows: stored, checked row by row, and compiled to column expressions.

A row declares one check; a row without a check id declares a ruleset that has none yet.
What can't be compiled is put aside with its reason, and the other rows go on.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..checks.base import Check, Ruleset
from ..functions.patterns import all_matches, any_of, count_matches, each, first_match, found, hit, one_if, rx, says
from . import registry

SCHEMA = (
    "ruleset string, check_id string, ord int, unit string, finder string, pattern string, terms array<string>, "
    "least int, note string, bucket string, threshold int, action string"
)
REFUSED = "ruleset string, check_id string, reason string"
#: Declarations that one table may hold, and terms that one row may list: more are no declaration but data.
MOST_ROWS, MOST_TERMS = 10_000, 20_000
STORED_UNITS = ("SENTENCE", "LINE", "DOCUMENT")
# What a flag can lead to.
ACTIONS = ("warn", "block")
BUCKETS = ("semantic", "mechanical")
_ID = re.compile(r"[a-z][a-z0-9_]*")


def _words(item: Column) -> Column:
    return count_matches(item, r"\S+")


def _terms(row: Row, context: dict) -> list[str]:
    return [*dict.fromkeys((*(row["terms"] or ()), *context.get("extra", {}).get(row["check_id"], ())))]


def _find_pattern(row: Row):
    return lambda x, _: each(all_matches(x, row["pattern"], True), rule=_rule(row), note=row["note"])


def _find_words(row: Row):
    return lambda x, context: each(all_matches(x, any_of(_terms(row, context)), True), rule=_rule(row), note=row["note"])


def _find_opening(row: Row):
    def find(x: Column, context: dict) -> Column:
        start = first_match(x, r"\A\s*" + any_of(_terms(row, context)), True)
        return one_if(start.isNotNull(), hit(F.trim(start), rule=_rule(row), note=row["note"]))

    return find


def _find_repeated(row: Row):
    def find(x: Column, _) -> Column:
        n = count_matches(x, row["pattern"], True)
        return one_if(n >= row["least"], hit(rule=_rule(row), note=row["note"], occurrences=n))

    return find


def _find_longer(row: Row):
    return lambda x, _: one_if(_words(x) > row["least"], hit(rule=_rule(row), note=row["note"]))


def _find_missing(row: Row):
    return lambda x, _: one_if(~found(x, row["pattern"], True), hit(rule=_rule(row), note=row["note"]))


#: Kinds of finder, and what a row must give for one.
FINDERS = {
    "pattern": (_find_pattern, ("pattern",)),  # every match of the pattern
    "words": (_find_words, ("terms",)),  # every one of the terms, between word bounds
    "opening": (_find_opening, ("terms",)),  # an item that begins with one of the terms
    "repeated": (_find_repeated, ("pattern", "least")),  # an item that holds the pattern so many times
    "longer": (_find_longer, ("least",)),  # an item of more words than that
    "missing": (_find_missing, ("pattern",)),  # an item without the pattern
}


def _rule(row: Row) -> str:
    return f"stored.{row['check_id']}"


def _bad_pattern(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern can't be used. Spark itself compiles it, on a row of its own on the driver."""
    try:
        empty = spark.range(1).select(F.lit("").rlike(rx(pattern, True)).alias("empty")).first()["empty"]
    except (AnalysisException, PySparkException) as e:
        return f"the pattern does not compile: {str(e).splitlines()[0][:200]}"
    return "the pattern matches the empty text" if empty else None


def _reason(spark: SparkSession, row: Row, seen: set) -> str | None:
    """Why a row is refused, or None."""
    ruleset, check = row["ruleset"], row["check_id"]
    if ruleset is None or not _ID.fullmatch(ruleset):
        return "the ruleset's id must begin with a lower-case letter and hold letters, digits and underscores"
    if ruleset in registry.built_in():
        return f"{ruleset!r} is built in"
    if check is None:
        return None
    if not _ID.fullmatch(check):
        return "the check's id must begin with a lower-case letter and hold letters, digits and underscores"
    if (ruleset, check) in seen:
        return f"{check!r} is declared before"
    if row["unit"] not in STORED_UNITS:
        return f"no unit {row['unit']!r}; there are {', '.join(STORED_UNITS)}"
    if row["finder"] not in FINDERS:
        return f"no finder {row['finder']!r}; there are {', '.join(FINDERS)}"
    needs = FINDERS[row["finder"]][1]
    if "terms" in needs:
        terms = row["terms"] or []
        if not terms or any(t is None or not t.strip() for t in terms):
            return "a list of terms is wanted, none of them empty"
        if len(terms) > MOST_TERMS:
            return f"more than {MOST_TERMS} terms"
    if "least" in needs and (row["least"] is None or row["least"] < 1):
        return "least must be 1 or more"
    if row["bucket"] not in (None, *BUCKETS):
        return f"no bucket {row['bucket']!r}"
    if row["action"] not in (None, *ACTIONS):
        return f"no action {row['action']!r}"
    if row["threshold"] is not None and row["threshold"] < 1:
        return "threshold must be 1 or more"
    if "pattern" in needs:
        return "a pattern is wanted" if not row["pattern"] else _bad_pattern(spark, row["pattern"])
    return None


def _check(row: Row) -> Check:
    likely = says(*row["terms"], terms=row["check_id"]) if row["finder"] in ("words", "opening") else None
    return Check(
        row["check_id"], row["unit"], FINDERS[row["finder"]][0](row), bucket=row["bucket"] or "semantic",
        threshold=row["threshold"] or 1, action=row["action"] or "warn", likely=likely if row["unit"] == "SENTENCE" else None,
    )


def _declared(rows: DataFrame) -> list[Row]:
    """The rows, which people wrote: a table beyond ``MOST_ROWS`` is an error and not read whole."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    held = rows.select(*names).limit(MOST_ROWS + 1).collect()
    if len(held) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} declarations")
    last = 1 << 31
    return sorted(held, key=lambda r: (r["ruleset"] or "", last if r["ord"] is None else r["ord"], r["check_id"] or ""))


def compile_rows(rows: DataFrame) -> tuple[dict[str, Ruleset], list[Row]]:
    """Rulesets by id, and the refused rows (ruleset, check_id, reason).

    rows: ``SCHEMA``, in any order, further columns ignored. Checks come by ord (null last),
    then id. A ruleset whose every check is refused is there without checks. A repeated
    check id keeps its first row. Null bucket, threshold and action are semantic, 1 and warn.
    """
    spark, made, refused, seen = rows.sparkSession, {}, [], set()
    for row in _declared(rows):
        reason = _reason(spark, row, seen)
        if reason is None or (row["ruleset"] and _ID.fullmatch(row["ruleset"]) and row["ruleset"] not in registry.built_in()):
            made.setdefault(row["ruleset"], [])
        if reason is not None:
            refused.append(Row(ruleset=row["ruleset"], check_id=row["check_id"], reason=reason))
        elif row["check_id"] is not None:
            seen.add((row["ruleset"], row["check_id"]))
            made[row["ruleset"]].append(_check(row))
    return {name: Ruleset(name, tuple(checks), whole="sentences") for name, checks in made.items()}, refused


def install(rows: DataFrame) -> DataFrame:
    """Register what the rows declare, so that ``lint(docs, id)`` and routing know it; gives the refused rows."""
    made, refused = compile_rows(rows)
    for one in made.values():
        registry.register(one, empty=True)
    return rows.sparkSession.createDataFrame(refused, REFUSED)


# --- the stored table ---------------------------------------------------------------------
def _generations(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMA + ", generation long").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: those of the newest generation; none where nothing is stored."""
    held = _generations(spark, path)
    newest = held.agg(F.max("generation")).first()[0] if held is not None else None
    if newest is None:
        return spark.createDataFrame([], SCHEMA)
    return held.filter((F.col("generation") == newest) & F.col("ruleset").isNotNull()).drop("generation")


def _store(spark: SparkSession, path: str, rows: list[Row]) -> None:
    """A new generation in one file, which appears whole or not at all; the one before stays. One writer at a time."""
    held = _generations(spark, path)
    newest = (held.agg(F.max("generation")).first()[0] if held is not None else None) or 0
    nothing = [None] * len(SCHEMA.split(", "))  # a generation may have no rules and is still one
    table = spark.createDataFrame([nothing, *[tuple(r) for r in rows]], SCHEMA)
    table.withColumn("generation", F.lit(newest + 1).cast("long")).coalesce(1).write.mode("append").partitionBy("generation").parquet(path)


def scaffold(spark: SparkSession, path: str, ruleset: str) -> None:
    """Store a ruleset that has no checks yet; a bad id, a built-in one or one that is there is refused."""
    rows = _declared(load(spark, path))
    new = Row(*[f.split()[0] for f in SCHEMA.split(", ")])(ruleset, *[None] * (len(SCHEMA.split(", ")) - 1))
    reason = _reason(spark, new, set())
    if reason is None and any(r["ruleset"] == ruleset for r in rows):
        reason = f"there is a ruleset {ruleset!r}"
    if reason is not None:
        raise ValueError(reason)
    _store(spark, path, [*rows, new])


def save(rows: DataFrame, path: str) -> DataFrame:
    """Add checks to the stored rulesets, or put them in the place of those with their ids; gives the refused rows.

    Only rows that compile are stored, so a broken one never replaces one that works.
    """
    spark = rows.sparkSession
    made, refused = compile_rows(rows)
    good = {(name, c.id) for name, r in made.items() for c in r.checks}
    new, taken = [], set()
    for r in _declared(rows):
        key = (r["ruleset"], r["check_id"])
        if (key in good or (r["check_id"] is None and r["ruleset"] in made)) and key not in taken:
            taken.add(key)
            new.append(r)
    kept = [r for r in _declared(load(spark, path)) if (r["ruleset"], r["check_id"]) not in taken]
    _store(spark, path, [*kept, *new])
    return spark.createDataFrame(refused, REFUSED)


def remove(spark: SparkSession, path: str, ruleset: str, check_id: str | None = None) -> None:
    """Drop one check, or with none named the whole ruleset; what is not there is no error. A ruleset outlives its last check."""
    rows = _declared(load(spark, path))
    kept = [r for r in rows if r["ruleset"] != ruleset or (check_id is not None and r["check_id"] != check_id)]
    if check_id is not None and any(r["ruleset"] == ruleset for r in rows) and not any(r["ruleset"] == ruleset for r in kept):
        kept.append(Row(*[f.split()[0] for f in SCHEMA.split(", ")])(ruleset, *[None] * (len(SCHEMA.split(", ")) - 1)))
    _store(spark, path, kept)


def rename(spark: SparkSession, path: str, ruleset: str, to: str) -> None:
    """Give a stored ruleset another id; its checks stay as they are."""
    rows = _declared(load(spark, path))
    if not any(r["ruleset"] == ruleset for r in rows):
        raise ValueError(f"no stored ruleset {ruleset!r}")
    if not _ID.fullmatch(to or "") or to in registry.built_in() or any(r["ruleset"] == to for r in rows):
        raise ValueError(f"{to!r} can't be the id of a ruleset, or is one already")
    _store(spark, path, [Row(**{**r.asDict(), "ruleset": to}) if r["ruleset"] == ruleset else r for r in rows])
