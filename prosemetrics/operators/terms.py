"""Layered vocabularies: built-in, packs and project terms, less what was removed.

terms: ruleset, list_id, term, layer (built_in, pack, project), pack, note, removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = ("ruleset", "list_id", "term")
SCHEMA = "ruleset string, list_id string, term string, layer string, pack string, note string, removed boolean"


def _rank():
    return F.when(F.col("layer") == "project", 3).when(F.col("layer") == "pack", 2).otherwise(1)


def resolve(terms: DataFrame, packs: list[str] | None = None, forbidden: DataFrame | None = None) -> DataFrame:
    """One row a term: its winning layer (project, then pack, then built-in), note, and state.

    state: effective; suppressed (a row with ``removed`` says so); rejected (a pack term
    that ``forbidden`` (term) lists, which may not be allowed again). packs: those that
    are turned on; None: all.
    """
    rows = terms.withColumn("term", F.lower("term"))
    on = (F.col("layer") != "pack") | F.lit(packs is None) | F.col("pack").isin(*(packs or [""]))
    tombs = rows.filter("removed").select(*_KEY).distinct().withColumn("gone", F.lit(True))
    live = rows.filter(~F.col("removed") & on).withColumn("nth", F.row_number().over(Window.partitionBy(*_KEY).orderBy(_rank().desc(), "pack"))).filter("nth = 1")
    live = live.join(tombs, [*_KEY], "left")
    if forbidden is not None:
        live = live.join(forbidden.select(F.lower("term").alias("term"), F.lit(True).alias("banned")).distinct(), "term", "left")
    else:
        live = live.withColumn("banned", F.lit(None).cast("boolean"))
    state = F.when(F.col("banned") & (F.col("layer") == "pack"), "rejected").when(F.col("gone"), "suppressed").otherwise("effective")
    return live.select(*_KEY, "layer", "pack", "note", state.alias("state"))


def extras(resolved: DataFrame) -> DataFrame:
    """The terms that checks get besides their built-ins: packs and project. Removing a built-in does not stop its check."""
    return resolved.filter("state = 'effective' and layer <> 'built_in'")


def layer_counts(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """ruleset, list_id, built_in, packs, project, suppressed, effective."""
    raw = terms.filter("not removed").groupBy("ruleset", "list_id").agg(*[F.count_distinct(F.when(F.col("layer") == k, F.lower("term"))).alias(n) for k, n in (("built_in", "built_in"), ("pack", "packs"), ("project", "project"))])
    res = resolved.groupBy("ruleset", "list_id").agg(F.count_if(F.col("state") == "suppressed").alias("suppressed"), F.count_if(F.col("state") == "effective").alias("effective"))
    return raw.join(res, ["ruleset", "list_id"], "left").fillna(0)


def search(resolved: DataFrame, words: str) -> DataFrame:
    """Terms whose term or note holds the words, suppressed ones too."""
    return resolved.filter(F.contains(F.lower("term"), F.lit(words.lower())) | F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit(words.lower())))


def add_term(terms: DataFrame, ruleset: str, list_id: str, term: str, note: str = "", closed: bool = False, forbidden: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The terms with a project term, and what happened: added, present, closed, invalid or forbidden."""
    term = term.strip().lower()
    here = terms.filter((F.col("ruleset") == ruleset) & (F.col("list_id") == list_id) & (F.lower("term") == term))
    if not term:
        return terms, "invalid"
    if closed:
        return terms, "closed"
    if forbidden is not None and forbidden.filter(F.lower("term") == term).limit(1).count():
        return terms, "forbidden"
    if here.filter("removed").limit(1).count():
        return restore_term(terms, ruleset, list_id, term)
    if here.filter("layer = 'project'").limit(1).count():
        return terms, "present"
    return terms.unionByName(terms.sparkSession.createDataFrame([(ruleset, list_id, term, "project", None, note, False)], SCHEMA)), "added"


def remove_term(terms: DataFrame, ruleset: str, list_id: str, term: str) -> tuple[DataFrame, str]:
    """A project term goes; a term of another layer gets a tombstone."""
    here = (F.col("ruleset") == ruleset) & (F.col("list_id") == list_id) & (F.lower("term") == term.lower())
    if terms.filter(here & (F.col("layer") == "project") & ~F.col("removed")).limit(1).count():
        return terms.filter(~(here & (F.col("layer") == "project"))), "removed"
    if not terms.filter(here & ~F.col("removed")).limit(1).count():
        return terms, "absent"
    return terms.unionByName(terms.sparkSession.createDataFrame([(ruleset, list_id, term.lower(), "project", None, None, True)], SCHEMA)), "suppressed"


def restore_term(terms: DataFrame, ruleset: str, list_id: str, term: str) -> tuple[DataFrame, str]:
    here = (F.col("ruleset") == ruleset) & (F.col("list_id") == list_id) & (F.lower("term") == term.lower())
    return terms.filter(~(here & F.col("removed"))), "restored"


def remedies(checks: DataFrame, lists: DataFrame) -> DataFrame:
    """check_id, list_id, polarity: the lists that a user can edit to change what a check finds."""
    return checks.join(F.broadcast(lists.select("ruleset", F.col("feeds").alias("check_id"), "list_id", "polarity")), ["ruleset", "check_id"])


def orphans(extra: DataFrame, known: DataFrame) -> DataFrame:
    """Entries (ruleset, list_id) that no list declares."""
    return extra.join(known.select("ruleset", "list_id").distinct(), ["ruleset", "list_id"], "left_anti")


def admissible(lists: DataFrame, packs: DataFrame) -> DataFrame:
    """ruleset, list_id, pack_id, reason: the packs that each list can read.

    lists: content_kind (and accepts_kinds, if a list reads more than its own kind); packs:
    pack_id, content_kind. Patterns aren't read as words, nor words as phrases. Where either
    side says nothing of its kind, the pack is let in and reason says so. Packs are matched
    by kind, of which there are few, so lists and packs do not meet pair by pair.
    """
    kinds = F.col("accepts_kinds") if "accepts_kinds" in lists.columns else F.lit(None).cast("array<string>")
    wanted = lists.filter("accepts_packs").select("ruleset", "list_id", F.coalesce(kinds, F.array("content_kind")).alias("kinds"))
    wanted = wanted.withColumn("open", F.exists("kinds", lambda k: k.isNull()) | (F.size("kinds") == 0))
    known = packs.filter(F.col("content_kind").isNotNull()).select("pack_id", F.col("content_kind").alias("kind"))
    fits = wanted.filter(~F.col("open")).select("ruleset", "list_id", F.explode("kinds").alias("kind")).join(known, "kind").select("ruleset", "list_id", "pack_id", F.lit("").alias("reason"))
    undeclared = wanted.join(packs, F.col("open") | F.col("content_kind").isNull()).select("ruleset", "list_id", "pack_id", F.lit("kind undeclared on one side").alias("reason"))
    return fits.unionByName(undeclared).distinct()
