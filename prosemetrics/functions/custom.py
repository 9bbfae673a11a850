"""Custom checks: user functions and patterns."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks.base import UNITS, Check, Ruleset
from ..operators.structure import with_units
from .patterns import all_matches, each

_ID = re.compile(r"^[a-z][a-z0-9_]*$")


class InvalidCheck(ValueError):
    pass


def _valid(check_id: str, unit: str, rules: Ruleset) -> None:
    if not _ID.match(check_id):
        raise InvalidCheck(f"{check_id!r} is no check id")
    if unit not in UNITS:
        raise InvalidCheck(f"no unit {unit!r}")
    if check_id in rules.table():
        raise InvalidCheck(f"{check_id!r} is a built-in check")


def pattern_check(rules: Ruleset, check_id: str, pattern: str, note: str = "", unit: str = "SENTENCE", ignore_case: bool = True, terms: tuple[str, ...] = (), **more) -> Check:
    """A check of a pattern, or of bounded terms, in native expressions."""
    _valid(check_id, unit, rules)
    whole = pattern or r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b"
    return Check(check_id, unit, lambda s, _: each(all_matches(s, whole, ignore_case), rule=f"custom.{check_id}", note=note), **more)


def python_flags(docs: DataFrame, rules: Ruleset, check_id: str, find: Callable[[str], list[tuple[str, str]]], unit: str = "SENTENCE", *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Flags (key, item_ord, hit_ord, kind, label, text, bucket, note) of a Python function from an item to (phrase, note) pairs.

    It runs over Arrow batches of sentences, list lines or whole documents. The flags are semantic.
    """
    _valid(check_id, unit, rules)
    if unit not in ("SENTENCE", "LINE", "DOCUMENT"):
        raise InvalidCheck(f"Python checks do not see {unit}")
    if not callable(find) or len(inspect.signature(find).parameters) != 1:
        raise InvalidCheck("a check takes the item and nothing else")
    units = with_units(docs.select(key, text), text)
    items = {"SENTENCE": F.transform("sentences", lambda s: s["sentence"]), "LINE": F.col("list_lines"), "DOCUMENT": F.array(F.coalesce(F.col(text), F.lit("")))}[unit]
    rows = units.select(key, F.posexplode(items).alias("item_ord", "text"))

    def run(batches):
        for b in batches:
            out = [(k, i, j, check_id, phrase, t, "semantic", note) for k, i, t in zip(b[key], b["item_ord"], b["text"]) for j, (phrase, note) in enumerate(find(t))]
            yield pd.DataFrame(out, columns=[key, "item_ord", "hit_ord", "kind", "label", "text", "bucket", "note"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"{key} {kind}, item_ord int, hit_ord int, kind string, label string, text string, bucket string, note string")


def fields_of(check: Check) -> dict:
    """What can be told of a check: id, unit, kind, action, threshold and source, if there is one."""
    try:
        source = inspect.getsource(check.find)
    except (OSError, TypeError):
        source = None
    return {"id": check.id, "unit": check.unit, "kind": check.kind, "action": check.action, "threshold": check.threshold, "source": source}
