"""Rulesets by id, and their checks as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..checks import code, controlled, prose
from ..checks.base import Ruleset

_RULESETS: dict[str, Ruleset] = {r.id: r for r in (prose.RULESET, code.RULESET, controlled.RULESET)}

# The vocabulary lists that feed checks: (ruleset, list, check, content, polarity, packs, additions).
TERM_LISTS = (
    ("prose", "weasel_attribution", "weasel_attribution", "phrase", "deny", True, True), ("prose", "marketing_adjective", "marketing_adjective", "word", "deny", True, True),
    ("prose", "filler_verb", "filler_verb", "pattern", "deny", True, True), ("prose", "marketing_cliche", "marketing_cliche", "phrase", "deny", True, True),
    ("prose", "stock_adverb", "stock_adverb", "word", "deny", True, True), ("prose", "copula_avoidance", "copula_avoidance", "phrase", "deny", True, True),
    ("prose", "section_template", "section_template", "phrase", "deny", True, True), ("prose", "terminology", "terminology", "word", "deny", True, True),
    ("code", "generic_naming", "generic_naming", "word", "deny", True, True),
    ("controlled", "approved_words", "vocabulary", "word", "allow", False, False), ("controlled", "unapproved_words", "vocabulary", "word", "deny", False, False),
    ("controlled", "project_terms", "vocabulary", "word", "allow", True, True),
)


class UnknownRuleset(ValueError):
    pass


def ruleset(name: str | Ruleset) -> Ruleset:
    if isinstance(name, Ruleset):
        return name
    if name not in _RULESETS:
        raise UnknownRuleset(f"no ruleset {name!r}; there are {', '.join(sorted(_RULESETS))}")
    return _RULESETS[name]


def rulesets() -> list[str]:
    return sorted(_RULESETS)


#: Rulesets that came with the package, and why others were refused.
_BUILT_IN = frozenset(_RULESETS)
_REFUSED: dict[str, str] = {}
# What a ruleset can offer.
CAPABILITIES = ("checks", "terms", "fix")


def capabilities(name: str | Ruleset) -> tuple[str, ...]:
    """What a ruleset offers: checks, term lists that feed them, fixes (it has mechanical checks)."""
    r = ruleset(name)
    has = {"checks": bool(r.checks), "terms": any(x[0] == r.id for x in TERM_LISTS), "fix": any(c.bucket_name != "semantic" for c in r.checks)}
    return tuple(c for c in CAPABILITIES if has[c])


def built_in() -> frozenset[str]:
    return _BUILT_IN


def register(new: Ruleset, empty: bool = False) -> None:
    """Add or replace a ruleset of one's own; one without checks (unless ``empty``), with repeated ids or a built-in's id is refused."""
    ids = [c.id for c in new.checks]
    if new.id in _BUILT_IN:
        raise ValueError(f"{new.id!r} is built in")
    if not ids and not empty:
        raise ValueError(f"ruleset {new.id!r} has no checks")
    if len(ids) != len(set(ids)):
        raise ValueError(f"ruleset {new.id!r} declares a check twice")
    _RULESETS[new.id] = new


def register_all(makers: dict[str, Callable[[], Ruleset]]) -> dict[str, str]:
    """Register rulesets by the functions that make them; one that fails is put aside with its reason, and the others go on.

    Returns the reasons by name; :func:`refused` gives those of the last call.
    """
    _REFUSED.clear()
    for name, make in makers.items():
        try:
            register(make())
        except Exception as e:  # whatever a user's own ruleset does wrong
            _REFUSED[name] = f"{type(e).__name__}: {e}"
    return dict(_REFUSED)


def refused() -> dict[str, str]:
    return dict(_REFUSED)


def unregister(name: str) -> None:
    """Remove a ruleset of one's own; a built-in one stays."""
    ruleset(name)
    if name in _BUILT_IN:
        raise ValueError(f"{name!r} is built in")
    del _RULESETS[name]


def built_in_terms(spark: SparkSession) -> DataFrame:
    """ruleset, list_id, term, layer, pack, note, removed: the built-in layer of every list."""
    lists = {
        ("prose", "weasel_attribution"): prose.WEASEL_PHRASES, ("prose", "marketing_adjective"): prose.MARKETING_ADJECTIVES, ("prose", "filler_verb"): prose.FILLER_VERBS,
        ("prose", "marketing_cliche"): prose.MARKETING_CLICHES, ("prose", "stock_adverb"): prose.STOCK_ADVERBS, ("prose", "copula_avoidance"): prose.COPULA_DODGES,
        ("prose", "section_template"): prose.SECTION_TEMPLATES, ("code", "generic_naming"): code.GENERIC_STEMS, ("controlled", "unapproved_words"): tuple(controlled.JARGON),
    }
    rows = [(r, l, t, "built_in", None, None, False) for (r, l), terms in lists.items() for t in terms]
    return spark.createDataFrame(rows, "ruleset string, list_id string, term string, layer string, pack string, note string, removed boolean")


def check_table(spark: SparkSession, name: str | Ruleset | None = None) -> DataFrame:
    """dim_check: one row a check, of one ruleset or of all."""
    chosen = [ruleset(name)] if name is not None else [ruleset(r) for r in rulesets()]
    rows = [(r.id, c.id, i, c.unit, c.kind, c.bucket_name, c.threshold, c.action, {k: int(v) for k, v in c.params.items()}, c.terms_list) for r in chosen for i, c in enumerate(r.checks)]
    return spark.createDataFrame(rows, "ruleset string, check_id string, ord int, unit string, kind string, bucket string, threshold int, action string, params map<string,int>, terms_list string")


def term_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*TERM_LISTS], "ruleset string, list_id string, feeds string, content_kind string, polarity string, accepts_packs boolean, accepts_additions boolean")
