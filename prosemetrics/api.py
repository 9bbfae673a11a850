"""The functions a user starts from."""

from __future__ import annotations

from .operators import corpus, experiment, history
from .operators.corpus import activity, calibrate, compare, consensus
from .operators.fix import fix
from .operators.lint import dedup, flags, gate, lint, ratchet, verdicts
from .operators.routing import effective_config, explain, route
from .operators.terms import resolve as resolve_terms
from .operators.vocabulary import check_word, vocabulary_flags
from .plans.registry import check_table, register, ruleset, rulesets, term_lists
from .sources.files import scan_tree as scan
from .sources.rule_import import import_rules

__all__ = ["activity", "calibrate", "check_table", "check_word", "compare", "consensus", "corpus", "dedup", "effective_config", "experiment", "explain", "fix", "flags", "gate", "history", "import_rules", "lint", "ratchet", "register", "resolve_terms", "route", "ruleset", "rulesets", "scan", "term_lists", "verdicts", "vocabulary_flags"]
