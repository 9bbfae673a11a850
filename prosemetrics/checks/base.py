"""The declaration of a check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in the order in which their flags come.
UNITS = ("BLOCK", "LINE", "SENTENCE", "SENTENCES", "DOCUMENT")


@dataclass(frozen=True)
class Check:
    """find(item, context) gives an array of HITs of one item of the unit.

    bucket: ``mechanical``, ``semantic``, or a function of a hit that is true if mechanical.
    context holds what a run has resolved: extra terms by check, the register, the
    dictionary, whether the file is a script. likely(text, context): whether any item of a
    document can have a hit, a cheap test of its folded sentences (``functions.patterns.folded``);
    null if the context leaves no such test. labels(sentences, context): of a sentence check
    all of whose hits are semantic and have a label, the distinct labels of a document's
    sentences in lower case, for who only counts merged flags.
    """

    id: str
    unit: str
    find: Callable[[Column, dict], Column]
    kind: str = "tell"
    bucket: str | Callable[[Column], Column] = "semantic"
    threshold: int = 1
    action: str = "warn"
    params: dict = field(default_factory=dict)
    terms_list: str | None = None
    likely: Callable[[Column, dict], Column | None] | None = None
    labels: Callable[[Column, dict], Column] | None = None

    def mechanical(self, hit: Column) -> Column:
        return self.bucket(hit) if callable(self.bucket) else F.lit(self.bucket == "mechanical")

    @property
    def bucket_name(self) -> str:
        return "callable" if callable(self.bucket) else self.bucket


@dataclass(frozen=True)
class Ruleset:
    """Checks by id in declared order. whole: what a DOCUMENT check sees, ``raw`` text or joined ``sentences``."""

    id: str
    checks: tuple[Check, ...]
    whole: str = "raw"
    lines: str = "list"  # or "code"
    keep_apart: frozenset = frozenset()  # kinds whose flags are never merged
    dedup: bool = True

    def table(self) -> dict[str, Check]:
        return {c.id: c for c in self.checks}

    def with_checks(self, more: tuple[Check, ...]) -> Ruleset:
        """With custom checks added; one that bears a built-in's id changes nothing."""
        have = self.table()
        new = tuple(c for c in more if c.id not in have)
        return Ruleset(self.id, (*self.checks, *new), self.whole, self.lines, self.keep_apart, self.dedup)
