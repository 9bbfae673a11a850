"""Style rules of the YAML form ``extends: existence | substitution`` as checks.

What can't be expressed exactly is refused by name, never approximated. Patterns must
compile in Java, which will run them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..checks.base import Check
from ..functions.patterns import all_matches, each, lookup, rx
from pyspark.sql import functions as F


# What a rule's level does.
ACTIONS = {"suggestion": "warn", "warning": "warn", "error": "block"}
PREFIX = "vale"


class Refused(ValueError):
    """The rule uses what this engine does not do."""


@dataclass
class Rule:
    name: str
    extends: str = ""
    message: str = ""
    level: str = "suggestion"
    ignorecase: bool = False
    nonword: bool = False
    tokens: list[str] = field(default_factory=list)
    raw: list[str] = field(default_factory=list)
    swap: dict[str, str] = field(default_factory=dict)
    other: dict[str, str] = field(default_factory=dict)


def _scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1] if m[1] in "\"\\" else m[0]), text[1:-1])
    return re.sub(r"\s+#.*$", "", text)


def _entry(line: str) -> tuple[str, str]:
    m = re.match(r"""\s*('(?:[^']|'')*'|"(?:\\.|[^"])*"|[^\s:'"#][^:]*(?::(?!\s|$)[^:]*)*?)\s*:(?:\s+(.*))?$""", line)
    if not m:
        raise Refused(f"can't read {line.strip()!r}")
    return _scalar(m[1]), _scalar(m[2] or "")


def parse(name: str, text: str) -> Rule:
    rule, block = Rule(name), None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        if line.lstrip().startswith("- ") and block in ("tokens", "raw"):
            getattr(rule, block).append(_scalar(line.lstrip()[2:]))
        elif line[0] in " \t" and block == "swap":
            k, v = _entry(line)
            rule.swap[k] = v
        elif line[0] not in " \t":
            key, value = _entry(line)
            block = key if not value and key in ("tokens", "raw", "swap") else None
            if key in ("ignorecase", "nonword"):
                setattr(rule, key, value.lower() == "true")
            elif key in ("extends", "message", "level"):
                setattr(rule, key, value)
            elif block is None:
                rule.other[key] = value
        else:
            raise Refused(f"{name}: can't read {line.strip()!r}")
    return rule


def catches_and_remedy(message: str) -> tuple[str, str]:
    """A message in two at its first colon: what is caught, and what to do instead."""
    caught, _, instead = message.replace("%s", "this").strip().partition(":")
    return caught.strip(), instead.strip() if ":" in message else "rewrite it"


def convert(rule: Rule, spark: SparkSession | None = None, prefix: str = PREFIX) -> Check:
    """The rule as a sentence check that reports the first match of a sentence.

    ``spark`` compiles the pattern in Java, else Python's own compiler must do.
    """
    if rule.level.lower() not in ACTIONS:
        raise Refused(f"{rule.name}: unknown level {rule.level!r}")
    if rule.extends not in ("existence", "substitution"):
        raise Refused(f"{rule.name}: extends {rule.extends or 'nothing'}")
    odd = set(rule.other) - {"link", "description", "scope", "limit", "action"}
    if odd or rule.other.get("scope", "text") not in ("text", "sentence", "raw", ""):
        raise Refused(f"{rule.name}: {', '.join(sorted(odd)) or 'scope ' + rule.other['scope']}")
    terms = list(rule.swap) if rule.extends == "substitution" else rule.tokens
    if rule.raw and rule.extends == "existence":
        pattern = "".join(rule.raw) + ("(?:" + "|".join(terms) + ")" if terms else "")
    elif terms:
        body = "(?:" + "|".join(terms) + ")"
        pattern = body if rule.nonword else rf"\b{body}\b"
    else:
        raise Refused(f"{rule.name}: no terms")
    if spark is not None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(rx(pattern, rule.ignorecase))
        except Exception as e:
            raise Refused(f"{rule.name}: the pattern does not compile") from e
    else:
        re.compile(pattern)
    swap = rule.swap

    _, remedy = catches_and_remedy(rule.message)

    def find(s, _):
        first = F.slice(all_matches(s, pattern, rule.ignorecase), 1, 1)
        if not swap:
            return each(first, rule=f"imported.{rule.name}", note=remedy)
        to = lambda w: F.coalesce(lookup(swap, w), lookup(swap, F.lower(w)))
        note = lambda w: F.coalesce(F.concat(F.lit("use '"), to(w), F.lit("' instead")), F.lit("rephrase it"))
        return each(first, rule=f"imported.{rule.name}", note=note, replacement=to)

    return Check(check_id(rule.name, prefix), "SENTENCE", find, action=ACTIONS[rule.level.lower()])


def check_id(name: str, prefix: str = PREFIX) -> str:
    """In snake case, behind the prefix of its package; an empty prefix adds nothing."""
    snake = re.sub(r"[^a-z0-9_]+", "_", re.sub(r"\B(?=[A-Z])", "_", name).lower()).strip("_")
    return f"{prefix}_{snake}" if prefix else snake


def import_rules(files: list[tuple[str, str]], spark: SparkSession | None = None, prefix: str = PREFIX) -> tuple[list[Check], list[tuple[str, str]]]:
    """Checks from (name, text) pairs, and (name, reason) of the rules that were refused."""
    done, refused = [], []
    for name, text in files:
        try:
            done.append(convert(parse(name, text), spark, prefix))
        except (Refused, re.error) as e:
            refused.append((name, str(e)))
    return done, refused
