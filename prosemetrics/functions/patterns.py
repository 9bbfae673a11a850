"""Regular expressions, globs and hits as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One hit of a check. label: what is shown; note: what to do; occurrences: null counts as one.
HIT = "struct<label:string,rule:string,type:string,auto_fix:boolean,replacement:string,note:string,occurrences:int,text:string>"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern with Unicode classes, and lines that end at a line feed only."""
    return f"(?{'i' if ignore_case else ''}dU){pattern}"


def any_of(terms, bounded: bool = True) -> str:
    """A group that matches any of the terms, the longest first."""
    body = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"\b({body})\b" if bounded else f"({body})"


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(rx(pattern, ignore_case))


def first_match(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The first match, or null."""
    return F.regexp_substr(text, F.lit(rx(pattern, ignore_case)))


def all_matches(text: Column, pattern: str, ignore_case: bool = False, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, ignore_case)), F.lit(group))


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, ignore_case)))


def group(text: Column, pattern: str, number: int, ignore_case: bool = False) -> Column:
    return F.regexp_extract(text, rx(pattern, ignore_case), number)


def hit(label=None, rule: str = "", kind=None, auto_fix: bool | Column | None = False, replacement=None, note=None, occurrences=None, text=None) -> Column:
    """One HIT; values are columns or constants."""

    def of(value, type_: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(type_)

    return F.struct(
        of(label, "string").alias("label"), of(rule, "string").alias("rule"), of(kind, "string").alias("type"), of(auto_fix, "boolean").alias("auto_fix"),
        of(replacement, "string").alias("replacement"), of(note, "string").alias("note"), of(occurrences, "int").alias("occurrences"), of(text, "string").alias("text"),
    )


def no_hits() -> Column:
    return F.array().cast(f"array<{HIT}>")


def one_if(condition: Column, value: Column) -> Column:
    """An array of the hit if the condition holds, else an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(no_hits())


def each(labels: Column, **values) -> Column:
    """A hit for each of an array of labels; values may be functions of the label."""
    return F.transform(labels, lambda x: hit(x, **{k: v(x) if callable(v) and not isinstance(v, Column) else v for k, v in values.items()}))


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once even when lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


_ODD = "\u0130\u0131\u017f\u212a"  # what Unicode folds to i, s and k besides


def has_any(text: Column, literals) -> Column:
    """Whether ``text`` has one of a few literals."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals], F.lit(False))


def folded(text: Column) -> Column:
    """Lower case, in which a pattern's ASCII letters stand wherever it can match them whatever their case."""
    return let(text, lambda t: F.lower(F.when(has_any(t, _ODD), F.translate(t, _ODD, "iisk")).otherwise(t)))


def longest(literals) -> str:
    """A pattern of the longest of the literals that begins at a place: each character is looked at once, however many they are."""
    heads: dict[str, list[str]] = {}
    for x in literals:
        if x:
            heads.setdefault(x[0], []).append(x[1:])
    ways = [re.escape(h) + longest(tails) for h, tails in sorted(heads.items())]
    some = "" if not ways else ways[0] if len(ways) == 1 and "" not in literals else f"(?:{'|'.join(ways)})"
    return some + "?" if ways and "" in literals else some


def heard(text: Column, literals) -> Column:
    """Those of the literals that begin in ``text`` behind what is no ASCII letter, by one pass; where several begin at one place, the longest stands for all."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^a-z](?=({longest(literals)}))"), F.lit(1)))


def is_heard(found_: Column, some, literals) -> Column:
    """Whether ``found_``, heard of ``literals``, tells of any of ``some``."""
    return F.arrays_overlap(found_, F.array(*[F.lit(x) for x in literals if x.startswith(tuple(some))]))


def says(*some: str, terms: str | None = None, begins: bool = False):
    """A test that folded text has one of the literals, or of the terms that the context adds to check ``terms``.

    Terms beyond ASCII fold in more ways than one, so with such there is no test.
    begins: hits have their literal at the beginning of a word (or of an item), so tests may
    share one pass over the text (``heard``) if their ``literals(context)`` are letters first.
    """

    def literals(context: dict) -> tuple[str, ...] | None:
        all_of = dict.fromkeys(x.lower() for x in (*some, *context.get("extra", {}).get(terms, ())))
        return tuple(all_of) if all(x and x.isascii() for x in all_of) else None

    def test(text: Column, context: dict) -> Column | None:
        all_of = literals(context)
        return None if all_of is None else has_any(text, all_of)

    if begins:
        test.literals = literals
    return test


def lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored pattern; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append(f"[{'^' + body[1:] if body.startswith('!') else body}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)\\A{''.join(out)}\\z"
