"""Texts that shell commands write: here-documents, echo or printf into a file, and into tee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ("md", "txt", "rst", "py")
# What makes the text of a command unsure.
UNSURE, EXPANDS = r"\$\(|`|<<.*<<", r"[$`]"


def _written(target: Column, text: Column, quoted: Column, sure: Column) -> Column:
    """The write, or null if the shell would expand its text."""
    return F.when(sure & (quoted | ~text.rlike(EXPANDS)), F.struct(target.alias("target"), text.alias("text")))


def _here_document(command: Column, name: str) -> Column:
    """``cat`` or ``tee`` fed by ``<<MARK``: the lines up to the one that is the mark alone."""
    at = F.regexp_instr(command, F.lit(r"<<-?\s*(['\"]?)\w+\1"))
    rest = F.substring(command, at, F.length(command))
    head = F.concat(F.substring(command, F.lit(1), at - 1), F.regexp_extract(rest, r"\A[^\n]*", 0))
    forms = []
    for dash, tabs in (("-", r"\t*"), ("", "")):
        form = rf"(?s)\A<<{dash}(?!-)\s*(['\"]?)(\w+)\1[^\n]*\n((?:.*?\n)??){tabs}\2\s*?(?:\n|\z)"
        body = F.regexp_extract(rest, form, 3)
        body = F.regexp_replace(body, r"(?m)^\t+", "") if dash else body
        sure = (at > 0) & rest.rlike(form) & head.rlike(r"\b(?:cat|tee)\b") & head.rlike(rf"{name}\b")
        forms.append(_written(F.regexp_extract(head, rf"({name})\b", 1), body, F.regexp_extract(rest, form, 1) != "", sure))
    return F.coalesce(*forms)


def _said(command: Column, name: str) -> Column:
    """One quoted string of ``echo`` or ``printf``, redirected or piped into ``tee``."""
    form = rf"\A\s*(?:echo|printf)\s+(?:-\w+\s+)?(['\"])(.*?)\1\s*(?:>>?\s*|\|\s*tee\s+(?:-\w+\s+)?)({name})\s*\z"
    part = lambda i: F.regexp_extract(command, form, i)
    return _written(part(3), part(2), part(1) == "'", command.rlike(form))


def shell_write(command: Column, extensions=EXTENSIONS) -> Column:
    """struct<target, text>; null if there is no write or its text depends on expansion."""
    name = rf"[^\s<>|;&]+\.(?:{'|'.join(extensions)})"
    return F.when(~command.rlike(UNSURE), F.coalesce(_here_document(command, name), _said(command, name)))


def shell_writes(commands: DataFrame, *, command: str = "command") -> DataFrame:
    """``commands`` with target and text, both null where nothing can be told."""
    return commands.withColumn("_w", shell_write(F.col(command))).withColumns({"target": F.col("_w.target"), "text": F.col("_w.text")}).drop("_w")
