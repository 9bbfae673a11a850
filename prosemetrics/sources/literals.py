"""String literals and docstrings of Python source. The grammar is Python's own, so this is a Python table function."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, STAND_IN, LEAST_DOCSTRING = 4, "X", 30


class _Strings(ast.NodeVisitor):
    """Collects (line, rank, text): a formatted string before the plain ones of its line, outer ones before inner ones."""

    def __init__(self):
        self.found, self.level = [], 0

    def generic_visit(self, node):
        self.level += 1
        super().generic_visit(node)
        self.level -= 1

    def visit_Constant(self, node):
        if isinstance(node.value, str):
            self.found.append((node.lineno, (1, self.level, len(self.found)), node.value))

    def visit_JoinedStr(self, node):
        holes = [v for v in node.values if not (isinstance(v, ast.Constant) and isinstance(v.value, str))]
        self.found.append((node.lineno, (0, self.level, len(self.found)), "".join(STAND_IN if v in holes else v.value for v in node.values)))
        self.level += 1
        for hole in holes:
            self.visit(hole)
        self.level -= 1


def literals(source: str | None) -> list[tuple[int, str]]:
    """(line, text) of every literal of LEAST_WORDS words or more; a formatted string counts once, its holes as STAND_IN."""
    strings = _Strings()
    try:
        strings.visit(ast.parse(source or ""))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(line, text) for line, _, text in sorted(strings.found) if len(text.split()) >= LEAST_WORDS]


@F.udtf(returnType="line int, ord int, segment string")
class Literals:
    def eval(self, source: str):
        for i, (line, text) in enumerate(literals(source)):
            yield line, i, text


SEGMENTS = "array<struct<line:int,segment:string>>"


def _all_literals(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: [{"line": line, "segment": text} for line, text in literals(s)])


_all_literals.__annotations__ = {"sources": pd.Series, "return": pd.Series}


def prose_literals(text: str | Column) -> Column:
    """The literals of a source text, in its row: array of line and segment."""
    return F.pandas_udf(_all_literals, SEGMENTS)(text)


def prose_segments(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """key, line, ord, segment."""
    spark = files.sparkSession
    spark.udtf.register("prosemetrics_literals", Literals)
    return spark.sql(f"SELECT f.`{key}`, s.line, s.ord, s.segment FROM {{files}} f, LATERAL prosemetrics_literals(f.`{text}`) s", files=files)


def docstrings(files: DataFrame, *, key: str = "path", text: str = "text", least: int = LEAST_DOCSTRING) -> DataFrame:
    """key, docstring: module docstrings of ``least`` words or more."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                try:
                    d = ast.get_docstring(ast.parse(t or ""))
                except (SyntaxError, ValueError):
                    d = None
                if d and len(d.split()) >= least:
                    rows.append((k, d))
            yield pd.DataFrame(rows, columns=[key, "docstring"])

    return files.select(key, text).mapInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, docstring string")
