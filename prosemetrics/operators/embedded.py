"""Prose inside source code: literals joined to one document, flags traced back to their line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.literals import prose_segments
from .lint import gate, merged_flags


def embedded_flags(files: DataFrame, rules: str = "prose", *, key: str = "path", text: str = "text") -> DataFrame:
    """Semantic flags of the literals of each file, judged as one document, with embedded_line.

    The line is that of the first literal that holds the flag's text; null for flags of the whole.
    """
    parts = prose_segments(files, key=key, text=text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "ord", F.col("segment")))).alias("segments"))
    docs = parts.withColumn("joined", F.array_join(F.transform("segments", lambda s: s["segment"]), "\n\n"))
    merged = merged_flags(docs, rules, key=key, text="joined").filter("bucket = 'semantic'")
    here = F.filter("segments", lambda s: F.contains(s["segment"], F.col("text")) & (F.col("text") != ""))
    return merged.join(docs.select(key, "segments"), key).withColumn("embedded_line", F.get(here, F.lit(0))["line"]).drop("segments")


def embedded_blocking(files: DataFrame, config: DataFrame, rules: str = "prose", *, key: str = "path") -> DataFrame:
    return gate(embedded_flags(files, rules, key=key), config, key=key).filter("blocks")
