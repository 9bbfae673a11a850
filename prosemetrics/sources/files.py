"""Files as documents, prompts, packs and recordings."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex

# Directories that a tree walk leaves out.
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode", ".cache", "dist", "build", ".tox", "site-packages")


def _walk(uri: str):
    """(path, whether a folder) of what lies in a folder, names that start with a dot or an underscore too; junk folders left out."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(at)] if uri.endswith(at) else ""
    for x in system.get_file_info(fs.FileSelector(at)):
        if x.type == fs.FileType.Directory and x.base_name not in SKIP_DIRS:
            yield head + x.path, True
        elif x.type == fs.FileType.File:
            yield head + x.path, False


def tree_paths(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path of every file below ``root`` (or ``root`` itself) but in junk folders, whose name matches the glob.

    The driver lists the root; tasks walk the folders in it.
    """
    from pyarrow import fs

    root = root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + os.path.abspath(root)
    root = re.sub(r"^file:/*", "file:///", root)
    system, at = fs.FileSystem.from_uri(root)
    top = [(root, False)] if system.get_file_info(at).type == fs.FileType.File else list(_walk(root))

    def below(batches):
        for b in batches:
            for start, is_dir in zip(b["path"], b["is_dir"]):
                found, folders = ([], [start]) if is_dir else ([start], [])
                while folders:
                    for path, inner in _walk(folders.pop()):
                        (folders if inner else found).append(path)
                yield pd.DataFrame({"path": sorted(found)})

    seeds = spark.createDataFrame(top, "path string, is_dir boolean")
    paths = seeds.repartition(max(1, min(len(top), 1000))).mapInPandas(below, "path string")
    return paths.filter(F.substring_index("path", "/", -1).rlike(glob_regex(glob))) if glob else paths


def read_paths(paths: DataFrame) -> DataFrame:
    """path, content (null if it can't be read) of the files in ``path``."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b["path"]:
                try:
                    system, at = fs.FileSystem.from_uri(path)
                    with system.open_input_stream(at) as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})

    return paths.select("path").mapInPandas(run, "path string, content binary")


def scan_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, text, state (ok, blank, unreadable) of every file below ``root`` but in junk directories.

    Paths are listed and filtered first; only the survivors are read. Spark's own file
    sources pass over names that start with a dot or an underscore, so they aren't used.
    """
    files = read_paths(tree_paths(spark, root, glob).repartition(F.col("path")))
    ok = F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    text = F.when(ok, F.col("content").cast("string"))
    state = F.when(~ok, "unreadable").when(F.trim(F.regexp_replace(text, r"(?U)\s", "")) == "", "blank").otherwise("ok")
    return files.select("path", text.alias("text"), state.alias("state"))


def scan_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("state") == "ok").alias("scanned"), F.count_if(F.col("state") == "unreadable").alias("skipped_unreadable"), F.count_if(F.col("state") == "blank").alias("blank"))


def pack_terms(lines: DataFrame) -> DataFrame:
    """term, note from lines (value): ``word`` or ``word: note``, ``#`` starts a comment."""
    line = F.trim(F.regexp_replace("value", r"#.*$", ""))
    parts = F.split(line, ":", 2)
    return lines.filter(line != "").select(F.lower(F.trim(parts[0])).alias("term"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("note"))


def load_pack(packs: DataFrame, known: list[str], pack: str) -> DataFrame:
    """term, note of one pack; an unknown id is an error, a known one without terms is empty."""
    if pack not in known:
        raise ValueError(f"no pack {pack!r}")
    return packs.filter(F.col("pack_id") == pack).select(F.lower("term").alias("term"), "note")


def prompt_set(lines: DataFrame) -> DataFrame:
    """id, text, turns from markdown lines (n, value): ``## id`` opens a prompt, ``###`` a turn. A repeated id is an error."""
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_id = F.col("value").rlike(r"^##\s+\S")
    is_turn = F.col("value").rlike(r"^###")
    rows = lines.withColumn("id", F.last(F.when(is_id, F.trim(F.regexp_replace("value", r"^##\s+", ""))), ignorenulls=True).over(upto)).withColumn("turn", F.sum(is_turn.cast("int")).over(upto)).withColumn("nth", F.sum(is_id.cast("int")).over(upto))
    twice = rows.filter(is_id).groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"prompt {twice[0]['id']!r} is there twice")
    body = rows.filter(F.col("id").isNotNull() & ~is_id & ~is_turn).groupBy("id", "nth", "turn").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n")).alias("text"))
    out = body.filter("text <> ''").groupBy("id", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("turns"))
    return out.orderBy("nth").select("id", F.get("turns", F.lit(0)).alias("text"), "turns")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """digest, occurrence, messages, output from JSON files named ``digest.occurrence.json``."""
    kind = "messages array<struct<role:string,content:string>>, output string"
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    raw = spark.read.schema(kind).json(path, multiLine=True).withColumn("name", name)
    return raw.select(F.regexp_extract("name", r"^([0-9a-f]+)\.", 1).alias("digest"), F.regexp_extract("name", r"\.(\d+)\.json$", 1).cast("int").alias("occurrence"), "messages", "output")


def result_rows(results: DataFrame) -> DataFrame:
    """The rows of saved experiments (run, rows) one a row."""
    return results.select("run", F.explode("rows").alias("r")).select("run", "r.*")


def package_docs(spark: SparkSession, root: str, least: int = 100) -> DataFrame:
    """path, text of .rst and .md files of ``least`` words or more."""
    files = scan_tree(spark, root).filter("state = 'ok'").filter(F.col("path").rlike(r"\.(rst|md)$"))
    return files.filter(F.regexp_count("text", F.lit(r"\S+")) >= least).select("path", "text")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, before, after: the files of a change; a new file has no before."""
    return after.select("path", F.col("text").alias("after")).join(before.select("path", F.col("text").alias("before")), "path", "left").select("path", "before", "after")
