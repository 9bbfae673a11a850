"""The event log: JSON lines, in batch and as a stream, and its sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, ts double, action string, file string, kinds array<string>, ruleset string, word_count int, note string"
LEGACY_RULESET = "controlled"


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumn("ruleset", F.coalesce("ruleset", F.lit(LEGACY_RULESET)))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events; lines that are blank or no JSON are left out, a missing ruleset is the legacy one."""
    return _filled(spark.read.schema(SCHEMA).json(path, mode="DROPMALFORMED"))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return _filled(spark.readStream.schema(SCHEMA).json(path))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line. The report is written beside the old one and then takes its name.

    A reader never sees half a report. Where the folder's file system renames but does not
    replace folders, there is none for the moment between two renames.
    """
    swap_in(df.select(F.to_json(F.struct("*")).alias("value")), path, "text")


def swap_in(df: DataFrame, path: str, form: str = "parquet") -> None:
    """``df`` written beside ``path``, which it then replaces; the old table stays until the new one is whole."""
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    df.write.format(form).save(new)
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = system.exists(of(path))
    if had and not system.rename(of(path), of(old)):
        raise OSError(f"can't rename {path}")
    if not system.rename(of(new), of(path)):
        if had:
            system.rename(of(old), of(path))
        raise OSError(f"can't rename {new}")
    if had:
        system.delete(of(old), True)


def write_corpus(docs: DataFrame, path: str, by: str = "source") -> None:
    docs.write.mode("overwrite").partitionBy(by).parquet(path)
