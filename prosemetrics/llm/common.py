"""What several operators share: the word pattern, the shared folder, lineage cuts."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on a local master alone, else one of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.match(r"local(\[(\d+|\*)(,\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="prosemetrics-")
        spark.sparkContext.setCheckpointDir(there)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prosemetrics/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table made by :func:`written` which nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, even when ``use`` reads it in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def random_key(column: str) -> Column:
    """60 random bits that depend on the value of ``column`` alone, the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def key_ranges(rows: int) -> int:
    """Into how many ranges to cut the key space so that ranges and rows a range both stay near sqrt(rows)."""
    return max(1, math.isqrt(max(0, rows - 1)) + 1)


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0
