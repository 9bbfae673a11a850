"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, exact_top, langid, licenses, line_crf, lpf, mixing, near_dup, negatives, packing, periodic, quality_rules, secrets
from .common import written


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest_neighbours(spark, sf_dir):
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_license_scan(spark, sf_dir):
    return licenses.license_scan(_documents(spark, sf_dir))


def op3_repeated_passages(spark, sf_dir):
    return lpf.without_repeats(_documents(spark, sf_dir), kept_bytes=False)


def op4_language_id(spark, sf_dir):
    return langid.language_id(_documents(spark, sf_dir))


def op5_packing(spark, sf_dir):
    return packing.packed(_documents(spark, sf_dir))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.rule_verdicts(_documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    sizes = written(mixing.sized(_documents(spark, sf_dir)))
    return mixing.mix(sizes, sizes.count()).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_quality_classifier(spark, sf_dir):
    return line_crf.document_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_secret_scan(spark, sf_dir):
    return secrets.scan(_documents(spark, sf_dir))


def op10_near_duplicates(spark, sf_dir):
    return near_dup.linked(_documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(_documents(spark, sf_dir))


def op12_hard_negatives(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table.withColumn("label", moved))


def op13_exact_top_k(spark, sf_dir):
    return exact_top.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op")}
