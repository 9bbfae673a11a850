"""Queries over whole tables: all languages, all checks, all turns; held against brute force on small fixtures."""

import random
import re
import subprocess
import sys
from itertools import islice, product
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from prosemetrics import catalogue
from prosemetrics.checks import controlled
from prosemetrics.operators import corpus, experiment, lint, vocabulary
from prosemetrics.plans.derived import derived

TEXTS = [
    (0, "He was running. They were going home.", "en", "a"),
    (1, "Le garçon was running vite. Running encore.", "fr", "a"),
    (2, "Das was swimming heute.", None, "b"),
    (3, None, "de", "b"),
    (5, "**a** un **b** deux **c** trois **d** quatre **e** cinq " * 3, "fr", "a"),
    (6, "Ein Satz mit ünf Wörtern. " * 4000 + "robust Needless to say, a robust part.", None, None),
    (4, "It has been done. He has been jumping.", "de", None),
]
BY = {t[0]: t[1] for t in TEXTS}
TURNS = [(i, t, ("system", "user", "assistant")[(t + i % 2) % 3], " ".join(["w"] * ((i * 7 + t * 5) % 11)) if (i + t) % 6 else None) for i in range(12) for t in range(7)]
CHECKS = {c.id for c in controlled.RULESET.checks} - {"vocabulary"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i in (1, 2))) for i, *_ in TEXTS], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def ing(text):
    return len({w.lower() for w in re.findall(r"\w+ing\b", text or "")})


def test_activity_over_all_documents_and_checks(spark, sf):
    got = {(r["lang"], r["source"], r["check_id"]): r for r in catalogue.queries()["activity_whole"](spark, sf).collect()}
    assert {k[:2] for k in got} == {t[2:] for t in TEXTS} and {k[2] for k in got} == CHECKS
    for _, _, *corpus in TEXTS:
        r, same = got[(*corpus, "ing_form")], [t[1] for t in TEXTS if t[2:] == (*corpus,)]
        assert (r["hits"], r["words"], r["documents"]) == (sum(map(ing, same)), sum(len((t or "").split()) for t in same), len(same))


def test_shares_and_kinds_are_of_all_checks(spark, sf):
    share = {r["check_id"]: r for r in catalogue.queries()["flag_share_whole"](spark, sf).collect()}
    assert set(share) == CHECKS and sum(r["share"] for r in share.values()) == pytest.approx(1)
    assert share["ing_form"]["hits"] == sum(ing(t[1]) for t in TEXTS)
    kinds = {r["kind"]: r["flags"] for r in catalogue.queries()["kind_counts_whole"](spark, sf).collect()}
    assert kinds["ing_form"] == share["ing_form"]["hits"] and set(kinds) - set(catalogue.FLAGSHIP)


def test_comparison_is_of_all_labelled_documents(spark, sf):
    got = {(r["check_id"], r["control"]): r for r in catalogue.queries()["compare_quality_whole"](spark, sf).collect()}
    assert {k[0] for k in got} == CHECKS and {k[1] for k in got} == {"c1", "c2"}
    rate = lambda ids: round(1000 * sum(ing(BY[i]) for i in ids) / sum(len((BY[i] or "").split()) for i in ids), 2)
    for control, i in (("c1", 1), ("c2", 2)):
        assert (got["ing_form", control]["per_1k"], got["ing_form", control]["control_per_1k"]) == (rate([t[0] for t in TEXTS if t[0] not in (1, 2)]), rate((i,)))
    assert {r["check_id"] for r in catalogue.queries()["consensus_quality_whole"](spark, sf).collect()} == CHECKS
    assert catalogue.queries()["calibration_whole"](spark, sf).columns == ["check_id", "control_per_1k", "measured_per_1k", "target_per_1k", "skipped"]


def test_arms_are_scored_over_all_turns(spark, sf):
    score = {}
    for i, _, role, text in TURNS:
        score[i, role] = score.get((i, role), 0) + len((text or "").split())
    pairs = [(score[i, "user"], score[i, "assistant"]) for i in range(12)]
    sign = catalogue.queries()["sign_test_whole"](spark, sf).collect()[0]
    assert (sign["wins"], sign["losses"], sign["ties"]) == (sum(a < b for a, b in pairs), sum(a > b for a, b in pairs), sum(a == b for a, b in pairs))
    board = {r["arm"]: (r["prompts"], r["total"]) for r in catalogue.queries()["leaderboard_whole"](spark, sf).collect()}
    assert board == {role: (12, float(sum(v for (_, x), v in score.items() if x == role))) for role in ("system", "user", "assistant")}
    diffs, rng = [float(b - a) for a, b in pairs], random.Random(0)
    means = sorted(sum(diffs[rng.randrange(12)] for _ in range(12)) / 12 for _ in range(10_000))
    r = catalogue.queries()["bootstrap_ci"](spark, sf).collect()[0]
    assert (r["mean"], r["low"], r["high"], r["favour"]) == (sum(diffs) / 12, means[250], means[9749], sum(m > 0 for m in means) / 10_000)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 50, 700])
def test_bulk_draws_are_those_of_the_generator(n):
    diffs, rng = [x / 7 for x in range(n)], random.Random(5)
    assert list(experiment._resampled(diffs, 40, 5)) == [sum(diffs[rng.randrange(n)] for _ in range(n)) / n for _ in range(40)]


def test_shape_verdicts_and_checks_reach_all_documents(spark, sf):
    shape = {r["doc_id"]: r for r in catalogue.queries()["text_shape_documents"](spark, sf).collect()}
    assert set(shape) == set(BY) and (shape[3]["words"], shape[3]["sentences"]) == (0, 0)
    assert shape[6]["sentences"] == 4000 and all(r["words"] == len(re.findall(r"[a-z][a-z'-]*", (BY[i] or "").lower())) for i, r in shape.items())
    status = {r["doc_id"]: r["status"] for r in catalogue.queries()["lint_status_documents"](spark, sf).collect()}
    assert set(status) == set(BY) and status[3] == "clean" and status[6] == "semantic_flags"
    hits = {}
    for r in catalogue.queries()["check_ing_form_documents"](spark, sf).collect():
        hits[r["doc_id"]] = hits.get(r["doc_id"], 0) + r["hits"]
    assert hits == {i: len(re.findall(r"\w+ing\b", t)) for i, t in BY.items() if t and re.search(r"\w+ing\b", t)}
    assert {r["doc_id"] for r in catalogue.queries()["check_bold_density_documents"](spark, sf).collect()} == {5}
    assert {f"check_{c}_documents" for c in catalogue.FLAGSHIP} <= set(catalogue.queries())


@pytest.mark.parametrize("kind", ["sentences", "lists", "code", "parts"])
def test_derived_texts_are_dealt_to_all_cores(spark, tmp_path, kind):
    """The parts are short rows of one row group, which one task reads."""
    one = spark.range(1000).selectExpr("id AS p_partkey", "'bolt ' || id AS p_name").coalesce(1)
    one.write.parquet(f"{tmp_path}/part.parquet")
    texts = derived(spark, str(tmp_path), kind)
    held = texts.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in held) < 500 and sum(r["count"] for r in held) == 1000


_SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
from prosemetrics import catalogue
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
print(sorted(map(tuple, catalogue.queries()[sys.argv[1]](spark, sys.argv[2]).collect())))
"""


def test_kinds_of_one_long_sentence_fit_a_small_heap(spark, tmp_path):
    """Each of 20 000 different words is a flag; were the sentence (120 kB) copied to each, they would take 2.4 GB."""
    words = ["".join(w) for w in islice(product("bcfghjklmn", repeat=5), 20_000)]
    spark.createDataFrame([(0, " ".join(words) + ".", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = subprocess.run([sys.executable, "-c", _SMALL_HEAP, "kind_counts_whole", str(tmp_path)], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.strip() == "[('length', 1), ('vocabulary', 20000)]"


@pytest.mark.parametrize("name, compiled", [("prose", 5000), ("code", 5000), ("controlled", 5000), ("controlled", 0)])
def test_kinds_are_counted_as_their_flags(spark, monkeypatch, name, compiled):
    """Flags merged, exploded and counted against counts made in the row; a text twice, in odd case, empty and null; a dictionary in the plan and one joined."""
    monkeypatch.setattr(vocabulary, "COMPILED", compiled)
    docs = derived(spark, "/root/testdata/sf0.001", "code" if name == "code" else "sentences").limit(60).select("doc_id", "text")
    docs = docs.unionByName(docs.limit(9).selectExpr("-1 - doc_id AS doc_id", "upper(text) || ' ' || text AS text")).unionByName(spark.createDataFrame([(-100, ""), (-101, None), (-102, "'Tis TIS tis 'tis he's He's was failed.")], "doc_id long, text string"))
    context = {"dictionary": catalogue._dictionary(spark)}
    want = corpus.kind_counts(lint.merged_flags(docs, name, context)).collect()
    assert want and corpus.kind_counts_of(docs, name, context).collect() == want
    assert "vocabulary" not in {r["kind"] for r in lint.flag_arrays(docs, name, context, counted=True).selectExpr("inline(found)").select("kind").collect()}
