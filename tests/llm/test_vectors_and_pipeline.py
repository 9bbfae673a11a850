import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from prosemetrics.llm import ann, near_dup, packing, quality_rules, secrets
from prosemetrics.llm.common import written
from prosemetrics.llm.queries import queries


def brute(rows, k, every):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            s = x @ x[n]
            order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + rng.normal(size=32) * 0.7).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(ann.nearest(table)), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(s == pytest.approx(vectors[q] @ vectors[i], abs=1e-12) for q, v in got.items() for i, s in v)


def test_nearest_neighbours_in_several_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 16)
    monkeypatch.setattr(ann, "CELLS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(800)]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)), brute(rows, 5, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want)) > 0.9


def test_nearest_neighbours_with_ties_repeats_and_unusable_vectors(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(30)] + [(30, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [2.0, 0.0]), (101, [1.0]), (120, [])]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rid", "2 AS score"), k=3))
    assert got == {0: [(100, 2.0), (1, 1.0), (2, 1.0)], 20: [(100, 2.0), (0, 1.0), (1, 1.0)], 100: [(0, 2.0), (1, 2.0), (2, 2.0)]}


def test_nearest_neighbours_of_few_or_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind)).count() == 0
    assert found(ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 0.0])], kind))) == {0: [(3, 1.0)]}


def test_chi_square():
    assert ann.chi2_cdf(ann.chi2_quantile(0.9, 8), 8) == pytest.approx(0.9) and ann.chi2_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))


def test_pipeline_stages_against_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r["doc_id"] for r in quality_rules.rule_verdicts(docs).filter("kept").collect()]
    one = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(kept) and one.columns == docs.columns
    two = corpus_pipeline.STAGES[1][1](spark, one, sf)
    roots = {r["component_id"] for r in near_dup.linked(one, 5, 80).collect()}
    assert {r["doc_id"] for r in two.collect()} == roots and two.columns == docs.columns
    three = corpus_pipeline.STAGES[2][1](spark, two, sf)
    spans = {r["doc_id"]: r["n_secrets"] for r in secrets.scan(two).collect()}
    before = {r["doc_id"]: r["text"] for r in two.collect()}
    assert all((r["text"] != before[r["doc_id"]]) == (spans[r["doc_id"]] > 0) for r in three.collect())
    four = corpus_pipeline.STAGES[3][1](spark, three, sf)
    assert four.columns == docs.columns and set(r["doc_id"] for r in four.collect()) <= roots
    five = corpus_pipeline.STAGES[4][1](spark, four, sf)
    assert {r["doc_id"] for r in five.collect()} == {r["doc_id"] for r in four.collect()}
    assert five.groupBy("sequence_id").sum("length").filter(f"`sum(length)` > {packing.CAPACITY}").count() == 0


def test_pipeline_runs_as_a_whole(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_nearest_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} >= {(0, 1), (20, 1)} and all(r["rank"] <= 2 for r in got)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage done over in plain Python, on a small table with nulls, empties, copies, junk and secrets."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [[i, "\n".join(line(rng.randint(8, 20)) for _ in range(rng.randint(2, 6))), rng.choice(["en", None]), rng.choice(["s1", "s2", None])] for i in range(80)]
    for i, t in ((5, None), (6, ""), (7, "few words"), (8, "### $$$ " * 30), (9, "again and again " * 40)):
        rows[i][1] = t
    for i in (20, 21, 22):
        rows[i][1] = rows[3][1] + (" more" if i > 20 else "")
    rows[30][1] += "\npassword = hunter2hunter2"
    rows[31] = rows[32]
    text = {r[0]: r[1] for r in rows}
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def counts(t):
        words, lines = word.findall(t or ""), [x for x in (t or "").split("\n") if word.search(x)]
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        again = {j + d for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for d in range(5)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(again)

    groups = {}
    for r in rows:
        groups.setdefault((r[2], r[3]), []).append(counts(r[1]))

    def good(r):
        n, chars, symbols, lines, again, repeats = counts(r[1])
        if n < 10 or 100 * repeats > 20 * n:
            return False
        near = groups[r[2], r[3]]
        for count, units, at, of, both in ((symbols, n, 2, 0, False), (chars, n, 1, 0, True), (again, lines, 4, 3, False)):
            rates = sorted(c[at] / c[of] for c in near if c[of])
            q1, q3 = (rates[max(0, math.ceil(len(rates) * q) - 1)] for q in (0.25, 0.75))
            high, low = units * (q3 + 3 * (q3 - q1)), units * max(0, q1 - 3 * (q3 - q1)) if both else 0
            if count > high + 3 * math.sqrt(high) + 3 or count < low - 3 * math.sqrt(low) - 3:
                return False
        return True

    one = [r for r in rows if good(r)]
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [word.findall(r[1].lower())] for i in range(len(w) - 4)} for r in one}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    two = [r for r in one if root[r[0]] == r[0]]
    three = [[r[0], r[1].replace("= hunter2hunter2", f"= {secrets.MARK}"), *r[2:]] for r in two]
    got, docs = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs = docs if i == 4 else written(docs)
        got.append(docs.collect())
    assert sorted(r["doc_id"] for r in got[0]) == sorted(r[0] for r in one) and {8, 9}.isdisjoint(r["doc_id"] for r in got[0]) and len(one) > 60
    assert sorted(r["doc_id"] for r in got[1]) == sorted(r[0] for r in two) and len(two) < len(one)
    assert sorted((r["doc_id"], r["text"]) for r in got[2]) == sorted((r[0], r[1]) for r in three) and any(secrets.MARK in r[1] for r in three)
    size = {s: sum(len(word.findall(r[1])) for r in three if r[3] == s) for s in ("s1", "s2", None)}
    weight, left, free, want = {"s1": 5, "s2": 2, None: 1}, 1.5 * sum(size.values()), set(size), {}
    while free:
        over = {s for s in free if left / sum(weight[x] for x in free) * weight[s] > 2 * size[s]} or free
        unit = left / sum(weight[x] for x in free)
        want |= {s: min(unit * weight[s], 2 * size[s]) for s in over}
        free -= over
        left -= sum(want[s] for s in over)
    taken, largest = Counter(), max(len(word.findall(r[1])) for r in three)
    for r in got[3]:
        taken[r["source"]] += len(word.findall(r["text"]))
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in size) and max(Counter(r["doc_id"] for r in got[3]).values()) <= 4
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_path())
    pieces = Counter()
    for r in got[3]:
        ids = np.array([*full.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        pieces.update((r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[4]) == pieces
    by = {}
    for r in got[4]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 2048 for p in by.values())
    assert len(by) <= -(-sum(r["length"] for r in got[4]) // 2048) + 1


def test_pipeline_of_nothing_and_of_nulls_alone(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("nulls", [(None, None, None, None, None)] * 3 + [(1, None, None, None, 0)])):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, kind)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, "").columns == docs.columns
