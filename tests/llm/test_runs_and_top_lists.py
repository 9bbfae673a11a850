import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemetrics.llm import exact_top, negatives, periodic, vector_blocks
from prosemetrics.llm.queries import queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=12):
    """Every period by itself; a run counts if no shorter period holds over it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            whole = words[i : j + q]
            if j > i and len(whole) >= max(least, 2 * q):
                if not any(all(a == b for a, b in zip(whole, whole[d:])) for d in range(1, q)):
                    out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_every_period():
    rng = random.Random(0)
    for _ in range(800):
        n, k = rng.randrange(90), rng.choice([1, 2, 3, 6])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 20)
            for i in range(a + p, n):
                w[i] = w[i - p]
        for least in (4, 5, 12):
            assert periodic.runs_of(w, least) == brute_runs(w, least)


def test_merging_of_large_sets_of_ends(monkeypatch):
    rng = random.Random(3)
    w = [b"%d" % rng.randrange(2) for _ in range(600)]
    want = periodic.runs_of(w)
    monkeypatch.setattr(periodic, "FEW", 0)
    assert periodic.runs_of(w) == want == brute_runs(w)


@pytest.mark.parametrize("kind", ["same", "period", "halves", "fibonacci", "distinct"])
def test_long_texts_take_seconds(kind):
    n = 100_000
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    word = {"same": lambda i: 0, "period": lambda i: i % 7, "halves": lambda i: i % (n // 2), "fibonacci": lambda i: b[i], "distinct": lambda i: i}[kind]
    start = time.time()
    found = periodic.runs_of([str(word(i)).encode() for i in range(n)])
    assert time.time() - start < 30
    if kind != "fibonacci":
        assert [e - s for s, e, _ in found] == ([] if kind == "distinct" else [n])


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_over_the_table_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d["doc_id"], (d["text"] or "").encode().split())
        r = got[d["doc_id"]]
        if len(words) > 700:  # brute force is quadratic
            continue
        runs = brute_runs(words)
        some += bool(runs)
        kept = b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs))
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()
        assert r["n_runs"] == len(runs)
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())
        best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
        want = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
    assert some > 10


def test_runs_of_odd_rows(spark):
    again = "to be or not " * 5
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, again, "x"), (4, again, "x"), (None, "é é " * 12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.periodic_runs(docs).collect()
    assert [r["runs"] for r in got[:3]] == [[], [], []] and all(r["kept"] == b"" for r in got[:3])
    assert got[3] == got[4] and got[3]["kept"] == b"to be or not" and got[3]["runs"][0].asDict() == {"start": 0, "length": 20, "period": 4}
    assert bytes(got[5]["kept"]).decode() == "é é"
    assert periodic.run_digests(docs.limit(0)).collect() == []
    nothing = periodic.run_digests(docs.filter("doc_id = 1")).first()
    assert (nothing["n_runs"], nothing["start"], nothing["runs_sha256"]) == (0, None, hashlib.sha256(b"").hexdigest())


def brute_top(rows, k, every):
    out = []
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(set(out))


def brute_negatives(rows, positives, k, every, low=50, high=95):
    out = []
    for q, label, x in rows:
        if q % every:
            continue
        score = lambda y, x=x: int(np.dot(x, y))
        near = sorted((-score(y), i) for i, m, y in rows if m == label and i != q)[:positives]
        for s, p in near:
            s = -s
            far = sorted((-score(y), i) for i, m, y in rows if m != label and low * s <= 100 * score(y) <= high * s)[:k]
            out += [(q, p, n + 1, i, s, -t) for n, (t, i) in enumerate(far)]
    return sorted(out)


def whole(vectors):
    return [np.floor(256 * np.array(v)).astype(np.int64) for v in vectors]


@pytest.fixture(params=["one block", "many"])
def pieces(request, monkeypatch):
    if request.param == "many":
        for name, value in {"BLOCK": 40, "CHUNK": 3, "AT_ONCE": 2, "HELD": 2, "BROADCAST": 0}.items():
            monkeypatch.setattr(vector_blocks, name, value)
        for module in (negatives, exact_top):
            monkeypatch.setattr(module, "AT_ONCE", 2)


TOP, NEGATIVES = ("query_id", "rank", "vec_id", "score"), ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("spread", [0.1, 3.0, 2000.0])
def test_searches_against_brute_force(spark, pieces, spread):
    rng = np.random.default_rng(int(spread))
    x = rng.normal(size=(300, 9)) * spread
    x[100:200] = x[100]  # a third of the rows are one vector
    labels = rng.integers(0, 3, 300).tolist()
    table = spark.createDataFrame([(i, labels[i], v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").repartition(3)
    vectors = whole(x)
    got = exact_top.top_k(table, k=5, every=30).select(*TOP).collect()
    assert sorted(map(tuple, got)) == brute_top(list(enumerate(vectors)), 5, 30)
    got = negatives.hard_negatives(table, every=30).select(*NEGATIVES).collect()
    want = brute_negatives([(i, labels[i], v) for i, v in enumerate(vectors)], 5, 3, 30)
    assert sorted(map(tuple, got)) == want and want


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-4_000_000, 4_000_000, (60, 2)).astype(float) + 0.25
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    exactly = [[int(np.floor(256 * c)) for c in v] for v in x]
    of = {i: v for i, v in enumerate(exactly)}
    for r in exact_top.top_k(table, k=4, every=20).collect():
        assert r["score"] == sum(a * b for a, b in zip(of[r["query_id"]], of[r["vec_id"]]))
    hard = negatives.hard_negatives(table, every=20).collect()
    assert hard and all(r["negative_score"] == sum(a * b for a, b in zip(of[r["anchor_id"]], of[r["negative_id"]])) for r in hard)


def test_rows_that_take_no_part(spark):
    bad = [(0, 1, None), (50, 1, [None, 1.0]), (100, 1, [float("nan"), 1.0]), (150, 1, [float("inf"), 1.0]), (200, 1, []), (250, 1, [1.0]), (None, 1, [1.0, 1.0])]
    good = [(300, 1, [1.0, 0.0]), (300, 1, [1.0, 0.0]), (301, None, [1.0, 0.5]), (302, 1, [0.5, 0.5]), (303, 2, [0.8, 0.0]), (304, 2, [0.3, 9.0]), (305, 2, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, "kept") for r in bad + good], "vec_id long, label int, embedding array<double>, question string")
    got = sorted(map(tuple, exact_top.top_k(table, every=50).select(*TOP).collect()))
    assert got == [(300, 1, 301, 65536), (300, 2, 303, 52224), (300, 3, 302, 32768), (300, 4, 304, 19456), (300, 5, 305, 0)]
    got = sorted(map(tuple, negatives.hard_negatives(table).select(*NEGATIVES).collect()))
    assert got == [(300, 302, 1, 304, 32768, 19456)]
    assert exact_top.top_k(table.limit(0)).collect() == [] and negatives.hard_negatives(table.limit(0)).collect() == []
    assert exact_top.top_k(table.filter("vec_id < 300")).collect() == []


def test_no_negatives_and_negative_scores(spark):
    rows = [(i, 0, [1.0 if i % 2 else -1.0, 0.1 * i]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(table).collect() == []
    mixed = table.withColumn("label", F.col("vec_id").cast("int") % 2)
    want = brute_negatives([(i, i % 2, whole([v])[0]) for i, _, v in rows], 5, 3, 50)
    assert sorted(map(tuple, negatives.hard_negatives(mixed).select(*NEGATIVES).collect())) == want
