import pytest

from prosemetrics.operators import lint
from prosemetrics.plans import registry, stored


def _row(ruleset, check_id, unit="SENTENCE", finder="words", pattern=None, terms=None, least=None, bucket=None, threshold=None, action=None, ord_=None):
    return (ruleset, check_id, ord_, unit, finder, pattern, terms, least, "say it plainly", bucket, threshold, action)


GOOD = [
    _row("house", "hype", terms=["synergy", "deep dive"], action="block", threshold=2, ord_=2),
    _row("house", "shout", finder="pattern", pattern=r"\w+!!+", bucket="mechanical", ord_=1),
    _row("house", "so", finder="opening", terms=["so"]),
    _row("house", "nots", finder="repeated", pattern=r"\bnot\b", least=2),
    _row("house", "wordy", finder="longer", least=8),
    _row("house", "unsigned", "DOCUMENT", "missing", pattern=r"\bsigned\b"),
    _row("lists", "dashes", "LINE", "pattern", pattern="--"),
]
BAD = [
    _row("prose", "x", terms=["a"]), _row("House", "x", terms=["a"]), _row(None, "x", terms=["a"]), _row("house", "1x", terms=["a"]),
    _row("house", "unit", "WORD", terms=["a"]), _row("house", "finder", finder="magic"), _row("house", "none", terms=[]), _row("house", "blank", terms=["a", " "]),
    _row("house", "broken", finder="pattern", pattern="(a"), _row("house", "empty", finder="pattern", pattern="a*"), _row("house", "nothing", finder="pattern"),
    _row("house", "least", finder="longer"), _row("house", "few", finder="longer", least=0), _row("house", "bucket", terms=["a"], bucket="odd"),
    _row("house", "action", terms=["a"], action="shout"), _row("house", "threshold", terms=["a"], threshold=0), _row("house", "hype", terms=["again"], ord_=9),
]


def _frame(spark, rows):
    return spark.createDataFrame(rows, stored.SCHEMA)


@pytest.fixture
def clean():
    before = set(registry.rulesets())
    yield
    for name in set(registry.rulesets()) - before:
        registry.unregister(name)


def test_rows_are_checked_one_by_one(spark):
    made, refused = stored.compile_rows(_frame(spark, [*BAD, *GOOD]))
    assert {k: [c.id for c in r.checks] for k, r in made.items()} == {"house": ["shout", "hype", "nots", "so", "unsigned", "wordy"], "lists": ["dashes"]}
    assert sorted((r["ruleset"] or "", r["check_id"]) for r in refused) == sorted((b[0] or "", b[1]) for b in BAD)
    assert all(r["reason"] for r in refused)
    assert stored.compile_rows(_frame(spark, [])) == ({}, [])


def test_a_ruleset_that_no_python_declares(spark, tmp_path, clean):
    path = str(tmp_path / "rules")
    assert stored.load(spark, path).count() == 0
    refused = stored.save(_frame(spark, [*GOOD, *BAD]), path)
    assert refused.count() == len(BAD)
    assert stored.install(stored.load(spark, path)).count() == 0
    docs = spark.createDataFrame(
        [
            (1, "Synergy is a deep dive. It is signed."), (2, "So it is. No SYNERGY and no synergy. Signed."), (3, "Stop it!!! Signed by us."),
            (4, "It is not here and not there. It was signed."), (5, "one two three four five six seven eight nine signed."), (6, None), (7, ""), (8, "- a -- b\n- signed"),
        ], "doc_id int, text string",
    )
    flags = {(r["doc_id"], r["kind"], r["label"], r["bucket"], r["occurrences"]) for r in lint.flags(docs, "house").collect()}
    assert flags == {
        (1, "hype", "Synergy", "semantic", None), (1, "hype", "deep dive", "semantic", None), (2, "so", "So", "semantic", None),
        (2, "hype", "SYNERGY", "semantic", None), (2, "hype", "synergy", "semantic", None), (3, "shout", "it!!!", "mechanical", None),
        (4, "nots", None, "semantic", 2), (5, "wordy", None, "semantic", None), (6, "unsigned", None, "semantic", None), (7, "unsigned", None, "semantic", None),
    }
    verdict = {r["doc_id"]: (r["status"], r["would_block"]) for r in lint.lint(docs, "house").collect()}
    assert verdict[1] == ("semantic_flags", True) and verdict[2] == ("semantic_flags", True)  # the threshold is two
    assert verdict[3] == ("mechanical_violations", False) and verdict[8] == ("clean", False)
    assert [r["doc_id"] for r in lint.flags(docs, "lists").collect()] == [8]
    more = {(r["doc_id"], r["label"]) for r in lint.flags(docs, "house", {"extra": {"hype": ["signed"]}}).collect() if r["kind"] == "hype" and r["doc_id"] == 3}
    assert more == {(3, "Signed")}


def test_stored_rows_change_by_generations(spark, tmp_path, clean):
    path = str(tmp_path / "rules")
    stored.scaffold(spark, path, "own")
    for bad in ("own", "prose", "Own", ""):
        with pytest.raises(ValueError):
            stored.scaffold(spark, path, bad)
    stored.install(stored.load(spark, path))
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert lint.lint(docs, "own").first()["status"] == "clean"  # no checks yet
    stored.save(_frame(spark, [_row("own", "x", terms=["b"])]), path)
    assert stored.save(_frame(spark, [_row("own", "x", finder="pattern", pattern="(")]), path).count() == 1
    assert stored.load(spark, path).filter("check_id = 'x'").first()["terms"] == ["b"]  # the broken one changed nothing
    stored.save(_frame(spark, [_row("own", "x", terms=["c"]), _row("own", "y", terms=["d"])]), path)
    assert {r["check_id"]: r["terms"] for r in stored.load(spark, path).collect() if r["check_id"]} == {"x": ["c"], "y": ["d"]}
    stored.rename(spark, path, "own", "ours")
    with pytest.raises(ValueError):
        stored.rename(spark, path, "own", "theirs")
    stored.remove(spark, path, "ours", "x")
    stored.remove(spark, path, "ours", "no_such_check")
    stored.remove(spark, path, "ours", "y")
    assert [r["check_id"] for r in stored.load(spark, path).collect()] == [None]
    stored.remove(spark, path, "ours")
    assert stored.load(spark, path).count() == 0
