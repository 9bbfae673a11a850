"""Vocabulary in the row, write decisions, packs and embedded prose in routed lint."""

import pytest
from pyspark.sql import functions as F

from prosemetrics import catalogue_flow
from prosemetrics.operators import decision, lint, routing, vocabulary
from prosemetrics.operators.history import EVENT
from prosemetrics.plans.derived import derived
from prosemetrics.plans.registry import ruleset

from test_entry import SF, duck, plain  # noqa: F401

WRITE_RULES = [{"glob": "*.md", "ruleset": "prose"}, {"glob": "*.py", "ruleset": "code", "embedded_prose": "prose"}]
BLOCK = [("marketing_adjective", None, "action", "block"), ("marketing_adjective", None, "threshold", "1")]


@pytest.mark.parametrize("name", sorted(catalogue_flow.queries()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):  # noqa: F811
    df = catalogue_flow.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = duck.execute(catalogue_flow.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = [tuple(r[columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted(columns) == names and plain(df.select(*names).collect()) == plain(want)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _vocabulary_only():
    return [c.id for c in ruleset("controlled").checks if c.id != "vocabulary"]


@pytest.mark.parametrize("largest", [0, vocabulary.COMPILED])
def test_vocabulary_in_the_row_gives_the_flags_of_the_join(spark, monkeypatch, largest):
    monkeypatch.setattr(vocabulary, "COMPILED", largest)
    docs, words = derived(spark, SF, "sentences"), catalogue_flow.dictionary(spark)
    context = {
        "dictionary": words, "project": spark.createDataFrame([("Late",), ("widgets",)], "word string"),
        "suppressed": spark.createDataFrame([("it", "approved"), ("sell", "unapproved")], "word string, status string"),
    }
    found = lint.flags(docs, "controlled", context, disabled=_vocabulary_only())
    assert ("Exchange" in physical(found)) == (largest == 0)
    columns = ("doc_id", "item_ord", "label", "type", "replacement", "rule")
    want = vocabulary.vocabulary_flags(docs, words, context["project"], context["suppressed"]).select(*columns)
    assert plain(found.select(*columns).collect()) == plain(want.collect())


def test_vocabulary_of_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "''' 12 -"), (4, "Stop it, zorp!"), (4, "Stop it, zorp!"), (None, "blarg")], "doc_id long, text string")
    for largest in (0, vocabulary.COMPILED):
        monkeypatch.setattr(vocabulary, "COMPILED", largest)
        rows = lint.lint(docs, "controlled", {"dictionary": catalogue_flow.dictionary(spark)}, disabled=["length"]).collect()
        assert sorted((r["doc_id"] or 0, r["semantic"]) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert lint.lint(docs, "controlled").filter("semantic > 0").count() == 0  # no dictionary, no such flags


def test_checks_are_computed_once(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    once = physical(lint.flag_arrays(docs, "prose")).count("regexp_extract_all")
    for form in (lint.flags, lint.merged_flags, lint.gate_documents, lint.lint):
        assert physical(form(docs, "prose")).count("regexp_extract_all") == once


def writes(spark, rows):
    return spark.createDataFrame(rows, decision.WRITE)


def test_decisions(spark):
    robust = "This is a robust thing."
    rows = [
        ("a.md", "write", None, robust, None, None, None),  # new, and flagged
        ("b.md", "write", robust, robust + " It is late.", None, None, None),  # no worse than it was
        ("c.md", "edit", robust + " Fine.", None, "Fine.", "A seamless one.", False),  # worse
        ("d.md", "edit", "One two. One two.", None, "two", "notably late", True),  # fixed
        ("e.md", "shell", None, "This is notably late.", None, None, None),  # a fix, but by a shell
        ("f.md", "write", robust, "Fine.", None, None, None),
        ("g.md", "edit", "Fine.", None, "not there", robust, False),  # judged as written
        ("h.md", "write", None, None, None, None, None),
        ("i.bin", "write", None, robust, None, None, None),
        ("j.py", "write", None, 'x = "this is a robust literal"\n', None, None, None),
        ("k.py", "edit", 'x = "this is a robust literal"\n', None, "x", "y", False),
    ]
    overrides = spark.createDataFrame(BLOCK, "check_id string, glob string, field string, value string")
    got = {r["path"]: r for r in decision.decide_writes(writes(spark, rows), WRITE_RULES, overrides).collect()}
    assert {p: r["decision"] for p, r in got.items()} == {
        "a.md": "deny", "b.md": "clean", "c.md": "deny", "d.md": "auto_fix", "e.md": "deny", "f.md": "clean", "g.md": "deny", "h.md": "blank", "i.bin": "out_of_scope",
        "j.py": "deny", "k.py": "clean",
    }
    assert got["a.md"]["shown"] == ["[marketing_adjective] robust"] and got["a.md"]["before_weight"] is None
    assert (got["b.md"]["before_weight"], got["b.md"]["after_weight"]) == (1, 1) and (got["c.md"]["before_weight"], got["c.md"]["after_weight"]) == (1, 2)
    assert got["d.md"]["fixed"] == "Late" and got["d.md"]["kinds"] == ["stock_adverb"] and got["e.md"]["fixed"] is None
    assert got["j.py"]["shown"] == ["[marketing_adjective] robust (embedded prose, line 1)"] and got["k.py"]["before_weight"] == 1
    many = [("m.md", "write", None, " ".join(f"{w} thing." for w in ("robust", "seamless", "powerful", "cutting-edge", "world-class", "innovative", "intuitive", "effortless", "stunning", "game-changing")), None, None, None)]
    one = decision.decide_writes(writes(spark, many), WRITE_RULES, overrides).first()
    assert len(one["shown"]) == min(8, one["flags"])
    assert decision.decide_writes(writes(spark, []), WRITE_RULES, overrides).collect() == []


def test_decisions_need_no_exchange_and_run_on_a_stream(spark, tmp_path):
    rows = [(f"{i}.md", "write", None, "A robust thing." if i % 2 else "Fine.", None, None, None) for i in range(10)]
    overrides = spark.createDataFrame(BLOCK, "check_id string, glob string, field string, value string")
    rules = [{"glob": "*.md", "ruleset": "prose", "disable": catalogue_flow._but("prose", catalogue_flow.WORDED)}]
    batch = decision.decide_writes(writes(spark, rows), rules, overrides)
    assert "Exchange" not in physical(batch)
    writes(spark, rows).write.json(f"file:{tmp_path}/in")
    stream = decision.decide_writes(spark.readStream.schema(decision.WRITE).json(f"file:{tmp_path}/in"), rules, overrides)
    q = stream.writeStream.format("memory").queryName("decided").option("checkpointLocation", f"file:{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert plain(spark.sql("select * from decided").collect()) == plain(batch.collect())


def test_attempts_and_events(spark):
    events = spark.createDataFrame([(i, float(i), "deny", "a.md", [], "prose") for i in range(2)], EVENT)
    decided = spark.createDataFrame([("a.md", "deny"), ("b.md", "deny"), ("c.md", "clean")], "path string, decision string")
    got = {r["path"]: (r["attempt"], r["stop"]) for r in decision.with_attempts(decided, events).collect()}
    assert got == {"a.md": (3, True), "b.md": (1, False), "c.md": (None, False)}
    logged = decision.as_events(decided.withColumns({"kinds": F.array(F.lit("x")), "ruleset": F.lit("prose")}), 5, F.lit(1.0)).collect()
    assert {(r["file"], r["action"], tuple(r["kinds"])) for r in logged} == {("a.md", "deny", ("x",)), ("b.md", "deny", ("x",)), ("c.md", "clean", ())}


def test_packs_of_rules_become_terms(spark):
    packs = spark.createDataFrame([("p", "Shiny"), ("p", "glossy"), ("q", "dull"), ("never", "x")], "pack string, term string")
    rules = [{"glob": "a/*", "ruleset": "prose", "packs": {"marketing_adjective": ["p", "q"], "no_such_list": ["p"]}}, {"glob": "*", "ruleset": "code", "packs": {"marketing_adjective": ["p"]}, "embedded_prose": "prose"}]
    assert routing.pack_terms_by_rule(rules, packs) == {0: {("prose", "marketing_adjective"): ("dull", "glossy", "shiny")}, 1: {("prose", "marketing_adjective"): ("glossy", "shiny")}}
    files = spark.createDataFrame([("a/x.md", "A dull one."), ("b/x.py", 'x = "one glossy text in here"'), ("b/y.py", 'x = "one dull text in here"')], "path string, text string")
    got = {r["path"]: r["semantic"] for r in routing.lint_routed(files, rules, packs=packs).collect()}
    assert got == {"a/x.md": 1, "b/x.py": 1, "b/y.py": 0}


def test_project_terms_of_a_pack_pass_the_vocabulary(spark):
    rules = [{"glob": "*", "ruleset": "controlled", "packs": {"project_terms": ["p"]}}]
    packs, files = spark.createDataFrame([("p", "zorp")], "pack string, term string"), spark.createDataFrame([("x", "Stop the zorp.")], "path string, text string")
    context = {"controlled": {"dictionary": catalogue_flow.dictionary(spark)}}
    assert routing.lint_routed(files, rules, context=context).first()["semantic"] == 1
    assert routing.lint_routed(files, rules, packs=packs, context=context).first()["semantic"] == 0
