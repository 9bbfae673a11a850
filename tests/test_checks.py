"""Golden cases of the checks, and the units that they see."""

import re

import pytest
from pyspark.sql import functions as F

from prosemetrics.functions.custom import InvalidCheck, pattern_check, python_flags
from prosemetrics.functions.patterns import glob_regex
from prosemetrics.operators import lint, structure
from prosemetrics.plans.registry import UnknownRuleset, check_table, register, ruleset, rulesets

# (ruleset, check, text, labels in order)
CASES = [
    ("prose", "filler_opener", "Needless to say, part 7 was late.", ["Needless to say"]),
    ("prose", "filler_opener", "Part 7, needless to say, was late.", []),
    ("prose", "stock_adverb", "Notably, it ran. It was, arguably, fine.", ["Notably", "arguably"]),
    ("prose", "colon_reveal", "The truth: it works.", ["The truth:"]),
    ("prose", "colon_reveal", "Note: it works. **Bold**: it works. Step 2: go on.", []),
    ("prose", "binary_contrast", "It is not fast. It is slow.", ["It is not fast."]),
    ("prose", "binary_contrast", "This is not a bug. It is also not fixed yet.", []),
    ("prose", "rule_of_three", "We saw running, jumping, and falling there.", ["running, jumping, and falling"]),
    ("prose", "copula_avoidance", "It serves as a lid and acts as a box.", ["serves as"]),
    ("prose", "participial_tail", "It grew, underscoring the need.", [", underscoring"]),
    ("prose", "section_template", "## In conclusion\n\nIt works.", ["in conclusion"]),
    ("prose", "bold_density", "**a** and **b**\n| **c** | d |", [None]),
    ("prose", "thematic_break", "---\ntitle: x\n---\ntext\n\n***\n", [None]),
    ("prose", "title_case_heading", "# The Very Big Heading\n", ["The Very Big Heading"]),
    ("prose", "title_case_heading", "# The very big heading\n", []),
    ("prose", "ai_markup_remnant", "As an AI language model I can.", ["As an AI language model"]),
    ("prose", "em_dash_cluster", "a — b &mdash; c", [None]),
    ("prose", "weasel_attribution", "Studies show it. Experts agree.", ["Studies show", "Experts agree"]),
    ("prose", "entity_encoded_punctuation", "a &bull; b &mdash; c &sect; d", ["&mdash;", "&sect;", "&bull;"]),
    ("prose", "bold_bullet_lead", "- **Lead** text\n- **Done.** text\n- **Alone**", ["Lead"]),
    ("prose", "id_label_lead", "- A1: The thing\n- A2 is a thing\n- **B-3** The thing", ["A1", "B-3"]),
    ("prose", "not_just_x_but_y", "It is not just fast but cheap.", ["not just fast but"]),
    ("prose", "vague_intensifier", "It is very, really good. `very` is code.", ["very", "really"]),
    ("prose", "emoji_in_prose", "Done ✅ now 🎉.", ["✅", "🎉"]),
    ("prose", "marketing_adjective", "A Seamless, robust tool.", ["Seamless", "robust"]),
    ("prose", "filler_verb", "It leverages this. We delve into that and delve on.", ["leverages", "delve"]),
    ("prose", "marketing_cliche", "A hidden gem; look no further.", ["hidden gem", "look no further"]),
    ("prose", "solicit_criticism", "Roast it, and tell me what's wrong.", ["Roast it", "tell me what's wrong"]),
    ("prose", "unearned_profundity", "Everything changed. Everything changed here.", ["Everything changed."]),
    ("prose", "dramatic_fragmentation", "Full stop. That's it.", ["Full stop.", "That's it."]),
    ("prose", "canned_question_answer", "Why bother? Because it works.", ["Why bother?"]),
    ("prose", "negative_listing", "Not fast. Not cheap. Not new.", ["Not fast."]),
    ("prose", "negative_listing", "Not fast. Not cheap. Not new. Not old.", ["Not fast.", "Not new."]),
    ("prose", "identifier_in_prose", "Set max_part_size here, not `other_name`.", ["max_part_size"]),
    ("prose", "vague_intensifier", "```\nvery\n```\nIt is quite so.\n```\nreally", ["quite"]),
    ("code", "trivial_comment", "# Import the thing\nimport x\n# Import the thing\n\nx = 1", ["# Import the thing"]),
    ("code", "trivial_comment", "# Import this because it is needed\nimport x", []),
    ("code", "narrative_comment", "# -------\n# Step 1: go\n# we moved it\nx = 1", ["# -------", "# Step 1: go", "# we moved it"]),
    ("code", "meta_comment", "# as per the spec\n# previously we did, because of x", ["# as per the spec"]),
    ("code", "swallowed_exception", "try:\n    f()\nexcept ValueError:\n\n    pass", ["except ValueError:"]),
    ("code", "swallowed_exception", "try:\n    f()\nexcept ValueError as ignored:\n    pass", []),
    ("code", "mutable_default_arg", "def f(a=[], b={}, c=1):\n    x = []", ["a=[]", "b={}"]),
    ("code", "print_debug", "def f():\n    print(1)", ["print(1)"]),
    ("code", "print_debug", "print(1)", []),
    ("code", "todo_stub", "# TODO: fix\n# FIXME see #12\n# HACK AB-1", ["# TODO: fix"]),
    ("code", "generic_naming", "data1 = temp_2\ndata3", ["data1", "temp_2"]),
    ("code", "tautological_assert", "    assert True\nassert x", ["assert True"]),
    ("code", "constant_condition", "if True:\nwhile True:\nwhile False:", ["True", "False"]),
    ("controlled", "safety_instruction", "WARNING: but stop.\n\nCAUTION: Stop, or it can cause harm.\n\nDANGER:", ["WARNING", "WARNING", "DANGER"]),
    ("controlled", "length", "One " + "two " * 20 + "end.", [None]),
    ("controlled", "length", "One " + "two " * 18 + "end.", []),
    ("controlled", "length", "1. One " + "two " * 20 + "end.", [None]),
    ("controlled", "ing_form", "Testing the wing in the morning is missing.", ["Testing"]),
    ("controlled", "perfect_tense", "It has been done. They have written and had stopped. It has three.", ["has been", "have written", "had stopped"]),
    ("controlled", "progressive", "He was running and is going.", ["was running", "is going"]),
    ("controlled", "passive", "It was tested and is opened.", ["was tested", "is opened"]),
    ("controlled", "modal", "You may need to stop. You should go. He could run.", ["may", "should", "could"]),
    ("controlled", "punctuation", "Don't; it's the system's.", [None, "Don't", "it's"]),
    ("controlled", "trailing_condition", "Stop the line when it is on. If it is on then stop when you can.", [None]),
    ("controlled", "latin_abbrev", "Use it, e.g. here, etc. and so on.", ["e.g.", "etc."]),
    ("controlled", "inclusive_language", "He saw the women.", ["He", "women"]),
    ("controlled", "synonym_rotation", "Check it and verify it. Run it.", [None]),
]


@pytest.fixture(scope="module")
def found(spark):
    out = {}
    for name in ("prose", "code", "controlled"):
        texts = [(i, t) for i, (r, _, t, _) in enumerate(CASES) if r == name]
        rows = lint.flags(spark.createDataFrame(texts, "doc_id long, text string"), name).orderBy("doc_id", *lint.ORDER).collect()
        for r in rows:
            out.setdefault((r["doc_id"], r["kind"]), []).append(r)
    return out


@pytest.mark.parametrize("n", range(len(CASES)), ids=[f"{c}-{i}" for i, (_, c, *_) in enumerate(CASES)])
def test_case(found, n):
    _, check, _, labels = CASES[n]
    assert [r["label"] for r in found.get((n, check), [])] == labels


def test_every_check_but_two_has_a_case_that_hits():
    hit = {c for _, c, _, labels in CASES if labels}
    assert {c.id for r in rulesets() for c in ruleset(r).checks} - hit == {"vocabulary", "terminology", "paragraph_uniformity"}


def test_counts_and_replacements(found):
    at = lambda check: found[next(n for n, c in enumerate(CASES) if c[1] == check), check][0]
    assert at("bold_density")["occurrences"] == 2 and at("em_dash_cluster")["occurrences"] == 2 and at("thematic_break")["occurrences"] == 1
    rows = {r["label"]: r for (i, c), rows in found.items() if c in ("modal", "perfect_tense", "progressive") for r in rows}
    assert rows["may"]["auto_fix"] is False and rows["should"]["rule"] == "10.6" and rows["could"]["replacement"] == "can"
    assert rows["have written"]["replacement"] == "wrote" and rows["was running"]["bucket"] == "mechanical" and rows["is going"]["bucket"] == "semantic"


def test_paragraph_uniformity_and_terminology(spark):
    even = "\n\n".join(["word " * n for n in (22, 23, 24, 25)])
    uneven = "\n\n".join(["word " * n for n in (20, 60, 24, 90)])
    docs = spark.createDataFrame([(1, even), (2, uneven), (3, "A Widget here.")], "doc_id long, text string")
    rows = lint.flags(docs, "prose", {"lexicon": {"widget": "say part"}}).filter("kind in ('paragraph_uniformity', 'terminology')").collect()
    assert sorted((r["doc_id"], r["kind"], r["note"]) for r in rows if r["kind"] == "terminology") == [(3, "terminology", "say part")]
    assert [r["doc_id"] for r in rows if r["kind"] == "paragraph_uniformity"] == [1]


def test_extra_terms_extend_a_check(spark):
    docs = spark.createDataFrame([(1, "A shiny tool.")], "doc_id long, text string")
    assert lint.flags(docs, "prose", {"extra": {"marketing_adjective": ("shiny",)}}).select("label").collect()[0]["label"] == "shiny"


def test_sentences_and_blocks(spark):
    text = "# Head\nFirst line\nsecond line. Next one? yes.\n\n- item one\n1. item two\n```\ncode. More.\n```\nTail.\n```\nopen"
    d = structure.with_units(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    got = {r["doc_id"]: ([s["sentence"] for s in r["sentences"]], r["list_lines"]) for r in d.collect()}
    assert got[1] == (["Head", "First line second line.", "Next one? yes.", "item one", "item two", "Tail."], ["- item one", "1. item two"])
    assert got[2] == ([], []) and got[3] == ([], [])
    b = structure.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r["type"], r["content"]) for r in b] == [("header", "# Head"), ("paragraph", "First line second line. Next one? yes."), ("blank", ""), ("list_item", "- item one"), ("list_item", "1. item two"), ("fence", "```\ncode. More.\n```"), ("paragraph", "Tail."), ("fence", "```\nopen")]


def test_sentences_equal_those_of_the_blocks(spark):
    """The separators of the string form against the windows of the table form, on random line mixes."""
    import random

    rng = random.Random(5)
    kinds = ["# Head", "  ## In. Two", "- item. More", "12) num", "```", "", "   ", "Word one. Two! three", "  padded  ", "#nohead", "-noitem", "``` py"]
    docs = spark.createDataFrame([(i, "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 14)))) for i in range(300)], "doc_id long, text string")
    parts = structure.blocks(docs).filter("type not in ('fence', 'blank')")
    body = F.when(F.col("type") == "header", F.regexp_replace("content", r"^#{1,6}\s", "")).when(F.col("type") == "list_item", F.regexp_replace("content", r"^\s*(?:[-*+]|\d+[.)])\s+", "")).otherwise(F.col("content"))
    want = parts.withColumn("s", structure.sentences(structure.trim(body))).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"])).alias("want"))
    got = structure.with_units(docs).select("doc_id", F.transform("sentences", lambda s: s["sentence"]).alias("got"))
    assert got.join(want, "doc_id", "left").filter("got <> coalesce(want, array())").count() == 0


def test_dedup_gate_and_status(spark):
    docs = spark.createDataFrame([(1, "It is very big. It is Very small. It is really so."), (2, "Notably, it ran."), (3, "It ran."), (4, "a — b — c — d — e")], "doc_id long, text string")
    merged = lint.dedup(lint.flags(docs, "prose"), "prose")
    assert {(r["label"], r["occurrences"]) for r in merged.filter("doc_id = 1").collect()} == {("very", 2), ("really", None)}
    strict = check_table(spark, "prose").withColumn("action", F.when(F.col("check_id").isin("vague_intensifier", "em_dash_cluster"), "block").otherwise("warn")).withColumn("threshold", F.when(F.col("check_id") == "vague_intensifier", 4).otherwise(F.col("threshold")))
    weights = {(r["doc_id"], r["kind"]): (r["weight"], r["blocks"]) for r in lint.gate(merged, strict).collect()}
    assert weights[1, "vague_intensifier"] == (3, False) and weights[4, "em_dash_cluster"] == (4, True)
    status = {r["doc_id"]: (r["status"], r["would_block"]) for r in lint.lint(docs, "prose", config=strict).collect()}
    assert status == {1: ("semantic_flags", False), 2: ("mechanical_violations", False), 3: ("clean", False), 4: ("semantic_flags", True)}


def test_code_flags_are_not_merged(spark):
    docs = spark.createDataFrame([(1, "assert True\nassert True")], "doc_id long, text string")
    assert lint.dedup(lint.flags(docs, "code"), "code").count() == 2


def test_a_disabled_check_is_not_built(spark):
    docs = spark.createDataFrame([(1, "It is very big.")], "doc_id long, text string")
    assert lint.flags(docs, "prose", disabled=("vague_intensifier",)).count() == 0
    plan = lint.flags(docs, "prose", disabled=("vague_intensifier",))._jdf.queryExecution().toString()
    assert "significantly" not in plan


def test_flags_need_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Exchange" not in lint.flags(docs, "prose")._jdf.queryExecution().executedPlan().toString()


def test_adding_a_clean_document_changes_nothing_and_repeating_doubles(spark):
    a = spark.createDataFrame([(1, "It is very big.")], "doc_id long, text string")
    b = a.union(spark.createDataFrame([(2, "It ran.")], "doc_id long, text string"))
    rows = lambda d: sorted(map(tuple, lint.flags(d, "prose").collect()), key=str)
    assert rows(a) == rows(b)
    assert lint.flags(a.union(a.withColumn("doc_id", F.lit(9))), "prose").count() == 2 * len(rows(a))


def test_ratchet(spark):
    rows = [("new", None, "It is very big."), ("same", "It is very big.", "It is quite big."), ("worse", "It is very big.", "It is very, really big."), ("better", "It is very, really big.", "It is big.")]
    strict = check_table(spark, "prose").withColumn("action", F.lit("block"))
    got = {r["path"]: r["deny"] for r in lint.ratchet(spark.createDataFrame(rows, "path string, before string, after string"), "prose", config=strict).collect()}
    assert got == {"new": True, "same": False, "worse": True, "better": False}


def test_registry(spark):
    with pytest.raises(UnknownRuleset):
        ruleset("nope")
    r = ruleset("prose")
    with pytest.raises(ValueError):
        register(type(r)("twice", (r.checks[0], r.checks[0])))
    assert check_table(spark).count() == 54


def test_custom_checks(spark):
    rules = ruleset("prose")
    with pytest.raises(InvalidCheck):
        pattern_check(rules, "filler_opener", "x")
    with pytest.raises(InvalidCheck):
        pattern_check(rules, "Bad Id", "x")
    docs = spark.createDataFrame([(1, "Foo here. Bar there.")], "doc_id long, text string")
    more = rules.with_checks((pattern_check(rules, "foo_word", r"\bfoo\b"),))
    assert lint.flags(docs, more).filter("kind = 'foo_word'").count() == 1
    rows = python_flags(docs, rules, "long_word", lambda s: [(w, "long") for w in s.split() if len(w) > 4]).collect()
    assert [(r["label"], r["item_ord"]) for r in rows] == [("here.", 0), ("there.", 1)]


def test_glob():
    import fnmatch
    import re

    for g in ("*.md", "docs/*", "a?b", "[ab]*.py", "[!a]x", "x[", "a.b"):
        for p in ("docs/a/b.md", "a.md", "axb", "b.py", "ax", "bx", "x[", "a.b", "aXb", "a\nb"):
            assert bool(re.match(glob_regex(g).replace("\\z", "\\Z"), p)) == fnmatch.fnmatchcase(p, g), (g, p)


def test_the_register_sets_the_limit_of_words(spark):
    """A sentence is procedure unless told otherwise: 20 words; as description, 25, but for numbered steps."""
    docs = spark.createDataFrame([(1, "One " + "two " * 20 + "end."), (2, "1. One " + "two " * 20 + "end."), (3, "One " + "two " * 24 + "end.")], "doc_id long, text string")
    only = [c.id for c in ruleset("controlled").checks if c.id != "length"]
    at = lambda **how: sorted(r["doc_id"] for r in lint.flags(docs, "controlled", disabled=only, **how).collect())
    assert at() == [1, 2, 3] and at(register="description") == [2, 3]


def test_flags_are_merged_and_judged_in_the_row_as_by_shuffles(spark):
    """The row-wise path against the table-wise one, on every case of every ruleset; its plan has no exchange."""
    for name in ("prose", "code", "controlled"):
        docs = spark.createDataFrame([(i, t) for i, (r, _, t, _) in enumerate(CASES) if r == name] + [(-1, None), (-2, "very Very very. " * 3)], "doc_id long, text string")
        merged = lint.dedup(lint.flags(docs, name), name)
        row = lambda df: sorted(map(str, df.select("doc_id", *lint.ORDER, "kind", "bucket", "label", "occurrences").collect()))
        assert row(lint.merged_flags(docs, name)) == row(merged)
        table = check_table(spark, name)
        assert sorted(map(tuple, lint.gate_documents(docs, name).collect())) == sorted(map(tuple, lint.gate(merged, table).select("doc_id", "kind", "weight", "threshold", "action", "triggered", "blocks").collect()))
        verdicts = lint.lint(docs, name)
        assert sorted(map(tuple, verdicts.collect())) == sorted(map(tuple, lint.verdicts(docs, merged, table).collect()))
        assert "Exchange" not in verdicts._jdf.queryExecution().executedPlan().toString()


def test_cheap_tests_leave_no_flag_out(spark):
    """With and without the test before a check, over all documents and texts of all the words that checks look for, in odd case."""
    from dataclasses import replace

    from prosemetrics.checks import prose
    from prosemetrics.operators import lint

    lists = (
        prose.STOCK_ADVERBS, prose.COPULA_DODGES, prose.SECTION_TEMPLATES, prose.WEASEL_PHRASES, prose.MARKETING_CLICHES, prose.MARKETING_ADJECTIVES, prose.VAGUE_INTENSIFIERS,
        prose.PROFUNDITIES, prose.FRAGMENTS, tuple(f"it, {p} it" for p in prose.TAIL_PARTICIPLES), tuple(v.replace("[sz]", "s").replace("?", "") for v in prose.FILLER_VERBS),
        ("It's worth noting that", "it is important to note that", "needless to say", "at the end of the day", "when all is said and done", "in today's fast-paced", "in this ever-changing", "in this rapidly evolving"),
        ("roast it", "tell me what's wrong", "happy to hear what is off", "happy to hear what's off", "let me know how it could be improved", "would love your feedback on this", "delve into", "delves deeper"),
        ("not just a but b", "the reveal: here it is", "&mdash; &#8212; &sect; &bull;", "\U0001f600", "a_name", "going, coming, and staying", "it's not so. It's more.", "not this. Not that.", "Why so? Because."),
        ("# A Title In Case", "---\n\n---\n\n***", "**a** **b**", "oaicite", "[cite: 3]", "[INSERT NAME]", "TODO: fill in", "as of my last update", "\u2014 \u2014", "\n\n".join(["word " * 20] * 5)),
    )
    odd = (lambda x: x, str.upper, str.capitalize, lambda x: x.replace("s", "\u017f").replace("k", "\u212a"), lambda x: x.replace("i", "\u0130"), lambda x: x.replace("i", "\u0131"))
    texts = [how(x) for some in lists for x in some for how in odd]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("-1 - doc_id AS doc_id", "text"))
    plain = replace(prose.RULESET, checks=tuple(replace(c, likely=None) for c in prose.RULESET.checks))
    extra = {"extra": {"stock_adverb": ("Title",), "filler_verb": ("größer",)}, "lexicon": {"Reveal": "", "case": ""}}
    for context in ({}, extra):
        got, want = (lint.flag_arrays(docs, r, dict(context)).selectExpr("doc_id", "to_json(found) AS f").collect() for r in (prose.RULESET, plain))
        assert sorted(got) == sorted(want)
    assert len({k for r in want for k in re.findall(r'"kind":"(\w+)"', r["f"])}) >= 24


def test_cheap_tests_and_candidates_lose_no_controlled_flag(spark):
    """The same flags without the tests of literals, vocabulary by joins, and kinds counted without their flags."""
    from dataclasses import replace

    from prosemetrics.catalogue import _dictionary
    from prosemetrics.checks.controlled import RULESET
    from prosemetrics.operators import lint, vocabulary
    from prosemetrics.plans.derived import derived

    docs = derived(spark, "/root/testdata/sf0.001", "sentences").limit(120).unionByName(
        spark.createDataFrame([(-1, "Bes bed sells sellies sold FAILED failed usses uses 'Used' stopped stoped was isn't it. E.G. he HAS wrıtten; the runs execute"), (-2, None)], "doc_id long, text string")
    )
    plain = replace(RULESET, checks=tuple(replace(c, likely=None) for c in RULESET.checks))
    arrays = lambda rules: {r[0]: r[1:] for r in lint.flag_arrays(docs, rules, {"dictionary": _dictionary(spark)}).select("doc_id", "found", lint.merged_kinds(F.col("found"), rules), F.transform(lint.merged_array(F.col("found"), rules), lambda m: m["flag"]["kind"])).collect()}
    got = arrays(RULESET)
    assert {c.id for c in RULESET.checks if c.likely} > {"passive", "modal", "synonym_rotation"}
    assert got == arrays(plain) and all(sorted(kinds) == sorted(merged) for _, kinds, merged in got.values())
    mine = sorted((k, f["hit"]["label"], f["hit"]["type"], f["hit"]["replacement"] or "") for k, (found, *_) in got.items() for f in found if f["kind"] == "vocabulary")
    joined = vocabulary.vocabulary_flags(docs, _dictionary(spark)).select("doc_id", "label", "type", F.coalesce("replacement", F.lit(""))).collect()
    assert mine == sorted(map(tuple, joined))
