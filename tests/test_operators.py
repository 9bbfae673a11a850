"""Routing, vocabularies, corpora, history, experiments, fixes, sources and streams."""

import hashlib
import json
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from prosemetrics.operators import corpus, embedded, experiment, fix, history, routing, terms, vocabulary
from prosemetrics.plans.registry import check_table
from prosemetrics.sources import event_log, files, html, literals, rule_import, shell
from prosemetrics.streaming import history_stream


def test_routing_first_match_wins(spark):
    rules = [{"glob": "docs/old/*", "ruleset": None}, {"glob": "docs/*", "ruleset": "prose", "disable": ["a"]}, {"glob": "*.py", "ruleset": "code"}]
    paths = spark.createDataFrame([("/r/docs/old/x.md",), ("/r/docs/a/b.md",), ("/r/src/x.py",), ("/r/x.c",), ("/other/x.py",)], "path string")
    got = {r["path"]: (r["rule_ord"], r["ruleset"]) for r in routing.route(paths, rules, root="/r").collect()}
    assert got == {"/r/docs/old/x.md": (0, None), "/r/docs/a/b.md": (1, "prose"), "/r/src/x.py": (2, "code"), "/r/x.c": (None, None), "/other/x.py": (None, None)}
    found = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (None, "c")], "rule_ord int, kind string")
    assert {(r["rule_ord"], r["kind"]) for r in routing.drop_disabled(found, rules, ("c",)).collect()} == {(2, "a"), (1, "b")}
    with pytest.raises(ValueError):
        routing.route(paths, [{"glob": "*", "ruleset": "typo"}])


def test_config_overlay_ignores_invalid_fields(spark):
    rows = [("em_dash_cluster", None, "threshold", "9"), ("em_dash_cluster", "docs/*", "threshold", "7"), ("bold_density", None, "threshold", "0"), ("bold_density", None, "action", "shout"), ("bold_density", "docs/*", "action", "block"), ("nope", None, "threshold", "3")]
    over = spark.createDataFrame(rows, "check_id string, glob string, field string, value string")
    of = lambda glob: {r["check_id"]: (r["threshold"], r["action"]) for r in routing.effective_config(check_table(spark, "prose"), over, glob).collect()}
    assert of("docs/*")["em_dash_cluster"] == (7, "warn") and of(None)["em_dash_cluster"] == (9, "warn")
    assert of("docs/*")["bold_density"] == (8, "block") and of(None)["bold_density"] == (8, "warn") and len(of(None)) == 31


def test_enforced_and_held_out(spark):
    on, rest = routing.split_checks(check_table(spark, "prose"), ["bold_density"])
    assert (on.count(), rest.count()) == (1, 30)
    with pytest.raises(ValueError):
        routing.split_checks(check_table(spark, "prose"), [])


def test_terms(spark):
    rows = [("prose", "l", "Robust", "built_in", None, "b", False), ("prose", "l", "robust", "pack", "p1", "p", False), ("prose", "l", "shiny", "pack", "p2", "", False), ("prose", "l", "robust", "project", None, "j", False), ("prose", "l", "gone", "built_in", None, "", False), ("prose", "l", "gone", "project", None, None, True)]
    t = spark.createDataFrame(rows, terms.SCHEMA)
    got = {r["term"]: (r["layer"], r["note"], r["state"]) for r in terms.resolve(t, ["p1"]).collect()}
    assert got == {"robust": ("project", "j", "effective"), "gone": ("built_in", "", "suppressed")}
    banned = spark.createDataFrame([("shiny",)], "term string")
    assert {r["term"]: r["state"] for r in terms.resolve(t, None, banned).collect()}["shiny"] == "rejected"
    more, what = terms.add_term(t, "prose", "l", "New")
    assert what == "added" and terms.add_term(more, "prose", "l", "new")[1] == "present" and terms.add_term(t, "prose", "l", "gone")[1] == "restored"
    assert terms.remove_term(more, "prose", "l", "new")[1] == "removed" and terms.remove_term(t, "prose", "l", "zzz")[1] == "absent"
    assert terms.add_term(t, "prose", "l", "x", closed=True)[1] == "closed" and terms.add_term(t, "prose", "l", "shiny", forbidden=banned)[1] == "forbidden"


def test_vocabulary(spark):
    dictionary = spark.createDataFrame([("check", "approved", None), ("stop", "approved", None), ("use", "approved", None), ("utilize", "unapproved", "use"), ("bad", "unapproved", None), ("be", "approved", None)], "word string, status string, replacement string")
    docs = spark.createDataFrame([(1, "Checks stopped. It utilizes bad repository. You may use it, utilize.")], "doc_id long, text string")
    rows = vocabulary.vocabulary_flags(docs, dictionary, spark.createDataFrame([("It",)], "word string")).orderBy("item_ord", "hit_ord").collect()
    assert [(r["label"], r["type"], r["replacement"]) for r in rows] == [("utilizes", "unapproved_synonym", "use"), ("bad", "unapproved_no_replacement", None), ("repository", "unknown_vocabulary", None), ("You", "unknown_vocabulary", None), ("utilize", "unapproved_synonym", "use")]
    assert vocabulary.check_word("checked", dictionary).collect()[0]["verdict"] == "allowed"
    lines = spark.createDataFrame([(0, "# APPROVED"), (1, "use|v|"), (2, "# UNAPPROVED"), (3, "utilize|v|USE (v), APPLY"), (4, "utilize|n|USE"), (5, "odd|adj|NONE")], "n int, value string")
    got = {r["word"]: (r["status"], r["replacement"], r["alternatives"]) for r in vocabulary.parse_dictionary(lines).collect()}
    assert got == {"use": ("approved", None, []), "utilize": ("unapproved", "use", ["use", "apply"]), "odd": ("unapproved", None, [])}


def test_verdicts_at_their_borders(spark):
    measured = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0), ("d", 0.5), ("e", 1.0)], "check_id string, per_1k double")
    control = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 1.0), ("e", 1.0)], "check_id string, per_1k double")
    got = {r["check_id"]: (r["verdict"], r["ratio"]) for r in corpus.compare(measured, control).collect()}
    assert got == {"a": ("silent", None), "b": ("discriminates", None), "c": ("discriminates", 2.0), "d": ("backwards", 0.5), "e": ("no signal", 1.0)}


def test_consensus_and_calibration(spark):
    rows = [("x", "c1", 4.0, 1.0, "discriminates"), ("x", "c2", 4.0, 2.0, "discriminates"), ("y", "c1", 4.0, 0.0, "discriminates"), ("y", "c2", 4.0, 0.0, "discriminates"), ("z", "c1", 0.0, 0.0, "silent"), ("z", "c2", 4.0, 1.0, "discriminates")]
    compared = spark.createDataFrame(rows, "check_id string, control string, per_1k double, control_per_1k double, verdict string")
    assert {r["check_id"]: r["verdict"] for r in corpus.consensus(compared).collect()} == {"x": "discriminates", "y": "discriminates", "z": "disputed"}
    gated = spark.createDataFrame([("x", 0.5)], "check_id string, per_1k double")
    got = {r["check_id"]: (r["target_per_1k"], r["direction"], r["skipped"]) for r in corpus.calibrate(compared, 1.5, gated).collect()}
    assert got == {"x": (3.0, "loosen", None), "y": (None, None, "no control evidence")}


def test_activity_counts_semantic_flags_and_names_every_check(spark):
    from prosemetrics.operators import lint

    docs = spark.createDataFrame([(1, "Notably, it is very, very big."), (2, "It ran.")], "doc_id long, text string")
    merged = lint.dedup(lint.flags(docs, "prose"), "prose")
    got = {r["check_id"]: (r["hits"], r["files"], r["per_1k"]) for r in corpus.activity(docs, merged, check_table(spark, "prose")).collect()}
    assert len(got) == 31 and got["vague_intensifier"] == (1, 1, 125.0) and got["stock_adverb"] == (0, 0, 0.0)
    loud = corpus.activity(docs, merged, check_table(spark, "prose"), include_mechanical=True)
    assert loud.filter("check_id = 'stock_adverb'").collect()[0]["hits"] == 1


def log(spark, rows):
    return spark.createDataFrame(rows, history.EVENT)


def test_history_against_sequential_code(spark):
    rng = random.Random(2)
    rows, ts = [], 0.0
    for i in range(400):
        ts += rng.choice([0.5, 1.9, 2.0, 5.0])
        rows.append((i, ts if rng.random() < 0.9 else None, rng.choice(["deny", "clean", "auto_fix"]), rng.choice(["a", "b", None]), [rng.choice("xyz")], "prose"))
    kept, prev = [], None
    for r in rows:
        if not (prev and r[3] is not None and (r[3], r[2]) == (prev[3], prev[2]) and (r[1] or 0) - (prev[1] or 0) < 2.0):
            kept.append(r[0])
        prev = r
    events = log(spark, rows)
    assert [r["seq"] for r in history.dedupe_double_fire(events).orderBy("seq").collect()] == kept
    streaks = {}
    for r in rows:
        streaks[r[3]] = streaks.get(r[3], 0) + 1 if r[2] == "deny" else 0
    assert {r["file"]: r["streak"] for r in history.deny_streaks(events.filter("file is not null")).collect()} == {k: v for k, v in streaks.items() if k}
    near = {r["seq"]: r["nearby_deny"] for r in history.recent_deny(events).collect()}
    for i, r in enumerate(rows):
        assert near[i] == any(e[2] == "deny" and (r[1] or 0) - (e[1] or 0) < 300 for e in rows[max(0, i - 19) : i + 1])


def test_hit_counts(spark):
    events = log(spark, [(i, float(i * 10), "deny" if i % 2 else "config", f"f{i}", ["x"], "prose") for i in range(60)])
    counts = history.hit_counts(events, spark.createDataFrame([("x",), ("y",)], "check_id string"))
    assert {r["check_id"]: (r["hits"], r["gate_events"]) for r in counts.collect()} == {"x": (30, 30), "y": (0, 30)}
    assert [r["check_id"] for r in history.never_fired(counts).collect()] == ["y"]


def test_sign_test_is_exact_and_symmetric(spark):
    pairs = spark.createDataFrame([("r", i, 0.0, 1.0) for i in range(22)] + [("r", 50 + i, 1.0, 0.0) for i in range(4)] + [("r", 90, 1.0, 1.0)], "run string, prompt_id long, a double, b double")
    r = experiment.sign_test(pairs).collect()[0]
    p = 2 * sum(comb(26, k) for k in range(5)) / 2**26
    assert (r["wins"], r["losses"], r["ties"]) == (22, 4, 1) and r["p"] == pytest.approx(p)
    swapped = experiment.sign_test(pairs.select("run", "prompt_id", F.col("b").alias("a"), F.col("a").alias("b"))).collect()[0]
    assert swapped["p"] == pytest.approx(p) and swapped["wins"] == 4
    assert experiment.sign_test(pairs.filter("a = b")).collect()[0]["p"] == 1.0


def test_bootstrap_repeats_itself(spark):
    pairs = spark.createDataFrame([("r", i, 1.0, 2.0 + i % 3) for i in range(20)], "run string, prompt_id long, a double, b double")
    one, two = (experiment.bootstrap(pairs, draws=500).collect()[0] for _ in range(2))
    assert one == two and one["low"] <= one["mean"] <= one["high"] and one["favour"] == 1.0


def test_text_shape_drift_and_leaderboard(spark):
    r = experiment.text_shape(spark.createDataFrame([(1, "One two. Three four five six. 12."), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["words"], r[0]["sentences"], r[0]["mean_sentence_words"], r[0]["sentence_length_stdev"], r[0]["type_token_ratio"]) == (6, 2, 3.0, 1.41, 1.0)
    assert (r[1]["words"], r[1]["sentences"], r[1]["mean_sentence_words"]) == (0, 0, 0.0)
    turns = spark.createDataFrame([("a", 0, 5), ("a", 2, 3), ("b", 0, 1)], "arm string, turn int, total int")
    assert {(x["arm"], x["turn"]): x["change"] for x in experiment.drift(turns).collect()} == {("a", 0): 0.0, ("a", 2): -2.0, ("b", 0): 0.0}


def test_replay_and_digest(spark):
    messages = [{"role": "user", "content": 'say "hi"\n\tnow \\ ö' + "".join(map(chr, range(32)))}]
    want = hashlib.sha256(json.dumps(messages, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    assert df.select(experiment.message_digest(F.col("m"))).collect()[0][0] == want
    requests = spark.createDataFrame([(1, "d"), (2, "d"), (3, "d")], "call_seq int, digest string")
    hits, misses = experiment.replay(requests, spark.createDataFrame([("d", 0, "a"), ("d", 1, "b")], "digest string, occurrence int, output string"))
    assert sorted((r["call_seq"], r["output"]) for r in hits.collect()) == [(1, "a"), (2, "b")] and misses.count() == 1


def test_gated_loop_stops_when_clean(spark):
    prompts = spark.createDataFrame([("p",), ("q",)], "prompt_id string")
    write = lambda df: df.select("prompt_id", F.when((F.col("prompt_id") == "q") | (F.col("iteration") < 3), "bad").otherwise("good").alias("text"))
    judge = lambda df: df.filter("text = 'bad'").groupBy("prompt_id").agg(F.count("*").alias("flags"))
    got = {r["prompt_id"]: (r["text"], r["iterations"], r["passed"]) for r in experiment.gated_loop(prompts, write, judge).collect()}
    assert got == {"p": ("good", 3, True), "q": ("bad", 4, False)}


def test_fixes(spark):
    cases = [("prose", "Notably, it ran.", "It ran."), ("prose", "It was, arguably, `notably` fine 🎉 &mdash; so.", "It was `notably` fine — so."), ("controlled", "It has been done; you may stop.", "It was done. You can stop."), ("controlled", "He was running, e.g. here. Don't `can't` it.", "He ran, for example here. do not `can't` it."), ("prose", "# Notably fine\n\n- notably one\n```\nnotably\n```\nLine a\nline b.", "# fine\n\n- One\n```\nnotably\n```\nLine a line b."), ("code", "x = 1", "x = 1")]
    for rules, before, after in cases:
        got = fix.fix(spark.createDataFrame([(before,)], "text string"), rules).collect()[0]["fixed"]
        assert got == after, (before, got)
    native = spark.createDataFrame([(b,) for r, b, _ in cases[:2]], "text string").select(fix.fix_prose_sentence(F.col("text")).alias("t")).collect()
    assert [r["t"] for r in native] == [a for *_, a in cases[:2]]
    kept = fix.fix(spark.createDataFrame([("It was, arguably, fine 🎉.",)], "text string"), disabled=("stock_adverb",)).collect()[0]["fixed"]
    assert kept == "It was, arguably, fine."


def test_fixes_keep_blocks(spark):
    """Fences and blank lines stay byte for byte, list items and headings keep their lines, paragraphs are joined."""
    cases = [
        ("# notably a head\n\nnotably one.\nstill  one. Two,\n- notably item\n  12) notably  x\n   \nlast", "# a head\n\nOne. still one. Two,\n- Item\n  12) X\n   \nLast"),
        ("```\nnotably  raw\n\n```\nnotably done\n", "```\nnotably  raw\n\n```\nDone\n"), ("a b\n```x\nnotably\n", "A b\n```x\nnotably\n"), ("```\na\n```\n\n```\nb\n```", "```\na\n```\n\n```\nb\n```"),
        ("```\na\n```\n```\nb\n```\n\n\nx", "```\na\n```\n```\nb\n```\n\n\nX"), ("", ""), ("\n", "\n"), ("\n\nx\n\n", "\n\nX\n\n"), ("- ", "- "), (None, None), ("#x y", "#x y"),
    ]
    got = fix.fix(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, text string")).orderBy("i").collect()
    assert [r["fixed"] for r in got] == [a for _, a in cases]


def test_edits_and_decisions(spark):
    df = spark.createDataFrame([("aXbX", "X", "y", False), ("aXbX", "X", "y", True), ("a", "X", "y", True)], "t string, o string, n string, every boolean")
    assert [r[0] for r in df.select(fix.apply_edit(F.col("t"), F.col("o"), F.col("n"), F.col("every"))).collect()] == ["aybX", "ayby", None]
    d = fix.decide(spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "mechanical int, blocking int"))
    assert [r["decision"] for r in d.collect()] == ["deny", "auto_fix", "clean"]


def test_literals_and_embedded_prose(spark):
    source = '"""A very big module here."""\nx = "three words only"\ny = f"this is {x} quite big"\nz = b"not a text at all"\n'
    assert literals.literals(source) == [(1, "A very big module here."), (3, "this is X quite big")] and literals.literals("def (") == []
    docs = spark.createDataFrame([("a.py", source), ("b.py", "def (")], "path string, text string")
    assert {(r["label"], r["embedded_line"]) for r in embedded.embedded_flags(docs).collect()} == {("very", 1), ("quite", 3)}
    assert literals.docstrings(docs, least=3).count() == 1


def test_html(spark):
    page = "<p>" + "word " * 25 + "<sup>1</sup></p><table><tr><td><p>" + "cell " * 30 + "</p></td></tr></table><p>short</p>"
    nested = "<figure><table><tr><td><p>" + "no " * 30 + "</p></td></tr></table></figure><script>if (a<b) '<p>" + "x " * 30 + "</p>'</script><!-- <p> --><p>A &amp; B &eacute;&#8212;&#x41;&unknown; <b>bold</b>\n" + "word " * 25 + "</P>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, nested), (4, "<p>" + "open " * 30), (5, "<p>lost <p>" + "kept " * 20 + "</p> outside")], "page_id long, html string")
    got = {r["page_id"]: (r["ord"], r["paragraph"]) for r in html.html_paragraphs(pages).collect()}
    assert got == {1: (0, ("word " * 25).strip()), 3: (0, "A & B é—A&unknown; bold " + ("word " * 25).strip()), 5: (0, ("kept " * 20).strip())}
    assert html.flat_paragraphs(pages.filter("page_id = 1")).count() == 1


def test_shell_writes(spark):
    rows = [("cat > a.md <<'EOF'\nhi $x\nEOF", ("a.md", "hi $x\n")), ("cat > a.md <<EOF\nhi $x\nEOF", None), ("cat <<-EOF | tee b.txt\n\tone\n\tEOF", ("b.txt", "one\n")), ("echo 'x' > c.md", ("c.md", "x")), ('echo "$x" > c.md', None), ("echo 'x' | tee -a d.md", ("d.md", "x")), ("echo x > c.md", None), ("echo 'x' > c.bin", None), ("echo $(ls) > c.md", None)]
    got = shell.shell_writes(spark.createDataFrame([(c,) for c, _ in rows], "command string")).collect()
    assert [(r["target"], r["text"]) if r["target"] else None for r in got] == [w for _, w in rows]


def test_rule_import(spark):
    ok = "extends: existence\nmessage: 'No %s'\nlevel: error\nignorecase: true\ntokens:\n  - obviously\n  - of course\n"
    swap = "extends: substitution\nmessage: Use it\nswap:\n  utilize: use\n  \"in order to\": to\n"
    done, refused = rule_import.import_rules([("ObviousWords", ok), ("Odd", ok.replace("error", "nonsense")), ("Swap", swap), ("Script", "extends: script\nscript: x"), ("Bad", "extends: existence\ntokens:\n  - '(?P<x>a)'\n")], spark)
    assert [(c.id, c.action) for c in done] == [("vale_obvious_words", "block"), ("vale_swap", "warn")] and [n for n, _ in refused] == ["Odd", "Script", "Bad"]
    from prosemetrics.operators import lint
    from prosemetrics.plans.registry import ruleset

    docs = spark.createDataFrame([(1, "Obviously we utilize it, obviously.")], "doc_id long, text string")
    rows = lint.flags(docs, ruleset("prose").with_checks(tuple(done))).filter("kind in ('vale_swap', 'vale_obvious_words')").collect()
    assert sorted((r["label"], r["replacement"], r["note"]) for r in rows) == [("Obviously", None, "rewrite it"), ("utilize", "use", "use 'use' instead")]
    assert rule_import.check_id("AbstractTriad") == "vale_abstract_triad" and rule_import.check_id("Cliche", "aitells") == "aitells_cliche"
    assert rule_import.catches_and_remedy("'%s' is a cliche: cut it") == ("'this' is a cliche", "cut it")


def test_tree_scan_packs_and_prompts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.md").write_text("Hello there.")
    (tmp_path / "a" / "blank.md").write_text(" \n")
    (tmp_path / "a" / "bad.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "node_modules" / "y.md").write_text("no")
    for name in ("__init__.py", "_part.md.txt", ".github/x.rst", "a/b/deep.txt", "a/site-packages/no.txt", ".cache/no.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("Some text.")
    every = files.scan_tree(spark, f"file:{tmp_path}").collect()
    assert sorted(r["path"].split(tmp_path.name + "/")[1] for r in every) == [".github/x.rst", "__init__.py", "_part.md.txt", "a/b/deep.txt", "a/bad.md", "a/blank.md", "a/x.md"]
    assert [r["text"] for r in files.scan_tree(spark, str(tmp_path / "__init__.py")).collect()] == ["Some text."]
    got = files.scan_tree(spark, f"file:{tmp_path}", "*.md")
    assert sorted(r["state"] for r in got.collect()) == ["blank", "ok", "unreadable"]
    assert tuple(files.scan_counts(got).collect()[0]) == (1, 1, 1)
    lines = spark.createDataFrame([("# c",), ("Word: a note: more",), ("plain # x",), ("",)], "value string")
    assert sorted(map(tuple, files.pack_terms(lines).collect())) == [("plain", ""), ("word", "a note: more")]
    md = ["## one", "Do it.", "### next", "Again.", "## two", "Other."]
    prompts = files.prompt_set(spark.createDataFrame(list(enumerate(md)), "n int, value string")).collect()
    assert [(r["id"], r["text"], r["turns"]) for r in prompts] == [("one", "Do it.", ["Do it.", "Again."]), ("two", "Other.", ["Other."])]
    with pytest.raises(ValueError):
        files.prompt_set(spark.createDataFrame(list(enumerate(["## a", "x", "## a", "y"])), "n int, value string"))


def test_event_log_and_streams(spark, tmp_path):
    rows = [{"seq": i, "ts": i * 1.0, "action": "deny" if i % 3 else "clean", "file": f"f{i % 2}", "kinds": ["x"]} for i in range(12)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "e.json").write_text("\n".join([*map(json.dumps, rows), "", "not json"]))
    events = event_log.read_events(spark, f"file:{tmp_path}/log")
    assert events.count() == 12 and events.select("ruleset").distinct().collect()[0][0] == event_log.LEGACY_RULESET
    stream = event_log.stream_events(spark, f"file:{tmp_path}/log").filter("seq is not null")
    q = history_stream.deny_streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("append").option("checkpointLocation", f"file:{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["file"]: r["streak"] for r in spark.sql("select file, max_by(streak, seq) as streak from streaks group by file").collect()}
    assert last == {r["file"]: r["streak"] for r in history.deny_streaks(events).collect()}
    q = history_stream.keep_summary(stream, f"file:{tmp_path}/sum", f"file:{tmp_path}/c2")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file:{tmp_path}/sum/summary").collect()[0]["hits"] == 12
    (tmp_path / "log" / "f.json").write_text(json.dumps({"seq": 12, "ts": 500.0, "action": "deny", "file": "f0", "kinds": ["x", "y"]}))
    for _ in range(2):  # the second time there is nothing new
        q = history_stream.keep_summary(stream, f"file:{tmp_path}/sum", f"file:{tmp_path}/c2")
        q.awaitTermination(120)
        assert {r["kind"]: r["hits"] for r in spark.read.parquet(f"file:{tmp_path}/sum/summary").collect()} == {"x": 13, "y": 1}
    (tmp_path / "log" / "f.json").unlink()
    q = history_stream.recent_denials(stream).writeStream.format("memory").queryName("nearby").outputMode("append").option("checkpointLocation", f"file:{tmp_path}/c4").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("select * from nearby").collect()} == {(r["seq"], r["nearby_deny"]) for r in history.recent_deny(events).collect()}
    for text in ("one", "two"):
        event_log.write_report(spark.createDataFrame([(text,)], "a string"), f"file:{tmp_path}/report")
        assert [r["value"] for r in spark.read.text(f"file:{tmp_path}/report").collect()] == [json.dumps({"a": text}, separators=(",", ":"))]
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("report.")]
    q = history_stream.without_double_fires(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", f"file:{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from once").count() <= 12


def test_routed_lint(spark):
    from prosemetrics.operators import routing

    rows = [("docs/a.md", "It is very big."), ("blog/a.md", "It is very big."), ("b.py", "x = 1  # increment x\n"), ("c.csv", "very"), (".claude/x.md", "very"), ("d.md", " \n"), ("e.md", None)]
    files_ = spark.createDataFrame(rows, "path string, text string")
    rules = [*routing.DEFAULT_RULES[:1], {"glob": "blog/*", "ruleset": "prose", "disable": ["vague_intensifier"]}, *routing.DEFAULT_RULES[1:]]
    over = spark.createDataFrame([("vague_intensifier", None, "action", "block"), ("vague_intensifier", "*.md", "threshold", "2")], "check_id string, glob string, field string, value string")
    got = {r["path"]: (r["ruleset"], r["status"], r["would_block"]) for r in routing.lint_routed(files_, rules, over.filter("field = 'action'")).collect()}
    assert got["docs/a.md"] == ("prose", "semantic_flags", True) and got["blog/a.md"] == ("prose", "clean", False) and got["b.py"][0] == "code"
    assert got["c.csv"] == (None, "out_of_scope", False) and got[".claude/x.md"][1] == "out_of_scope" and got["d.md"][1] == got["e.md"][1] == "blank"
    assert not {r["path"]: r["would_block"] for r in routing.lint_routed(files_, rules, over).collect()}["docs/a.md"]
    assert routing.routed_summary(routing.lint_routed(files_, rules)).collect()[0]["out_of_scope"] == 2


def test_configuration(spark):
    from prosemetrics.operators import config, routing
    from prosemetrics.plans import registry

    table = config.rules_table(spark)
    assert [r["glob"] for r in table.orderBy("ord").collect()] == [r["glob"] for r in routing.DEFAULT_RULES]
    given = spark.createDataFrame([('{"rulesets": [{"glob": "*.md", "ruleset": "prose", "packs": {"terminology": ["web"]}}], "options": 1, "terms": {}}',)], "value string")
    loaded = config.load_rules(given)
    assert [(r["glob"], r["packs"]) for r in loaded.collect()] == [("*.md", {"terminology": ["web"]})] and [r["key"] for r in config.stray_keys(given).collect()] == ["options"]
    assert config.load_rules(given.limit(0)).count() == len(routing.DEFAULT_RULES)
    bound = config.set_rule_packs(loaded, "*.md", "stock_adverb", ["law"], ["law", "web"])
    assert bound.collect()[0]["packs"] == {"terminology": ["web"], "stock_adverb": ["law"]}
    assert config.set_rule_packs(config.set_rule_packs(bound, "*.md", "stock_adverb", []), "*.md", "terminology", []).collect()[0]["packs"] is None
    assert config.set_rule_disable(loaded, "*.md", ["filler_verb"]).collect()[0]["disable"] == ["filler_verb"]
    checks, lists = registry.check_table(spark), registry.term_lists(spark)
    for wrong in (lambda: config.set_rule_packs(loaded, "*.md", "x", ["odd"], ["law"]), lambda: config.set_rule_packs(loaded, "*.x", "x", []), lambda: config.set_rule_disable(loaded, "*.md", ["odd"], ["passive"]), lambda: config.enable(checks, {"odd": True}), lambda: config.add_term_list(lists, "prose", "Bad id"), lambda: config.add_term_list(lists, "prose", "terminology"), lambda: config.add_term_list(lists, "prose", "mine", feeds="odd")):
        with pytest.raises(ValueError):
            wrong()


def test_logs_in_ranges_give_what_one_window_gives(spark, monkeypatch):
    rng = random.Random(3)
    rows, ts = [], 0.0
    for i in range(400):
        ts += rng.choice([0.5, 1.5, 40.0, 400.0])
        rows.append((i * 2, ts, rng.choice(["deny", "clean", "auto_fix", "auto_fix"]), rng.choice(["a", "b", None]), ["x"], "prose"))
    events = spark.createDataFrame(rows, history.EVENT)
    one = [sorted(map(str, f(events).collect())) for f in (history.dedupe_double_fire, history.recent_deny)]
    for size in (3, 50):
        monkeypatch.setattr(history, "RANGE", size)
        assert [sorted(map(str, f(events).collect())) for f in (history.dedupe_double_fire, history.recent_deny)] == one


def test_sign_test_of_many_pairs(spark):
    from math import comb

    cases = [(10, 3), (60, 20), (500, 230), (1000, 500), (40, 0)]
    df = spark.createDataFrame(cases, "n long, k long")
    got = [r[0] for r in df.select(experiment.binomial_tail(F.col("n"), F.col("k"))).collect()]
    assert got == pytest.approx([sum(comb(n, i) for i in range(k + 1)) / 2**n for n, k in cases], rel=1e-11)
    huge = spark.range(1).select(experiment.binomial_tail(F.lit(10_000_000).cast("long"), F.lit(5_000_000).cast("long"))).collect()[0][0]
    assert huge == pytest.approx(0.5, abs=2e-4)


def test_manifest_in_ranges(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "s" if i % 3 else None) for i in range(60)] + [(7, "t7", "s")], "doc_id long, text string, source string")
    one, many = ({r["source"]: r for r in corpus.manifest(docs, per_range=n).collect()} for n in (1000, 10))
    assert one["s"]["documents"] == many["s"]["documents"] == 41 and one["s"]["sha256"] != many["s"]["sha256"]
    again = {r["source"]: r["sha256"] for r in corpus.manifest(docs.repartition(7), per_range=10).collect()}
    assert again == {k: r["sha256"] for k, r in many.items()}
    changed = corpus.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 40, "x").otherwise(F.col("text"))), per_range=10).collect()
    assert {r["source"]: r["sha256"] for r in changed}["s"] != again["s"]


def test_arms(spark, tmp_path):
    from prosemetrics.operators import arms

    spark.sparkContext.setCheckpointDir(f"file:{tmp_path}/ck")
    prompts = spark.createDataFrame([("p", "write p"), ("q", "write q")], "prompt_id string, prompt string")
    asked = []

    def generate(rows):
        asked.append(rows.count())
        last = F.element_at("messages", -1)["content"]
        return rows.select("prompt_id", F.concat(F.lit("bad " * 1), F.size("messages").cast("string"), F.lit(":"), last).alias("text"))

    judge = lambda rows: rows.select("prompt_id", F.when((F.col("prompt_id") == "q") & F.col("text").contains("Revise"), 0).otherwise(2).cast("long").alias("flags"), F.lit("drop it").alias("note"))
    single = {r["prompt_id"]: r for r in arms.single(prompts, generate, "be brief. ").collect()}
    assert single["p"]["text"] == "bad 1:be brief. write p" and single["p"]["iterations"] == 1 and single["p"]["passed"] is None
    blind = {r["prompt_id"]: r for r in arms.blind(prompts, generate, spark.createDataFrame([("p", 1), ("q", 3)], "prompt_id string, iterations int")).collect()}
    assert blind["p"]["text"] == "bad 1:write p" and blind["q"]["text"] == f"bad 3:{arms.BLIND_REVISION}"
    free = {r["prompt_id"]: r for r in arms.turns(prompts, ["shorter", "longer"], generate, judge).collect()}
    assert free["p"]["iterations"] == 3 and free["p"]["per_turn"] == [2, 2, 2] and free["p"]["passed"] is None and free["p"]["text"] == "bad 5:longer"
    gated = {r["prompt_id"]: r for r in arms.turns(prompts, ["shorter"], generate, judge, gate_rounds=3).collect()}
    assert (gated["p"]["iterations"], gated["p"]["passed"], gated["p"]["per_turn"]) == (6, False, [2, 2]) and (gated["q"]["iterations"], gated["q"]["passed"], gated["q"]["per_turn"]) == (4, True, [0, 0])
    saved = []
    none = spark.createDataFrame([], "digest string, occurrence int, output string")
    first = arms.single(prompts, arms.resuming(generate, none, save=lambda df: saved.append(df.select("digest", "occurrence", "output").collect()))).collect()
    recorded = spark.createDataFrame(saved[0], "digest string, occurrence int, output string")
    asked.clear()
    assert sorted(arms.single(prompts, arms.resuming(generate, recorded)).collect()) == sorted(first) and asked == [0]
    score = lambda rows: rows.select("prompt_id", F.length("text").alias("total"))
    rows = arms.run_arms({"ungated": arms.single(prompts, generate), "control": arms.single(prompts, generate), "instructed": arms.single(prompts, generate, "be brief. ")}, score)
    arms.save_run(rows, f"file:{tmp_path}/runs")
    arms.save_run(rows.filter("arm = 'control'"), f"file:{tmp_path}/runs")
    assert spark.read.parquet(f"file:{tmp_path}/runs").count() == 6
    change = {r["arm"]: r for r in arms.changes(rows, "total").collect()}
    assert (change["instructed"]["change"], change["instructed"]["direction"], change["instructed"]["finding"]) == (10.0, "WORSE", True) and not change["control"]["finding"]
    (tmp_path / "skill.md").write_text("Write plainly.\n\n")
    assert arms.load_instruction(spark, f"file:{tmp_path}/skill.md", {}) == "Write plainly.\n\n" and arms.load_instruction(spark, "a", {"a": "x"}, "!") == "x!"
    with pytest.raises(ValueError):
        arms.load_instruction(spark, "b", {"a": "x"})


def test_pack_candidates(spark):
    from prosemetrics.operators import vocabulary

    titles = spark.createDataFrame([("add-in, add-on", "n"), ("argument vs. parameter", "n"), ("AI (artificial intelligence)", "n"), ("Runs", "n"), ("cancelled", "n"), ("stop", "n")], "title string, note string")
    dictionary = spark.createDataFrame([("run", "unapproved"), ("stop", "approved"), ("cancel", "approved")], "word string, status string")
    assert sorted(r["term"] for r in vocabulary.pack_candidates(titles, dictionary).collect()) == ["add-in", "add-on", "ai", "argument", "parameter"]


def test_rulesets_of_ones_own(spark):
    from prosemetrics.plans import registry

    base = registry.ruleset("prose")
    make = lambda name, checks: type(base)(name, checks)
    reasons = registry.register_all({"good": lambda: make("good", base.checks[:2]), "none": lambda: make("none", ()), "twice": lambda: make("twice", (base.checks[0], base.checks[0])), "broken": lambda: 1 / 0, "prose": lambda: make("prose", base.checks[:1])})
    assert set(reasons) == {"none", "twice", "broken", "prose"} == set(registry.refused()) and "ZeroDivisionError" in reasons["broken"]
    assert "good" in registry.rulesets() and registry.capabilities("good") == ("checks", "fix") and registry.capabilities("prose") == ("checks", "terms", "fix")
    registry.unregister("good")
    assert "good" not in registry.rulesets()
    with pytest.raises(ValueError):
        registry.unregister("prose")


def test_arm_scores_instructions_and_top_flags(spark):
    from prosemetrics.operators import lint

    docs = spark.createDataFrame([(1, "It is very robust. It is quite big."), (2, "It ran.")], "doc_id long, text string")
    merged = lint.merged_flags(docs, "prose")
    got = {r["doc_id"]: r for r in experiment.arm_scores(experiment.text_shape(docs), merged, ["vague_intensifier"]).collect()}
    assert (got[1]["enforced_flags"], got[1]["held_out_flags"], got[2]["enforced_flags"]) == (2, merged.filter("doc_id = 1 and bucket = 'semantic' and kind <> 'vague_intensifier'").count(), 0)
    assert got[1]["enforced_per_1k"] == pytest.approx(2000 / got[1]["words"])
    one = check_table(spark, "prose").filter("check_id in ('passive', 'filler_verb', 'em_dash_cluster')")
    assert experiment.instruction(one).collect()[0]["instruction"] == "- avoid em dash cluster\n- avoid filler verb"
    assert lint.top_flags(lint.display(lint.flags(docs, "prose")), 1).count() == 1


def test_embedded_prose_that_blocks(spark):
    files_ = spark.createDataFrame([("a.py", 'x = "this is a very very big one"\n'), ("b.py", "x = 1\n")], "path string, text string")
    config_ = check_table(spark, "prose").withColumn("action", F.when(F.col("check_id") == "vague_intensifier", "block").otherwise("warn"))
    assert [(r["path"], r["kind"]) for r in embedded.embedded_blocking(files_, config_).collect()] == [("a.py", "vague_intensifier")]


def test_packs_that_a_list_can_read(spark):
    lists = spark.createDataFrame([("r", "words", "word", None, True), ("r", "both", "word", ["word", "phrase"], True), ("r", "any", None, None, True), ("r", "closed", "word", None, False)], "ruleset string, list_id string, content_kind string, accepts_kinds array<string>, accepts_packs boolean")
    packs = spark.createDataFrame([("w", "word"), ("p", "phrase"), ("x", None)], "pack_id string, content_kind string")
    got = {(r["list_id"], r["pack_id"]): r["reason"] == "" for r in terms.admissible(lists, packs).collect()}
    assert got == {("words", "w"): True, ("words", "x"): False, ("both", "w"): True, ("both", "p"): True, ("both", "x"): False, ("any", "w"): False, ("any", "p"): False, ("any", "x"): False}
