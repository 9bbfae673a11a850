import json

import pytest

from prosemetrics.cli import run


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"a/x.md": "It is very big.", "a/y.md": "It ran.", "b/z.md": "It is very, really big.", "c/x.md": "It is very big. It is quite so."}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_lint_scan_and_fix(spark, tree, capsys):
    assert run(["lint", f"file:{tree}/a", "--json"], spark) == 0
    assert [r["display"] for r in lines(capsys)] == ["very"]
    assert run(["scan", f"file:{tree}/a", "--ruleset", "prose", "--json"], spark) == 0
    assert lines(capsys) == [{"clean": 1, "with_notes": 1, "failed": 0, "total": 2}, {"kind": "vague_intensifier", "flags": 1}]
    (tree / "a" / "data.csv").write_text("very, very")
    (tree / "a" / "conf.json").write_text(json.dumps({"rulesets": [{"glob": "*.md", "ruleset": "prose"}, {"glob": "*", "ruleset": None}], "disabled_checks": {"prose": ["vague_intensifier"]}}))
    assert run(["scan", f"file:{tree}/a", "--json"], spark) == 0
    assert lines(capsys) == [{"scanned": 2, "out_of_scope": 2, "blank": 0, "clean": 1, "with_notes": 1, "failed": 0}]
    assert run(["scan", f"file:{tree}/a", "--rules", str(tree / "a" / "conf.json"), "--json"], spark) == 0
    assert lines(capsys) == [{"scanned": 2, "out_of_scope": 2, "blank": 0, "clean": 2, "with_notes": 0, "failed": 0}]
    for name in ("data.csv", "conf.json"):
        (tree / "a" / name).unlink()
    run(["fix", f"file:{tree}/a", "--json"], spark)
    assert {r["fixed"] for r in lines(capsys)} == {"It is very big.", "It ran."}


def test_decay_compares_with_controls(spark, tree, capsys):
    run(["decay", f"file:{tree}/a", "--json"], spark)
    assert len(lines(capsys)) == 31
    run(["decay", f"file:{tree}/a", "--against", f"file:{tree}/b", "--against", f"file:{tree}/c", "--calibrate", "--json"], spark)
    rows = lines(capsys)
    assert {r["verdict"] for r in rows if r["check_id"] == "vague_intensifier" and "controls" in r} <= {"backwards", "no signal", "disputed"}


def test_listing_commands(spark, tree, capsys):
    for command, n in (("checks", 31), ("rules", 31), ("list-rulesets", 3), ("terms", 8)):
        run([command, "--json"], spark)
        assert len(lines(capsys)) == n
    (tree / "rules.json").write_text(json.dumps([{"glob": "*.md", "ruleset": "prose", "disable": ["filler_opener"]}]))
    run(["rule-checks", str(tree / "rules.json"), "a/x.md", "--json"], spark)
    assert len(lines(capsys)) == 30


def test_precommit_denies_what_got_worse(spark, tree):
    assert run(["precommit", f"file:{tree}/a", f"file:{tree}/c"], spark) == 0  # nothing in prose blocks unless configured
    assert run(["precommit", f"file:{tree}/a", f"file:{tree}/c", "--ruleset", "controlled"], spark) in (0, 1)


def test_import(spark, tree, capsys):
    (tree / "a" / "r.yml").write_text("extends: existence\nmessage: no\ntokens:\n  - foo\n")
    run(["import", str(tree / "a")], spark)
    assert json.loads(capsys.readouterr().out)["imported"] == ["vale_r"]


def test_thresholds_and_actions_of_a_configuration(spark, tree, capsys):
    conf = tree / "conf.json"

    def scan(config):
        conf.write_text(json.dumps(config))
        done = run(["scan", f"file:{tree}/a", "--rules", str(conf), "--json"], spark)
        return done, lines(capsys)[0]["failed"]

    rule = {"glob": "*.md", "ruleset": "prose"}
    assert scan({"rulesets": [rule], "check_config": {"prose": {"vague_intensifier": {"action": "block"}}}}) == (1, 1)
    assert scan({"rulesets": [rule], "check_config": {"prose": {"vague_intensifier": {"action": "block", "threshold": 2}}}}) == (0, 0)
    assert scan({"rulesets": [rule | {"check_config": {"vague_intensifier": {"threshold": 1}}}], "check_config": {"prose": {"vague_intensifier": {"action": "block", "threshold": 2}}}}) == (1, 1)
    assert scan({"rulesets": [rule], "check_config": {"prose": {"vague_intensifier": {"action": "shout", "threshold": True}, "nothing": {"action": "block"}}, "unknown": {}}}) == (0, 0)


def test_fix_and_decay_follow_the_rules(spark, tree, capsys):
    text = "It is late. Needless to say, it is fine. Notably, it ran."
    for name in ("a/x.md", "a/n.md", "a/t.csv"):
        (tree / name).write_text(text)
    conf = tree / "conf.json"
    conf.write_text(json.dumps({"rulesets": [{"glob": "*/n.md", "ruleset": "prose", "disable": ["stock_adverb", "filler_opener"]}, {"glob": "*.md", "ruleset": "prose"}], "disabled_checks": {"prose": ["bold_density"]}}))
    run(["fix", f"file:{tree}/a", "--rules", str(conf), "--json"], spark)
    fixed = {r["doc_id"].rsplit("/", 1)[1]: r["fixed"] for r in lines(capsys)}
    assert fixed["n.md"] == fixed["t.csv"] == text and fixed["x.md"] != text and set(fixed) == {"x.md", "y.md", "n.md", "t.csv"}
    run(["decay", f"file:{tree}/a", "--rules", str(conf), "--json"], spark)
    rows = lines(capsys)
    assert len(rows) == 30 and "bold_density" not in {r["check_id"] for r in rows}


def test_init_and_listings(spark, tree, capsys):
    conf = tree / "new.json"
    assert run(["init", str(conf)], spark) == 0 and run(["init", str(conf)], spark) == 1
    made = json.loads(conf.read_text())
    made["rulesets"].insert(0, {"glob": "d/*.md", "ruleset": "prose", "packs": {"terminology": ["one", "two"]}, "check_config": {"stock_adverb": {"threshold": 3}}, "disable": ["filler_verb"]})
    made["check_config"] = {"prose": {"stock_adverb": {"threshold": 2, "action": "block"}}}
    conf.write_text(json.dumps(made))
    capsys.readouterr()
    seen = {}
    for path in ("d/x.md", "e/x.md", "e/x.bin", None):
        run(["check-config", *([path] if path else []), "--rules", str(conf), "--json"], spark)
        seen[path] = {r["check_id"]: (r["threshold"], r["action"], r["enabled"]) for r in lines(capsys)}
    assert seen["d/x.md"]["stock_adverb"] == (3, "block", True) and seen["d/x.md"]["filler_verb"][2] is False
    assert seen["e/x.md"]["stock_adverb"] == seen[None]["stock_adverb"] == (2, "block", True) and seen["e/x.bin"] == {}
    run(["path-packs", "d/x.md", "e/x.md", "--rules", str(conf), "--json"], spark)
    assert [r["packs"] for r in lines(capsys)] == [["one", "two"], []]


def test_hits_of_a_log(spark, tree, capsys):
    log = tree / "log.jsonl"
    log.write_text("\n".join(json.dumps({"ts": 100.0 * i, "action": "deny", "ruleset": "prose", "file": f"f{i}.md", "kinds": ["filler_verb"]}) for i in range(1, 4)))
    run(["hits", str(log), "--json"], spark)
    rows = lines(capsys)
    assert len(rows) == 31 and (rows[0]["check_id"], rows[0]["hits"], rows[0]["last_fired"]) == ("filler_verb", 3, "1970-01-01 00:05:00")
    assert {r["gate_events"] for r in rows} == {3}


def test_stored_rulesets_on_the_command_line(spark, tree, capsys):
    from prosemetrics.plans import registry

    where, checks = str(tree / "stored"), tree / "checks.json"
    try:
        assert run(["add-ruleset", "house", "--stored", where], spark) == 0
        assert run(["add-ruleset", "house", "--stored", where], spark) == 1
        row = {"ruleset": "house", "check_id": "bigness", "unit": "SENTENCE", "finder": "words", "terms": ["big"], "action": "block"}
        checks.write_text(json.dumps([row, row | {"check_id": "bad", "finder": "pattern", "pattern": "("}]))
        assert run(["save-checks", str(checks), "--stored", where, "--json"], spark) == 1
        assert [r["check_id"] for r in lines(capsys)] == ["bad"]
        assert run(["scan", f"file:{tree}/a", "--stored", where, "--ruleset", "house", "--json"], spark) == 1
        assert lines(capsys)[0] == {"clean": 1, "with_notes": 0, "failed": 1, "total": 2}
        assert run(["remove-checks", "house", "bigness", "--stored", where], spark) == 0
        assert run(["scan", f"file:{tree}/a", "--stored", where, "--ruleset", "house", "--json"], spark) == 0
    finally:
        if "house" in registry.rulesets():
            registry.unregister("house")


def test_setting_one_field_of_a_check(spark):
    from prosemetrics.operators import routing
    from prosemetrics.plans.registry import check_table

    checks = check_table(spark, "prose")
    out = spark.createDataFrame([], "check_id string, glob string, field string, value string")
    for value, glob in ((3, None), (5, "*.md"), (4, None)):
        out = routing.set_override(out, checks, "stock_adverb", "threshold", value, glob)
    out = routing.set_override(out, checks, "stock_adverb", "action", "block", "*.md")
    of = lambda glob: routing.effective_config(checks, out, glob).filter("check_id = 'stock_adverb'").first()
    assert (of(None)["threshold"], of("*.md")["threshold"], of("*.md")["action"], of(None)["action"]) == (4, 5, "block", "warn")
    out = routing.set_override(out, checks, "stock_adverb", "threshold", None, "*.md")
    assert of("*.md")["threshold"] == 4
    for check, field, value in (("nothing", "threshold", 2), ("stock_adverb", "colour", 2), ("stock_adverb", "threshold", 0), ("stock_adverb", "threshold", True), ("stock_adverb", "action", "shout")):
        with pytest.raises(ValueError):
            routing.set_override(out, checks, check, field, value)
