"""``python -m prosemetrics.cli COMMAND``: the engine over files.

    lint PATHS          flags of each file            scan PATHS     verdicts and counts by kind
    decay PATHS --against DIR [--against DIR] [--calibrate]           activity, or discrimination against controls
    fix PATHS           fixed texts, as JSON          checks / rules checks of a ruleset; those that only warn
    precommit REPOSITORY     deny a commit whose staged files got worse under their rules (or BEFORE AFTER: two folders)
    init FILE           a configuration with the default rules, where there is none
    check-config [PATH] thresholds and actions of the project, or of the rule of a path
    path-packs PATHS    the packs that the rule of each path binds
    terms               term lists and their built-in layers
    packs FILE          terms of a pack               import DIR     style rules as checks, and those refused
    status LOG          events by action, top kinds   hits LOG       hits of each check, and when it fired last
    list-rulesets       rulesets and their numbers of checks
    rule-checks RULES PATH   the checks that run on one path
    add-ruleset NAME / save-checks FILE / remove-checks RULESET [CHECK]   rulesets kept as rows, in the folder --stored

With --stored the rulesets of that folder can be named like the built-in ones.
"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import config, corpus, fix, history, lint, routing, terms
from .plans import stored
from .plans.registry import built_in_terms, check_table, ruleset, term_lists
from .sources import event_log, files, git_tree, rule_import


def _files(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    found = None
    for p in paths:
        one = files.scan_tree(spark, p, glob)
        found = one if found is None else found.unionByName(one)
    return found.filter("state = 'ok'").select(F.col("path").alias("doc_id"), "text")


@dataclass
class Call:
    """A command with its arguments and what the configuration says."""

    spark: SparkSession
    args: argparse.Namespace
    given: dict
    rules: str
    routes: list[dict]
    overrides: DataFrame

    def files(self) -> DataFrame:
        return _files(self.spark, self.args.paths, self.args.glob)

    def disabled(self, name: str) -> tuple[str, ...]:
        return tuple((self.given.get("disabled_checks") or {}).get(name, ()))

    def show(self, df: DataFrame) -> None:
        """A report: what a person reads, so its rows come to the driver."""
        if self.args.json:
            for r in df.toJSON().toLocalIterator():
                print(r)
        else:
            df.show(1000, truncate=100)


def _lint(call: Call) -> int:
    def told(found: DataFrame) -> None:
        call.show(lint.display(found).orderBy("doc_id", *lint.ORDER).select("doc_id", "kind", "display", "bucket", "occurrences"))

    if call.args.ruleset:
        told(lint.merged_flags(call.files(), call.rules))
        return 0
    routed = routing.route(call.files(), call.routes, path="doc_id")
    for name in sorted({r["ruleset"] for r in call.routes if r.get("ruleset")}):
        found = lint.merged_flags(routed.filter(F.col("ruleset") == name), name, keep=("rule_ord",))
        told(routing.drop_disabled(found, call.routes, call.disabled(name)))
    return 0


def _scan(call: Call) -> int:
    docs = call.files()
    if not call.args.ruleset:
        verdicts = routing.lint_routed(docs.withColumnRenamed("doc_id", "path"), call.routes, call.overrides, call.given.get("disabled_checks"))
        call.show(routing.routed_summary(verdicts))
        failed = verdicts.filter("would_block")
        call.show(failed.orderBy("path"))
        return int(failed.limit(1).count() > 0)
    verdicts = lint.lint(docs, call.rules)
    call.show(corpus.scan_summary(verdicts))
    call.show(corpus.kind_counts_of(docs, call.rules))
    return int(verdicts.filter("would_block").limit(1).count() > 0)


def _decay(call: Call) -> int:
    a = call.args
    docs = call.files().withColumn("corpus", F.lit("measured"))
    for p in a.against:
        docs = docs.unionByName(_files(call.spark, [p], a.glob).withColumn("corpus", F.lit(p)))
    docs = docs.withColumn("doc_id", F.concat_ws(" ", "corpus", "doc_id"))
    act = corpus.activity_of(docs, call.rules, ("corpus",), disabled=call.disabled(call.rules))
    if not a.against:
        call.show(act.drop("corpus").orderBy(F.desc("hits"), "check_id"))
        return 0
    compared = corpus.compare(act.filter("corpus = 'measured'").drop("corpus"), act.filter("corpus <> 'measured'"), ("corpus",))
    call.show(compared.orderBy("check_id", "corpus"))
    call.show(corpus.consensus(compared).orderBy("verdict", "check_id"))
    if a.calibrate:
        call.show(corpus.calibrate(compared, a.headroom).orderBy("check_id"))
    return 0


def _fix(call: Call) -> int:
    """Each file by the ruleset of its rule, without the fixes of checks disabled there; other files come as they are."""
    if call.args.ruleset:
        call.show(fix.fix(call.files(), call.rules).select("doc_id", "fixed"))
        return 0
    routed = routing.route(call.files(), call.routes, path="doc_id")
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(call.routes):
        if r.get("ruleset") in ("prose", "controlled"):
            off = tuple(sorted({*call.disabled(r["ruleset"]), *(r.get("disable") or ())}))
            groups.setdefault((r["ruleset"], off), []).append(i)
    fixed = [i for some in groups.values() for i in some]
    rest = F.coalesce(~F.col("rule_ord").isin(*fixed), F.lit(True)) if fixed else F.lit(True)
    out = routed.filter(rest).select("doc_id", F.col("text").alias("fixed"))
    for (name, off), some in groups.items():
        out = out.unionByName(fix.fix(routed.filter(F.col("rule_ord").isin(*some)), name, disabled=off).select("doc_id", "fixed"))
    call.show(out)
    return 0


def _checks(call: Call) -> int:
    call.show(check_table(call.spark, call.rules).orderBy("ord"))
    return 0


def _rules(call: Call) -> int:
    call.show(routing.complement(check_table(call.spark, call.rules)).select("check_id", "kind", "unit"))
    return 0


def _check_config(call: Call) -> int:
    """A path of no rule, or of one without a ruleset, has no checks."""
    name, glob = call.rules, None
    if call.args.paths:
        one = routing.route(call.spark.createDataFrame([(call.args.paths[0],)], "path string"), call.routes).first()
        rule = call.routes[one["rule_ord"]] if one["rule_ord"] is not None else {}
        name, glob = rule.get("ruleset"), rule.get("glob")
        if name is None:
            print(f"{call.args.paths[0]}: out of scope", file=sys.stderr)
            return 0
    mine = call.disabled(name) + tuple(c for r in call.routes if glob is not None and r["glob"] == glob for c in r.get("disable") or ())
    shown = routing.effective_config(check_table(call.spark, name), call.overrides, glob)
    call.show(shown.select("ruleset", "check_id", "threshold", "action", (~F.col("check_id").isin(*mine) if mine else F.lit(True)).alias("enabled")).orderBy("check_id"))
    return 0


def _path_packs(call: Call) -> int:
    paths = call.spark.createDataFrame([(p,) for p in call.args.paths], "path string")
    call.show(config.packs_for_path(paths, call.routes).select("path", "rule_ord", "packs").orderBy("path"))
    return 0


def _precommit(call: Call) -> int:
    a, spark = call.args, call.spark
    if len(a.paths) == 1:
        forced = [{"glob": "*", "ruleset": call.rules}] if a.ruleset else call.routes
        decided = git_tree.commit_decisions(spark, a.paths[0], forced, overrides=call.overrides, disabled=call.given.get("disabled_checks"))
        # The decisions on the files of one commit, without texts. A filter in Spark would be pushed down, and the checks' expressions repeated for it.
        rows = decided.select("path", "decision", "flags", "before_weight", "after_weight", "shown").collect()
        denied = sorted((r["path"], r["flags"], r["before_weight"] or 0, r["after_weight"], r["shown"][:6]) for r in rows if r["decision"] == "deny")
        call.show(spark.createDataFrame(denied, "path string, flags int, before_weight long, after_weight long, shown array<string>"))
        return int(bool(denied))
    before, after = (
        files.scan_tree(spark, p, a.glob).filter("state = 'ok'").select(F.substring_index("path", p.rstrip("/") + "/", -1).alias("path"), "text")
        for p in a.paths[:2]
    )
    worse = lint.ratchet(files.before_after(before, after), call.rules).filter("deny")
    call.show(worse)
    return int(worse.limit(1).count() > 0)


def _init(call: Call) -> int:
    path = pathlib.Path(call.args.paths[0])
    try:
        with path.open("x") as f:  # one that is there stays
            json.dump({"rulesets": [*routing.DEFAULT_RULES], "terms": {}, "disabled_checks": {}, "check_config": {}, "custom_term_lists": {}}, f, indent=2)
    except FileExistsError:
        print(f"{path} is there already", file=sys.stderr)
        return 1
    return 0


def _terms(call: Call) -> int:
    rows = built_in_terms(call.spark)
    counts = terms.layer_counts(rows, terms.resolve(rows))
    call.show(term_lists(call.spark).join(counts, ["ruleset", "list_id"], "left").filter(F.col("ruleset") == call.rules))
    return 0


def _packs(call: Call) -> int:
    call.show(files.pack_terms(call.spark.read.text(call.args.paths)))
    return 0


def _import(call: Call) -> int:
    sources = [(p.stem, p.read_text()) for d in call.args.paths for p in sorted(pathlib.Path(d).glob("*.yml"))]
    done, refused = rule_import.import_rules(sources, call.spark)
    print(json.dumps({"imported": [c.id for c in done], "refused": dict(refused)}, indent=1))
    return 0


def _events(call: Call) -> DataFrame:
    return history.dedupe_double_fire(event_log.read_events(call.spark, call.args.paths[0]))


def _status(call: Call) -> int:
    events = _events(call)
    call.show(history.status_counts(events))
    call.show(history.top_kinds(events))
    return 0


def _hits(call: Call) -> int:
    counts = history.hit_counts(_events(call), check_table(call.spark, call.rules), call.rules)
    when = F.date_format(F.timestamp_seconds("last_fired"), "yyyy-MM-dd HH:mm:ss").alias("last_fired")
    call.show(counts.select("check_id", "hits", "gate_events", when).orderBy(F.desc("hits"), "check_id"))
    return 0


def _list_rulesets(call: Call) -> int:
    call.show(check_table(call.spark).groupBy("ruleset").agg(F.count("*").alias("checks")).orderBy("ruleset"))
    return 0


def _rule_checks(call: Call) -> int:
    call.show(routing.explain(call.spark, call.args.paths[1], json.loads(pathlib.Path(call.args.paths[0]).read_text()), check_table(call.spark)))
    return 0


def _stored_at(call: Call) -> str:
    if not call.args.stored:
        raise SystemExit("--stored must name the folder of stored rulesets")
    return call.args.stored


def _add_ruleset(call: Call) -> int:
    try:
        stored.scaffold(call.spark, _stored_at(call), call.args.paths[0])
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def _save_checks(call: Call) -> int:
    """The checks of a JSON list; those refused are shown, and the others saved."""
    names = [f.split()[0] for f in stored.SCHEMA.split(", ")]
    listed = json.loads(pathlib.Path(call.args.paths[0]).read_text())
    rows = call.spark.createDataFrame([tuple(r.get(n) for n in names) for r in listed], stored.SCHEMA)
    refused = stored.save(rows, _stored_at(call))
    call.show(refused)
    return int(not refused.isEmpty())


def _remove_checks(call: Call) -> int:
    stored.remove(call.spark, _stored_at(call), *call.args.paths[:2])
    return 0


COMMANDS = {
    "lint": _lint, "scan": _scan, "decay": _decay, "fix": _fix, "checks": _checks, "rules": _rules, "precommit": _precommit,
    "init": _init, "check-config": _check_config, "path-packs": _path_packs, "terms": _terms, "packs": _packs, "import": _import,
    "status": _status, "hits": _hits, "list-rulesets": _list_rulesets, "rule-checks": _rule_checks,
    "add-ruleset": _add_ruleset, "save-checks": _save_checks, "remove-checks": _remove_checks,
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prosemetrics", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("command", choices=tuple(COMMANDS))
    top.add_argument("paths", nargs="*")
    top.add_argument("--ruleset", help="force it on every file; else, for lint, scan and fix, a file's rule chooses")
    top.add_argument("--rules", help="JSON file of a configuration; the default rules if there is none")
    top.add_argument("--stored", help="folder of rulesets kept as rows")
    top.add_argument("--glob")
    top.add_argument("--against", action="append", default=[])
    top.add_argument("--calibrate", action="store_true")
    top.add_argument("--headroom", type=float, default=1.0)
    top.add_argument("--json", action="store_true")
    return top


def run(argv: list[str], spark: SparkSession) -> int:
    a = _parser().parse_args(argv)
    if a.stored:
        stored.install(stored.load(spark, a.stored))
    given = json.loads(pathlib.Path(a.rules).read_text()) if a.rules else {}
    routes = given.get("rulesets", [*routing.DEFAULT_RULES])
    call = Call(spark, a, given, ruleset(a.ruleset or "prose").id, routes, routing.overrides_of(spark, given))
    return COMMANDS[a.command](call)


def main() -> int:
    spark = SparkSession.builder.appName("prosemetrics").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(sys.argv[1:], spark)


if __name__ == "__main__":
    sys.exit(main())
