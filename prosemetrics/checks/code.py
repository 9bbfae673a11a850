"""The code ruleset: 10 checks over raw lines. An item is struct<line, next, following>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import all_matches, any_of, each, found, group, hit, let, one_if
from ..operators.structure import trim
from .base import Check, Ruleset

# The word lists and patterns of the code checks.
TRIVIAL_STEMS = ("Import", "Defin", "Initializ", "Setting", "Set up", "Setup", "Return", "Check", "Loop", "Iterat", "Creat", "Updat", "Delet", "Remov", "Handl", "Get", "Fetch", "Increment", "Decrement", "Writ", "Runn", "Run", "Pars", "Execut", "Extract", "Sav", "Load", "Build", "Start", "Stopp", "Stop", "Cleanup", "Clean up", "Configur", "Validat", "Process", "Queue", "Fire", "Emit", "Dispatch", "Log", "Print", "Render")
EXPLAINING = r"\b(?:because|since|note|todo|fixme|hack|warn|warning|workaround|caveat|important|assumes?|if|when|unless|until|only|except|otherwise|needs?|must|should|ensure|avoid|prevent|requires?)\b"
CROSS_REFERENCES = (r"\bwill then be\b", r"\bcalled from\b", r"\bcalled later\b", r"\bsee (?:above|below|later|earlier)\b", r"\breplaces the\b", r"\bmatches the one\b", r"\bwe moved\b", r"\bwe used to\b", r"\brefactor(?:ed)? from\b")
NARRATION_OPENERS = (r"^#\s*(?:The idea here|The trick is|This was needed|Originally,?)", r"^#\s*This\s+(?:function|method|class|module|component|hook|util|helper|handler|service)\b", r"^#\s*It\s+(?:does|handles|takes|returns|processes|reads|writes|sends|fetches|loads|creates|deletes|updates|parses|validates)\b", r"^#\s*(?:First|Then|Finally|Next|Lastly|Subsequently),?\s+(?:it|we|the\s+(?:function|method|class))\b")
PLAN_REFERENCES = (r"^#\s*(?:stage|step|phase)\s+\d+\s*[:.\-]", r"\bstep\s+\d+\s+of\s+the\s+plan\b", r"\bas\s+(?:per|requested)\s+(?:the\s+)?(?:requirements?|spec|task|ticket|prompt|instructions?)\b", r"\bper\s+the\s+(?:spec|requirements?|task|ticket|plan|prompt|instructions?)\b", r"\bfrom\s+the\s+(?:task|todo|plan|spec|ticket|prompt|requirements?)\b", r"\bas\s+(?:instructed|specified|outlined)\s+(?:above|below|in\s+the)\b")
BEFORE_AFTER = (r"\bpreviously[,:]?\s+(?:this|we|it|the)\b", r"\bused\s+to\s+(?:be|use|call|return|do|have|rely)\b", r"\bchanged\s+(?:\w+\s+){0,3}from\s+.+\bto\b", r"\bno\s+longer\s+(?:needed|used|required|necessary|calls?|returns?|does)\b", r"\bwe\s+(?:now|used\s+to)\s+(?:no\s+longer\s+)?(?:use|call|return|do|have)\b", r"\breplaced\s+the\s+(?:old|previous|former)\b", r"\b(?:was|were)\s+(?:renamed|moved|removed|refactored|extracted)\s+(?:from|to|out\s+of)\b")
WHY_OR_TODO = r"\b(?:because|since|otherwise|todo|fixme|hack|note:|reason:|workaround|see\s+(?:issue|#))\b"
IGNORED_NAMES = ("ignored", "ignore", "tolerated", "expected", "unused", "_", "_e", "_err", "_ex")
GENERIC_STEMS = ("helper", "data", "temp", "tmp", "value", "item", "obj", "thing", "foo", "bar", "result", "util")
DEF_LINE = r"^\s*(?:async\s+)?def\s+\w+\s*\("
MAIN_GUARD = r"^if\s+__name__\s*==\s*[\"']__main__[\"']\s*:"
DEFINITION = r"^\s*(?:async\s+def|def|class)\s"
LONGEST_TRIVIAL = 60


def _rule(name: str) -> str:
    return f"code.{name}"


def is_script(lines: Column) -> Column:
    """Whether the output of a file is its point: a main guard, or nothing defined. lines: array<string>."""
    return F.exists(lines, lambda x: found(x, MAIN_GUARD)) | ~F.exists(lines, lambda x: found(x, DEFINITION))


def _comment(t: Column) -> Column:
    return F.startswith(t, F.lit("#")) & ~F.startswith(t, F.lit("#!"))


def trivial_comment(item: Column, _: dict) -> Column:
    def of(t: Column) -> Column:
        def judge(body: Column) -> Column:
            plain = (F.length(body) <= LONGEST_TRIVIAL) & ~found(body, EXPLAINING, True) & ~(F.contains(body, F.lit("(")) & F.contains(body, F.lit(")")))
            plain &= ~body.rlike(r"[({=;}\]>]") & ~F.coalesce(trim(item["next"]) == "", F.lit(False))
            plain &= ~body.rlike("[─━═╌╍┄┅│┃]") & ~body.rlike("^-{3,}|^─{3,}")
            says = found(t, r"^#\s*This (?:function|method|class) (?:will |is used to )?|^#\s*(?:" + "|".join(TRIVIAL_STEMS) + r")(?:e|es|ing|s)?\b", True)
            return one_if(_comment(t) & plain & says, hit(t, _rule("trivial_comment"), note="say why, or cut it"))

        return let(trim(F.substring(t, 2, 1 << 20)), judge)

    return let(trim(item["line"]), of)


def narrative_comment(item: Column, _: dict) -> Column:
    def of(t: Column) -> Column:
        note = F.when(found(t, r"^#\s*[-=─━~_*]{6,}\s*$"), "separator").when(found(t, r"^#\s*(Phase|Step|Section|Part)\s+\d+\s*[:.\-]", True), "numbered narration")
        note = note.when(found(t, "|".join(CROSS_REFERENCES), True), "talks about other code").when(found(t, "|".join(NARRATION_OPENERS), True), "narrates the code")
        return one_if(_comment(t) & note.isNotNull(), hit(t, _rule("narrative_comment"), note=note))

    return let(trim(item["line"]), of)


def meta_comment(item: Column, _: dict) -> Column:
    def of(t: Column) -> Column:
        note = F.when(found(t, "|".join(PLAN_REFERENCES), True), "refers to the plan").when(found(t, "|".join(BEFORE_AFTER), True), "tells how the code changed")
        return one_if(_comment(t) & ~found(t, WHY_OR_TODO, True) & note.isNotNull(), hit(t, _rule("meta_comment"), note=note))

    return let(trim(item["line"]), of)


def swallowed_exception(item: Column, _: dict) -> Column:
    def of(t: Column) -> Column:
        named = F.lower(group(t, r"^except(?:\s+[\w.]+)?\s+as\s+(\w+)\s*:\s*$", 1))
        ok = found(t, r"^except(?:\s+[\w.]+)?\s*(?:as\s+\w+)?\s*:\s*$") & ~named.isin(*IGNORED_NAMES) & (item["following"] == "pass")
        return one_if(ok, hit(t, _rule("swallowed_exception"), note="log it, raise it, or name why not"))

    return let(trim(item["line"]), of)


def mutable_default_arg(item: Column, _: dict) -> Column:
    p = r"(\w+)\s*=\s*(\[\]|\{\}|set\(\))"
    both = F.zip_with(all_matches(item["line"], p, group=1), all_matches(item["line"], p, group=2), lambda a, b: F.concat(a, F.lit("="), b))
    return F.when(found(item["line"], DEF_LINE), each(both, rule=_rule("mutable_default_arg"), note="use None and create it inside")).otherwise(each(F.array().cast("array<string>"), rule=""))


def print_debug(item: Column, context: dict) -> Column:
    script = context.get("is_script", F.lit(False))
    return one_if(~script & found(item["line"], r"^\s*print\("), hit(trim(item["line"]), _rule("print_debug"), note="log it or remove it"))


def todo_stub(item: Column, _: dict) -> Column:
    p = r"#\s*(TODO|FIXME|HACK)\b[:\s]*(.*)$"
    ok = found(item["line"], p, True) & ~found(group(item["line"], p, 2, True), r"#\d+|[A-Z]{2,}-\d+|https?://", True)
    return one_if(ok, hit(trim(group(item["line"], p, 0, True)), _rule("todo_stub"), note="link an issue, or do it"))


def generic_naming(item: Column, context: dict) -> Column:
    stems = any_of((*GENERIC_STEMS, *context.get("extra", {}).get("generic_naming", ())), bounded=False)
    names = all_matches(item["line"], r"\b" + stems + r"_?\d+\b", True)
    return F.when(found(item["line"], DEF_LINE) | F.contains(item["line"], F.lit("=")), each(names, rule=_rule("generic_naming"), note="say what it is")).otherwise(each(F.array().cast("array<string>"), rule=""))


def tautological_assert(item: Column, _: dict) -> Column:
    return one_if(found(item["line"], r"^\s*assert\s+True\s*$"), hit(trim(item["line"]), _rule("tautological_assert"), note="it can't fail"))


def constant_condition(item: Column, _: dict) -> Column:
    p = r"^\s*(?:if\s+(True|False)|while\s+(False))\s*:\s*$"
    return one_if(found(item["line"], p), hit(F.concat(group(item["line"], p, 1), group(item["line"], p, 2)), _rule("constant_condition"), note="dead branch"))


def _c(find, **more) -> Check:
    return Check(find.__name__, "LINE", find, **more)


RULESET = Ruleset(
    "code",
    (
        _c(trivial_comment), _c(narrative_comment), _c(meta_comment), _c(swallowed_exception, kind="defect", action="block"), _c(mutable_default_arg, kind="defect"),
        _c(print_debug, kind="defect"), _c(todo_stub), _c(generic_naming, terms_list="generic_naming"), _c(tautological_assert, kind="defect"), _c(constant_condition, kind="defect"),
    ),
    lines="code",
    dedup=False,
)
