"""Documents to flags, and flags to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import code
from ..checks.base import UNITS, Check, Ruleset
from ..functions.patterns import HIT, folded, heard, is_heard, let
from ..plans.registry import check_table, ruleset
from .structure import code_lines, with_units
from .vocabulary import ready, resolved

ORDER = ("unit_rank", "item_ord", "check_ord", "hit_ord")
_FLAG = f"struct<unit_rank:int,item_ord:int,check_ord:int,hit_ord:int,kind:string,mechanical:boolean,text:string,hit:{HIT}>"


def _flags_of(check: Check, ord_: int, item: Column, at: Column, shown: Column, context: dict) -> Column:
    rank = UNITS.index(check.unit)

    def flag(h: Column, j: Column) -> Column:
        return F.struct(F.lit(rank).alias("unit_rank"), at.cast("int").alias("item_ord"), F.lit(ord_).alias("check_ord"), j.cast("int").alias("hit_ord"), F.lit(check.id).alias("kind"), check.mechanical(h).alias("mechanical"), F.coalesce(h["text"], shown).alias("text"), h.alias("hit"))

    return F.transform(check.find(item, context), flag)


def _over(items: Column, checks: list[tuple[int, Check]], context: dict, at: dict[int, Column], item=lambda x: x, shown=lambda x: x, more=lambda x: {}) -> Column:
    """Flags of all checks over all items, in order: a pass a check, and none for a check that ``at`` tells can't hit."""
    kind = f"array<{_FLAG}>"

    def one(k: int, c: Check) -> Column:
        found = F.flatten(F.transform(items, lambda x, i: _flags_of(c, k, item(x), i, shown(x), context | more(x)))).cast(kind)
        return F.when(at[k], found).otherwise(F.array().cast(kind)) if k in at else found

    some = [one(k, c) for k, c in checks]
    return some[0] if len(some) == 1 else F.sort_array(F.concat(*some))


def _tested(said: Column, checks: list[tuple[int, Check]], context: dict, use) -> Column:
    """``use(at)``; at: by check, whether its cheap test of ``said``, the folded text of all items, passes. Checks without one are not in it.

    The literals of all checks that begin words are looked for in one pass. Text and tests
    are bound by ``let``: computed once a document, not once an item. ``said`` does not begin with a letter.
    """
    checks = [(k, c) for k, c in checks if c.likely is not None]
    literals = {k: c.likely.literals(context) for k, c in checks if hasattr(c.likely, "literals")}
    together = {k: v for k, v in literals.items() if v and all(x[0].isalpha() for x in v)}
    every = sorted({x for v in together.values() for x in v}) if len(together) > 1 else []

    def tests(t: Column) -> Column:
        def bound(found: Column | None) -> Column:
            conditions = {k: is_heard(found, together[k], every) if every and k in together else c.likely(t, context) for k, c in checks}
            conditions = {k: v for k, v in conditions.items() if v is not None}
            return let(F.array(*conditions.values()), lambda live: use({k: F.get(live, F.lit(n)) for n, k in enumerate(conditions)})) if conditions else use({})

        return let(heard(t, every), bound) if every else bound(None)

    return let(said, tests) if checks else use({})


def flag_arrays(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, *, key: str = "doc_id", text: str = "text", disabled=(), register: str = "procedure", keep: tuple = (), counted: bool = False) -> DataFrame:
    """``keep`` columns, key and ``found``: the array of a document's flags, not merged, in order.

    A projection: no shuffle. Checks in ``disabled`` are never built. context: ``extra``
    (terms by check), ``lexicon``, ``limits``, ``dictionary`` (with ``project`` and
    ``suppressed``; a large one costs joins of words, see ``operators.vocabulary``). register: whether a sentence that is no
    numbered step counts as procedure (the default) or as description. Null text counts
    as empty. counted: for who only counts merged flags. They bear no text: each would bear
    a copy of its item's, so for an item of many flags these grow with its square. Of checks
    that give their labels there are no flags but ``labelled``, array<struct<kind, n>>.
    """
    rules, context = ruleset(rules), dict(context or {})
    live = [(i, c) for i, c in enumerate(rules.checks) if c.id not in set(disabled)]
    apart = [c for _, c in live if counted and c.labels and c.unit == "SENTENCE" and rules.dedup and rules.lines != "code" and c.id not in rules.keep_apart]
    if any(c.id == "vocabulary" for _, c in live):
        docs, context = resolved(docs, context, key, text)
    kept = [c for c in dict.fromkeys((key, *keep))]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"), *context.get("columns", ()))
    if rules.lines == "code":
        base = base.withColumn("is_script", code.is_script(F.split("text", "\n", -1))).withColumn("lines", code_lines(F.col("text")))
        context["is_script"] = F.col("is_script")
    else:
        base = with_units(base)
    # The same checks over the same units are one expression, however many texts of a row they judge.
    live = [(i, c) for i, c in live if c not in apart]
    built, name = context.get("built", {}), (rules.id, register, counted, tuple(c.id for _, c in live))
    if name not in built:
        built[name] = _found(rules, live, register, context, not counted)
    if not counted:
        return base.select("kept.*", built[name].alias("found"))
    plain = F.transform("sentences", lambda x: x["sentence"]) if apart else None
    sizes = [F.struct(F.lit(c.id).alias("kind"), F.size(c.labels(plain, context)).cast("long").alias("n")) for c in apart]
    return base.select("kept.*", built[name].alias("found"), F.array(*sizes).cast("array<struct<kind:string,n:bigint>>").alias("labelled"))


def _found(rules: Ruleset, live: list[tuple[int, Check]], register: str, context: dict, texts: bool) -> Column:
    """The flags of a row that has its units."""
    of = lambda *units: [(i, c) for i, c in live if c.unit in units]
    nothing = lambda x: F.lit(None).cast("string")
    shown = (lambda get: get) if texts else (lambda get: nothing)
    if rules.lines == "code":
        parts = [_over(F.col("lines"), of("LINE"), context, {}, shown=shown(lambda x: x["line"]))] if of("LINE") else []
    else:
        procedure = lambda x: {"procedure": F.lit(True) if register == "procedure" else x["numbered"]}
        bodies = F.transform(F.filter("blocks", lambda b: b["kind"] != "header"), lambda b: b["content"])
        plain = F.transform("sentences", lambda x: x["sentence"])
        seen = F.col("text") if rules.whole == "raw" else F.array_join(plain, " ")

        def spoken(at: dict) -> Column:
            sentence = lambda x: x["sentence"]
            some = [_over(F.col("sentences"), of("SENTENCE"), context, at, sentence, shown(sentence), procedure)] if of("SENTENCE") else []
            return F.concat(*some, *([_over(F.array(plain), of("SENTENCES"), context, at, shown=nothing)] if of("SENTENCES") else []))

        parts = [_over(items, of(unit), context, {}, shown=shown(lambda x: x)) for unit, items in (("BLOCK", bodies), ("LINE", F.col("list_lines"))) if of(unit)]
        if of("SENTENCE", "SENTENCES"):
            said = folded(F.concat(F.lit("\n"), F.array_join(plain, "\n")))  # each sentence begins a line
            parts.append(_tested(said, of("SENTENCE", "SENTENCES"), context, spoken))
        if of("DOCUMENT"):
            parts.append(_tested(folded(seen), of("DOCUMENT"), context, lambda at: _over(F.array(seen), of("DOCUMENT"), context, at, shown=nothing)))
    return F.concat(*parts) if parts else F.array().cast(f"array<{_FLAG}>")


def _rows(docs: DataFrame, f: str, keys: list[str], occurrences: Column) -> DataFrame:
    bucket = F.when(F.col(f"{f}.mechanical"), "mechanical").otherwise("semantic").alias("bucket")
    names = ("label", "rule", "type", "auto_fix", "replacement", "note")
    return docs.select(*keys, *[F.col(f"{f}.{c}").alias(c) for c in ORDER], F.col(f"{f}.kind").alias("kind"), F.col(f"{f}.text").alias("text"), bucket, *[F.col(f"{f}.hit.{c}").alias(c) for c in names], occurrences.alias("occurrences"))


def _exploded(arrays: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    """A row an element. By an outer explode: the other one gets a filter on the array, which would be computed again for it."""
    return arrays.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def flags(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, *, key: str = "doc_id", **options) -> DataFrame:
    """One row a flag, not merged: key, the four ordinals, kind, label, text, bucket and the hit's details.

    ``flag_arrays`` and one explode: no shuffle.
    """
    keys = [*dict.fromkeys((key, *options.get("keep", ())))]
    out = _exploded(flag_arrays(docs, rules, context, key=key, **options), keys, F.col("found"), "f")
    return _rows(out, "f", keys, F.col("f.hit.occurrences"))


def _group(f: Column, rules: Ruleset) -> Column:
    """What flags that merge have in common."""
    label = F.coalesce(f["hit"]["label"], F.lit(""))
    single = (label == "") | f["kind"].isin(*rules.keep_apart) if rules.keep_apart else label == ""
    group = F.when(single, F.concat(F.lit("#"), F.concat_ws("/", *[f[c] for c in ORDER]))).otherwise(F.concat(F.lit("="), F.lower(label)))
    return F.concat_ws("\x1f", f["mechanical"].cast("string"), f["kind"], group)


def merged_kinds(found: Column, rules: str | Ruleset = "prose") -> Column:
    """The kind of each flag that :func:`merged_array` leaves, without the flags and the sort they need."""
    rules = ruleset(rules)
    if not rules.dedup:
        return F.transform(found, lambda f: f["kind"])
    return F.transform(F.array_distinct(F.transform(found, lambda f: _group(f, rules))), lambda g: F.element_at(F.split(g, "\x1f", 3), 2))


def merged_array(found: Column, rules: str | Ruleset = "prose") -> Column:
    """array<struct<flag, occurrences>>: a document's flags as :func:`dedup` leaves them, merged inside the row."""
    rules = ruleset(rules)
    whole = lambda f, n: F.struct(f.alias("flag"), n.alias("occurrences"))
    if not rules.dedup:
        return F.transform(found, lambda f: whole(f, f["hit"]["occurrences"]))

    def keyed(f: Column) -> Column:
        return F.struct(_group(f, rules).alias("group"), *[f[c].alias(c) for c in ORDER], f.alias("flag"))

    def grouped(rows: Column) -> Column:
        """rows are sorted by group; each run becomes its first row, with how many rows it has."""
        new = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i)["group"] != F.get(rows, i - 1)["group"]))

        def runs(starts: Column) -> Column:
            def one(i: Column, j: Column) -> Column:
                n = F.coalesce(F.get(starts, j + 1), F.size(rows)) - i
                first = F.get(rows, i)["flag"]
                return whole(first, F.when(n > 1, n).otherwise(first["hit"]["occurrences"]))

            return F.transform(starts, one)

        return F.when(F.size(rows) > 0, let(new, runs)).otherwise(F.array().cast(f"array<struct<flag:{_FLAG},occurrences:int>>"))

    return let(F.sort_array(F.transform(found, keyed)), grouped)


def merged_flags(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, *, key: str = "doc_id", **options) -> DataFrame:
    """``dedup(flags(docs))`` without a shuffle: flags are merged in their document's row."""
    keys = [*dict.fromkeys((key, *options.get("keep", ())))]
    arrays = flag_arrays(docs, rules, context, key=key, **options)
    out = _exploded(arrays, keys, merged_array(F.col("found"), rules), "m")
    return _rows(out, "m.flag", keys, F.col("m.occurrences"))


def limits_of(config: DataFrame) -> dict[str, tuple[int, str]]:
    """Threshold and action by check: as many as are declared, so the driver may hold them."""
    return {r["check_id"]: (r["threshold"], r["action"]) for r in config.select("check_id", "threshold", "action").collect()}


def gates(merged: Column, limits: dict[str, tuple[int, str]], scope: Column | None = None) -> Column:
    """array<struct<kind, weight, threshold, action, triggered, blocks>> of a document's semantic flags, by kind.

    limits: by check, or by scope and check (``scope/check``) where ``scope`` is given. A
    check that they do not know counts as (1, warn).
    """
    thresholds, actions = ({k: v[i] for k, v in limits.items()} for i in (0, 1))
    table = lambda d, kind: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map().cast(f"map<string,{kind}>")
    name = lambda k: F.concat(scope.cast("string"), F.lit("/"), k) if scope is not None else k
    semantic = F.filter(merged, lambda m: ~m["flag"]["mechanical"])

    def of(flags_: Column) -> Column:
        def one(k: Column) -> Column:
            mine = F.filter(flags_, lambda m: m["flag"]["kind"] == k)
            weight = F.aggregate(mine, F.lit(0).cast("long"), lambda a, m: a + F.coalesce(m["occurrences"], F.lit(1)))
            least = F.coalesce(F.try_element_at(table(thresholds, "int"), name(k)), F.lit(1))
            action = F.coalesce(F.try_element_at(table(actions, "string"), name(k)), F.lit("warn"))
            return F.struct(k.alias("kind"), weight.alias("weight"), least.alias("threshold"), action.alias("action"))

        full = lambda g: F.struct(g["kind"].alias("kind"), g["weight"].alias("weight"), g["threshold"].alias("threshold"), g["action"].alias("action"), (g["weight"] >= g["threshold"]).alias("triggered"), ((g["weight"] >= g["threshold"]) & (g["action"] == "block")).alias("blocks"))
        return F.transform(F.transform(F.array_sort(F.array_distinct(F.transform(flags_, lambda m: m["flag"]["kind"]))), one), full)

    return let(semantic, of)


def judged(arrays: DataFrame, rules: str | Ruleset, limits: dict[str, tuple[int, str]], scope: Column | None = None) -> DataFrame:
    """``arrays`` (with ``found``) with gates, semantic, mechanical, would_block and status: all inside the row."""
    out = arrays.withColumn("merged", merged_array(F.col("found"), rules)).drop("found")
    out = out.withColumns({"gates": gates(F.col("merged"), limits, scope), "mechanical": F.size(F.filter("merged", lambda m: m["flag"]["mechanical"])).cast("long")})
    out = out.withColumn("semantic", F.size("merged").cast("long") - F.col("mechanical")).withColumn("would_block", F.exists("gates", lambda g: g["blocks"]))
    status = F.when(F.col("semantic") > 0, "semantic_flags").when(F.col("mechanical") > 0, "mechanical_violations").otherwise("clean")
    return out.withColumn("status", status).drop("merged")


def _limits(docs: DataFrame, rules, config: DataFrame | None) -> dict:
    if config is not None:
        return limits_of(config)
    return {c.id: (c.threshold, c.action) for c in ruleset(rules).checks}


def gate_documents(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, config: DataFrame | None = None, *, key: str = "doc_id", **options) -> DataFrame:
    """``gate(dedup(flags(docs)))`` without a shuffle: key, kind, weight, threshold, action, triggered, blocks."""
    out = judged(flag_arrays(docs, rules, context, key=key, **options), rules, _limits(docs, rules, config))
    return _exploded(out, [key], F.col("gates"), "g").select(key, "g.*")


def dedup(found: DataFrame, rules: str | Ruleset = "prose", *, key: str = "doc_id") -> DataFrame:
    """Flags of one document, bucket and kind whose labels differ in case only become the first of them.

    occurrences: of a group of several, how many; else as before. Flags without a label,
    and kinds that the ruleset keeps apart, stay single.
    """
    rules = ruleset(rules)
    if not rules.dedup:
        return found
    single = (F.coalesce("label", F.lit("")) == "") | F.col("kind").isin(*rules.keep_apart) if rules.keep_apart else F.coalesce("label", F.lit("")) == ""
    group = F.when(single, F.concat_ws("/", *ORDER)).otherwise(F.lower("label"))
    rest = [c for c in found.columns if c not in (key, "bucket", "kind", *ORDER)]
    first = F.min_by(F.struct(*ORDER, *rest), F.struct(*ORDER))
    out = found.groupBy(key, "bucket", "kind", single.alias("single"), group.alias("group")).agg(first.alias("first"), F.count("*").cast("int").alias("n"))
    occurrences = F.when(F.col("n") > 1, F.col("n")).otherwise(F.col("first.occurrences"))
    return out.select(key, *[F.col(f"first.{c}").alias(c) for c in ORDER], "kind", "bucket", *[(occurrences if c == "occurrences" else F.col(f"first.{c}")).alias(c) for c in rest])


def weights(merged: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, kind, weight: occurrences of the semantic flags."""
    return merged.filter("bucket = 'semantic'").groupBy(key, "kind").agg(F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("weight"))


def gate(merged: DataFrame, config: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """key, kind, weight, threshold, action, triggered, blocks. config: check_id, threshold, action.

    A check that the config does not know counts as (1, warn).
    """
    c = config.select(F.col("check_id").alias("kind"), "threshold", "action")
    out = weights(merged, key=key).join(F.broadcast(c), "kind", "left")  # one row a check
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(1))).withColumn("action", F.coalesce("action", F.lit("warn")))
    triggered = F.col("weight") >= F.col("threshold")
    return out.select(key, "kind", "weight", "threshold", "action", triggered.alias("triggered"), (triggered & (F.col("action") == "block")).alias("blocks"))


def verdicts(docs: DataFrame, merged: DataFrame, config: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row a document: key, status (clean, mechanical_violations, semantic_flags), semantic, mechanical, would_block."""
    counts = merged.groupBy(key).agg(F.count_if(F.col("bucket") == "semantic").alias("semantic"), F.count_if(F.col("bucket") == "mechanical").alias("mechanical"))
    blocked = gate(merged, config, key=key).groupBy(key).agg(F.max("blocks").alias("would_block"))
    out = docs.select(key).join(counts, key, "left").join(blocked, key, "left").fillna(0, ["semantic", "mechanical"]).fillna(False, ["would_block"])
    status = F.when(F.col("semantic") > 0, "semantic_flags").when(F.col("mechanical") > 0, "mechanical_violations").otherwise("clean")
    return out.select(key, status.alias("status"), "semantic", "mechanical", "would_block")


def lint(docs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, config: DataFrame | None = None, *, key: str = "doc_id", **options) -> DataFrame:
    """One row a document, as ``verdicts``: key, status, semantic, mechanical, would_block. One projection, no shuffle."""
    out = judged(flag_arrays(docs, rules, context, key=key, **options), rules, _limits(docs, rules, config))
    return out.select(key, *[c for c in options.get("keep", ()) if c != key], "status", "semantic", "mechanical", "would_block")


def ratchet(pairs: DataFrame, rules: str | Ruleset = "prose", context: dict | None = None, config: DataFrame | None = None, *, key: str = "path") -> DataFrame:
    """key, before_weight, after_weight, deny. pairs: key, before (nullable), after.

    Denied if the text after has blocking flags and either there was nothing before or
    the weight of the blocking flags grew. Both texts are judged in the row of their pair.
    """
    limits, out, context = _limits(pairs, rules, config), pairs.select(key, "before", "after"), ready(context)
    weight = F.aggregate(F.filter("gates", lambda g: g["blocks"]), F.lit(0).cast("long"), lambda a, g: a + g["weight"])
    for side in ("before", "after"):
        left = [c for c in out.columns if c != key]
        out = judged(flag_arrays(out, rules, context, key=key, text=side, keep=tuple(left)), rules, limits).select(key, *left, weight.alias(f"{side}_weight"))
    empty = F.coalesce(F.trim("before"), F.lit("")) == ""
    return out.select(key, "before_weight", "after_weight", ((F.col("after_weight") > 0) & (empty | (F.col("after_weight") > F.col("before_weight")))).alias("deny"))


def display(found: DataFrame) -> DataFrame:
    """``found`` with display: label, else 80 characters of the text, else the terms or note, else the kind."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return found.withColumn("display", F.coalesce(blank("label"), F.nullif(F.substring("text", 1, 80), F.lit("")), F.nullif(F.substring("note", 1, 80), F.lit("")), F.col("kind")))


def top_flags(found: DataFrame, k: int = 8, *, key: str = "doc_id") -> DataFrame:
    """The first k flags of each document, in order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*ORDER))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k)
