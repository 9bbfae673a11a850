"""The vocabulary check: words against a dictionary, inside the row or by joins.

A dictionary of at most ``COMPILED`` rows becomes part of the plan: sets of words that each
token is looked up in, so all drivers of lint judge vocabulary in the row, without an
exchange. A larger one judges the distinct words of the corpus once, by a join, and each
document gets the verdicts on its own words as an array, in which its tokens are looked up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks.controlled import IRREGULAR_BASES, MODALS
from ..functions.patterns import let, lookup
from .structure import with_units, words

#: Dictionaries of this many rows or fewer are broadcast; larger ones are joined by a shuffle.
SMALL = 50_000
#: Dictionaries of this many rows or fewer become part of the plan.
COMPILED = 5_000
#: Into how many keys a word that many documents hold is dealt.
SALTS = 16
VERDICT = "struct<type:string,replacement:string>"
NO_WORDS, WORDS_OF = "word string, status string", "array<struct<word:string,type:string,replacement:string>>"


def base_candidates(word: Column) -> Column:
    """Possible base forms of a word, the likeliest first: irregular, then by suffix."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    stem = cut(2)
    doubled = (n - 2 > 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1)) & ~F.substring(stem, -1, 1).isin(*"aeiou")
    ends = lambda s: F.endswith(word, F.lit(s))
    some = (
        lookup(IRREGULAR_BASES, word), F.when(ends("ies") & (n > 4), F.concat(cut(3), F.lit("y"))), F.when(ends("es") & (n > 3), cut(2)), F.when(ends("s") & (n > 2), cut(1)),
        F.when(ends("ied") & (n > 4), F.concat(cut(3), F.lit("y"))), F.when(ends("ed") & (n > 3), stem), F.when(ends("ed") & (n > 3), F.concat(stem, F.lit("e"))), F.when(ends("ed") & (n > 3) & doubled, cut(3)),
    )
    return F.array_compact(F.array(*some))


def _joined(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """A join that broadcasts ``right`` only if it has at most ``SMALL`` rows."""
    return left.join(F.broadcast(right) if right.limit(SMALL + 1).count() <= SMALL else right, on, how)


def vocabulary_flags(docs: DataFrame, dictionary: DataFrame, project: DataFrame | None = None, suppressed: DataFrame | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_ord, hit_ord, kind, label, text, type, rule, replacement, auto_fix, bucket: words that the dictionary does not allow.

    dictionary: word, status (approved or unapproved), replacement (null: none given).
    project: word, allowed besides. suppressed: word, status, as if not in the dictionary.
    """
    spark = docs.sparkSession
    nothing = spark.createDataFrame([], "word string, status string")
    sup = suppressed if suppressed is not None else nothing
    known = dictionary.groupBy("word").agg(F.max(F.col("status") == "approved").alias("approved"), F.max(F.col("status") == "unapproved").alias("unapproved"), F.max("replacement").alias("replacement"))
    off = sup.groupBy("word").agg(F.max(F.col("status") == "approved").alias("no_approval"), F.max(F.col("status") == "unapproved").alias("no_ban"))
    known = known.join(off, "word", "full").select("word", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("approved", "unapproved", "no_approval", "no_ban")], "replacement")
    tokens = with_units(docs.select(key, text), text).select(key, F.posexplode("sentences").alias("item_ord", "s"))
    tokens = tokens.select(key, "item_ord", F.col("s.sentence").alias("text"), F.posexplode(words(F.col("s.sentence"))).alias("hit_ord", "label"))
    tokens = tokens.withColumn("word", F.regexp_replace(F.lower("label"), "^'+|'+$", "")).filter((F.col("word") != "") & ~F.col("word").isin(*MODALS))
    if project is not None:
        tokens = _joined(tokens, project.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    tokens = _joined(tokens, known, "word", "left").fillna(False, ["approved", "unapproved", "no_approval", "no_ban"])
    tokens = tokens.filter(~(F.col("approved") & ~F.col("no_approval")) & ~F.col("no_ban"))
    listed = tokens.filter("unapproved").select(key, "item_ord", "hit_ord", "label", "text", "replacement", F.when(F.col("replacement").isNull(), "unapproved_no_replacement").otherwise("unapproved_synonym").alias("type"))
    other = tokens.filter("not unapproved").select(key, "item_ord", "hit_ord", "label", "text", "word")
    tries = other.select("word").distinct().select(F.col("word").alias("inflected"), F.posexplode(base_candidates(F.col("word"))).alias("nth", "word"))
    bases = dictionary.groupBy("word").agg(F.max(F.col("status") == "approved").alias("approved"), F.max("replacement").alias("replacement"))
    tries = _joined(tries, bases, "word", "inner").groupBy(F.col("inflected").alias("word")).agg(F.min_by(F.struct("approved", "replacement"), "nth").alias("base"))
    other = other.join(tries, "word", "left").filter(~F.coalesce(F.col("base.approved"), F.lit(False)))
    other = other.select(key, "item_ord", "hit_ord", "label", "text", F.col("base.replacement").alias("replacement"), F.when(F.col("base").isNull(), "unknown_vocabulary").otherwise("unapproved_synonym").alias("type"))
    out = listed.unionByName(other).withColumn("rule", F.when(F.col("type") == "unknown_vocabulary", "1.5").otherwise("1.1"))
    return out.withColumns({"kind": F.lit("vocabulary"), "auto_fix": F.lit(False), "bucket": F.lit("semantic")})


@dataclass(frozen=True)
class Lexicon:
    """A dictionary small enough for a plan. allowed: words that pass; approved and unapproved: as listed; replacement: by word."""

    allowed: tuple[str, ...]
    approved: tuple[str, ...]
    unapproved: tuple[str, ...]
    replacement: dict[str, str]

    def verdict(self, word: Column) -> Column:
        """Of a word in lower case: null if it is allowed, else its type and what to say instead."""
        none = F.lit(None).cast(VERDICT)
        of = lambda kind, w: F.struct(F.lit(kind).alias("type"), self._instead(w).alias("replacement"))
        among = lambda w, some: w.isin(*some) if some else F.lit(False)
        listed = F.when(self._instead(word).isNull(), of("unapproved_no_replacement", word)).otherwise(of("unapproved_synonym", word))

        def by_base(base: Column) -> Column:
            inflected = F.when(among(base, self.approved), none).otherwise(of("unapproved_synonym", base))
            return F.when(base.isNull(), of("unknown_vocabulary", F.lit(""))).otherwise(inflected)

        known = F.filter(base_candidates(word), lambda c: among(c, (*self.approved, *self.unapproved)))
        # A base form is irregular, or it begins as the word does and the word ends in s or ed: most words need no candidates.
        regular = (F.endswith(word, F.lit("s")) | F.endswith(word, F.lit("ed"))) & among(F.substring(word, 1, 2), sorted({w[:2] for w in (*self.approved, *self.unapproved)}))
        unlisted = F.when(regular | word.isin(*IRREGULAR_BASES), let(F.get(known, F.lit(0)), by_base)).otherwise(of("unknown_vocabulary", F.lit("")))
        out = F.when((word == "") | among(word, self.allowed), none).when(among(word, self.unapproved), listed)
        return out.otherwise(unlisted).cast(VERDICT)

    def _instead(self, word: Column) -> Column:
        return lookup(self.replacement, word) if self.replacement else F.lit(None).cast("string")


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], NO_WORDS)


def compiled(dictionary: DataFrame, project: DataFrame | None = None, suppressed: DataFrame | None = None) -> Lexicon | None:
    """The dictionary as a :class:`Lexicon`; None if it, the project's terms and the suppressed ones have too many rows."""
    tables = (dictionary, project if project is not None else _nothing(dictionary), suppressed if suppressed is not None else _nothing(dictionary))
    rows = [t.limit(COMPILED + 1).collect() for t in tables]
    if sum(map(len, rows)) > COMPILED:
        return None
    words_, terms, off = rows
    status = lambda some, s: {r["word"] for r in some if r["status"] == s}
    approved, unapproved = status(words_, "approved"), status(words_, "unapproved")
    allowed = {r["word"].lower() for r in terms} | set(MODALS) | (approved - status(off, "approved")) | status(off, "unapproved")
    instead: dict[str, str] = {}
    for r in words_:
        if r["replacement"] is not None:
            instead[r["word"]] = max(r["replacement"], instead.get(r["word"], ""))
    return Lexicon(tuple(sorted(allowed)), tuple(sorted(approved)), tuple(sorted(unapproved)), instead)


def bare(word: Column) -> Column:
    """A token as it is looked up: lower case, without the marks at its ends."""
    return F.regexp_replace(F.lower(word), "^'+|'+$", "")


def word_verdicts(some: DataFrame, dictionary: DataFrame, project: DataFrame | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """word, type, replacement of those of ``some`` (word, distinct) that the dictionary does not allow, by joins of words alone."""
    off = suppressed if suppressed is not None else _nothing(dictionary)
    at = lambda s: F.max(F.col("status") == s)
    known = dictionary.groupBy("word").agg(at("approved").alias("approved"), at("unapproved").alias("unapproved"), F.max("replacement").alias("replacement"))
    off = off.groupBy("word").agg(at("approved").alias("no_approval"), at("unapproved").alias("no_ban"))
    marks = ("approved", "unapproved", "no_approval", "no_ban")
    out = some.filter((F.col("word") != "") & ~F.col("word").isin(*MODALS))
    if project is not None:
        out = out.join(project.select(F.lower("word").alias("word")).distinct(), "word", "left_anti")
    out = out.join(known, "word", "left").join(off, "word", "left").fillna(False, [*marks])
    out = out.filter(~(F.col("approved") & ~F.col("no_approval")) & ~F.col("no_ban"))
    tries = out.filter("not unapproved").select(F.col("word").alias("inflected"), F.posexplode(base_candidates(F.col("word"))).alias("nth", "word"))
    base = F.min_by(F.struct("approved", "replacement"), "nth").alias("base")
    tries = tries.join(known.select("word", "approved", "replacement"), "word").groupBy(F.col("inflected").alias("word")).agg(base)
    out = out.join(tries, "word", "left").filter(~F.coalesce(F.col("base.approved"), F.lit(False)) | F.col("unapproved"))
    listed = F.when(F.col("replacement").isNull(), "unapproved_no_replacement").otherwise("unapproved_synonym")
    kind = F.when(F.col("unapproved"), listed).when(F.col("base").isNull(), "unknown_vocabulary").otherwise("unapproved_synonym")
    instead = F.when(F.col("unapproved"), F.col("replacement")).otherwise(F.col("base.replacement"))
    return out.select("word", kind.alias("type"), instead.alias("replacement"))


def encoded(docs: DataFrame, dictionary: DataFrame, project: DataFrame | None, suppressed: DataFrame | None, key: str, text: str) -> DataFrame:
    """``docs`` with ``_vocabulary``: the verdicts on a document's own words. Each distinct word of the corpus is judged once."""
    tokens = F.array_distinct(F.transform(words(F.coalesce(F.col(text), F.lit(""))), bare))
    held = docs.select(F.col(key).alias("_of"), F.explode(tokens).alias("word")).distinct()
    judged = word_verdicts(held.select("word").distinct(), dictionary, project, suppressed)
    # A word that stands in most documents is dealt to several keys.
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = held.withColumn("salt", F.pmod(F.xxhash64("_of"), F.lit(SALTS)).cast("int"))
    per = held.join(judged, ["word", "salt"]).groupBy("_of").agg(F.collect_list(F.struct("word", "type", "replacement")).alias("_vocabulary"))
    out = docs.join(per, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")
    return out.withColumn("_vocabulary", F.coalesce("_vocabulary", F.array().cast(WORDS_OF)))


def ready(context: dict | None) -> dict:
    """``context``, where a small ``dictionary`` (with ``project`` and ``suppressed``) is compiled once, as ``vocabulary``."""
    context = dict(context or {})
    if "dictionary" in context and "vocabulary" not in context:
        lexicon = compiled(context["dictionary"], context.get("project"), context.get("suppressed"))
        if lexicon is not None:
            context["vocabulary"] = lexicon.verdict
    return context


def resolved(docs: DataFrame, context: dict | None, key: str, text: str) -> tuple[DataFrame, dict]:
    """``docs`` and ``context`` with ``vocabulary``, the verdict on a word, if a ``dictionary`` is given; ``columns``: what it reads."""
    context = ready(context)
    if "dictionary" in context and "vocabulary" not in context:
        docs = encoded(docs, context["dictionary"], context.get("project"), context.get("suppressed"), key, text)
        context["columns"] = ("_vocabulary",)
        context["vocabulary"] = _of_row
    return docs, context


def _of_row(word: Column) -> Column:
    mine: Callable[[Column], Column] = lambda v: v["word"] == word
    found = F.get(F.filter("_vocabulary", mine), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["type"].alias("type"), found["replacement"].alias("replacement"))).cast(VERDICT)


def check_word(word: str, dictionary: DataFrame, project: DataFrame | None = None) -> DataFrame:
    """The verdict on one word: word, verdict, replacement."""
    spark = dictionary.sparkSession
    docs = spark.createDataFrame([(0, word)], "doc_id long, text string")
    hits = vocabulary_flags(docs, dictionary, project).select("doc_id", "type", "replacement")
    return docs.join(hits, "doc_id", "left").select(F.lit(word).alias("word"), F.coalesce("type", F.lit("allowed")).alias("verdict"), "replacement")


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """word, status, replacement, alternatives, pos_variants from lines (n, value) of ``word|pos|field`` under ``# APPROVED`` and ``# UNAPPROVED`` headings."""
    heading = F.when(F.col("value").rlike(r"(?i)^#\s*unapproved"), "unapproved").when(F.col("value").rlike(r"(?i)^#\s*approved"), "approved")
    marked = lines.withColumn("status", F.last(heading, ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.filter("status is not null and not startswith(value, '#') and contains(value, '|')")
    rows = rows.select("n", "status", F.split("value", r"\|").alias("p")).select("n", "status", F.lower(F.trim(F.col("p")[0])).alias("word"), F.trim(F.get("p", F.lit(1))).alias("pos"), F.trim(F.get("p", F.lit(2))).alias("field"))
    grouped = rows.groupBy("word", "status").agg(F.array_sort(F.collect_list(F.struct("n", "pos", "field"))).alias("v"))
    some = F.array_distinct(F.flatten(F.transform("v", lambda x: F.transform(F.split(F.coalesce(x["field"], F.lit("")), ","), lambda y: F.lower(F.trim(F.regexp_replace(y, r"\(.*\)", "")))))))
    alternatives = F.filter(some, lambda x: (x != "") & (x != "none"))
    return grouped.select("word", "status", F.when(F.col("status") == "unapproved", F.get(alternatives, F.lit(0))).alias("replacement"), alternatives.alias("alternatives"), F.transform("v", lambda x: F.struct(x["pos"].alias("pos"), x["field"].alias("field"))).alias("pos_variants"))


def pack_candidates(titles: DataFrame, dictionary: DataFrame) -> DataFrame:
    """term, note: the headwords of glossary titles (title, note) that may go into a pack.

    A title names one headword or several (commas, "vs."), glosses in brackets dropped.
    Words of the dictionary, and regular forms of such words, are left out: a form of an
    unapproved word would undo its prohibition, one of an approved word adds nothing.
    """
    parts = F.split(F.regexp_replace("title", r"\([^)]*\)", ""), r"\s*,\s*|\s+(?:vs\.?|versus)\s+")
    words_ = titles.select(F.explode(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: p != "")).alias("term"), "note")
    forms = words_.select("term", "note", F.explode(F.array_append(base_candidates(F.col("term")), F.col("term"))).alias("word")).distinct()
    barred = _joined(forms, dictionary.select("word").distinct(), "word", "left_semi").select("term").distinct()
    return words_.distinct().join(barred, "term", "left_anti")
