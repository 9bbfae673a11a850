"""Documents into structural units: blocks, list lines, sentences, code lines, words.

All of it is string functions on the row, so no unit needs a shuffle. Fences, list items,
headings and blank lines are turned into separators; what lies between two of them is a
block, and the sentences of a block are split at a full stop, blank and ASCII capital.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import has_any, let, rx

_S = r"[^\S\n]"  # white space within a line
FENCE = rf"(?m)^{_S}*```[^\n]*(?:\n(?:(?s:.*?)\n)??{_S}*```[^\n]*$|(?s:.*)\z)"
LIST_ITEM = rf"(?m)^({_S}*(?:[-*+]|\d+[.)]){_S}+)([^\n]*)$"
NUMBERED = rf"(?m)^({_S}*\d+[.)]{_S}+)([^\n]*)$"
HEADING = rf"(?m)^(?:#{{1,6}}{_S}|({_S}+#{{1,6}}{_S}))(?=[^\n]*\S)([^\n]*)$"
INLINE_CODE = r"`[^`\n]+`"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
_CUT, _ITEM, _NUMBER, _HEAD = "\x01", "\x02", "\x03", "\x04"


#: What ``\\s`` matches: Unicode's white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _split(trimmed: Column) -> Column:
    """A part begins with the text or a capital and ends with a mark or the text, so it has no blanks to trim, and is empty only if the text is."""
    return F.filter(F.split(trimmed, rx(SENTENCE_END)), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences of one block, trimmed; none is empty."""
    return _split(trim(text))


def words(text: Column) -> Column:
    """The words that checks see."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))


def metric_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]*"), F.lit(0))


def blank_words(text: Column) -> Column:
    """How many words stand between white space."""
    return F.regexp_count(text, F.lit(rx(r"\S+")))


def replaced_if(text: Column, literal: str, pattern: str, to: str) -> Column:
    """``text`` with the matches of ``pattern``, each of which has ``literal``, replaced."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(literal)), F.regexp_replace(t, rx(pattern), to)).otherwise(t))


def _without_fences(text: Column) -> Column:
    return replaced_if(text, "```", FENCE, _CUT)


def _joined_lines(text: Column) -> Column:
    """Lines joined by a blank, trimmed; a blank line is a cut."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: let(F.btrim(x, F.lit(WHITE)), lambda y: F.when(y == "", _CUT).otherwise(y))), " ")


def list_lines(text: Column) -> Column:
    """The lines that are list items, marker included."""
    return F.regexp_extract_all(_without_fences(text), F.lit(rx(LIST_ITEM)), F.lit(0))


def prose_blocks(text: Column) -> Column:
    """array<struct<kind, content>>: headings, list items (numbered or not) and paragraphs, with markers and inline code gone."""
    t = _without_fences(text)
    t = F.regexp_replace(t, rx(NUMBERED), f"{_CUT}{_NUMBER}$2{_CUT}")
    t = F.regexp_replace(t, rx(LIST_ITEM), f"{_CUT}{_ITEM}$2{_CUT}")
    t = replaced_if(t, "#", HEADING, f"{_CUT}{_HEAD}$1$2{_CUT}")
    t = replaced_if(_joined_lines(t), "`", INLINE_CODE, " ")

    def block(part: Column) -> Column:
        mark = F.substring(part, 1, 1)
        kind = F.when(mark == _NUMBER, "numbered").when(mark == _ITEM, "list_item").when(mark == _HEAD, "header").otherwise("paragraph")
        unmarked = F.when(has_any(part, (_NUMBER, _ITEM, _HEAD)), trim(F.regexp_replace(part, f"[{_NUMBER}{_ITEM}{_HEAD}]", ""))).otherwise(part)
        return F.struct(kind.alias("kind"), unmarked.alias("content"))

    parts = F.filter(F.transform(F.split(t, _CUT), trim), lambda p: p != "")
    return F.transform(parts, block)


def with_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with list_lines, blocks (kind, content) and sentences (sentence, numbered), in order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"list_lines": list_lines(whole), "blocks": prose_blocks(whole)})
    each = F.transform("blocks", lambda b: F.transform(_split(b["content"]), lambda s: F.struct(s.alias("sentence"), (b["kind"] == "numbered").alias("numbered"))))
    return out.withColumn("sentences", F.flatten(each))


def code_lines(text: Column) -> Column:
    """array<struct<line, next, following>>: each line, the next one (null after the last) and the next that is not blank, trimmed."""
    lines = F.split(text, "\n", -1)

    def look(all_lines: Column) -> Column:
        first = F.struct(F.lit(None).cast("string").alias("next"), F.lit(None).cast("string").alias("following"), F.array().cast("array<struct<line:string,next:string,following:string>>").alias("out"))

        def step(acc, line):
            t = trim(line)
            row = F.struct(line.alias("line"), acc["next"].alias("next"), acc["following"].alias("following"))
            return F.struct(line.alias("next"), F.when(t != "", t).otherwise(acc["following"]).alias("following"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.reverse(F.aggregate(F.reverse(all_lines), first, step, lambda a: a["out"]))

    return let(lines, look)


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, type, content: every block as written (fence, header, list_item, paragraph, blank)."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line"))
    by = Window.partitionBy(key).orderBy("n")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    mark = trim(F.col("line")).startswith("```").cast("int")
    lines = lines.withColumn("mark", mark).withColumn("seen", F.sum("mark").over(upto))
    fenced = (F.col("mark") == 1) | (F.col("seen") % 2 == 1)
    stripped = trim(F.col("line"))
    kind = (
        F.when(fenced, "fence").when(stripped == "", "blank").when(stripped.rlike(rx(r"^#{1,6}\s")), "header")
        .when(F.col("line").rlike(rx(r"^\s*(?:[-*+]|\d+[.)])\s+.*$")), "list_item").otherwise("paragraph")
    )
    lines = lines.withColumn("type", kind).withColumn("opens", (F.col("mark") == 1) & (F.col("seen") % 2 == 1))
    before = F.lag("type").over(by)
    new = F.col("opens") | ((F.col("type") != "fence") & ~((F.col("type") == "paragraph") & F.coalesce(before == "paragraph", F.lit(False))))
    lines = lines.withColumn("ord", F.sum(new.cast("int")).over(upto) - 1)
    grouped = lines.groupBy(key, "ord").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    raw = F.transform("lines", lambda x: x["line"])
    content = F.when(F.col("type") == "paragraph", F.array_join(F.transform(raw, trim), " ")).otherwise(F.array_join(raw, "\n"))
    return grouped.select(key, "ord", "type", content.alias("content"))


def metric_sentences(text: Column) -> Column:
    """Sentences for text shape: markers of headings and list items stay; those without a letter go."""
    t = _without_fences(text)
    t = F.regexp_replace(t, rx(LIST_ITEM), f"{_CUT}$1$2{_CUT}")
    t = F.regexp_replace(t, rx(HEADING), f"{_CUT}$0{_CUT}")
    t = _joined_lines(t)
    parts = F.filter(F.transform(F.split(t, _CUT), trim), lambda p: p != "")
    return F.filter(F.flatten(F.transform(parts, sentences)), lambda s: s.rlike("[A-Za-z]"))
