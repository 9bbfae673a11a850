"""Cheap tests before patterns: what stands in a text is found by one pass, and nothing is lost."""

import random

from pyspark.sql import functions as F

from prosemetrics.functions.patterns import heard, is_heard, longest, rx
from prosemetrics.operators import fix, structure

WORDS = ("key takeaways", "enable", "enables", "en", "very", "ever-changing", "at")


def test_one_pass_finds_the_literals_that_begin_words(spark):
    draw = random.Random(3)
    texts = ["\n" + "".join(draw.choice((*WORDS, " ", "\n", "x", "é", "-", "enab", "\U0001f600")) for _ in range(8)) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select("text", *[is_heard(heard(F.col("text"), WORDS), (w,), WORDS).alias(w) for w in WORDS]).collect()
    begins = lambda t, w: any(t.startswith(w, i) and not ("a" <= t[i - 1] <= "z") for i in range(1, len(t)))
    assert all(r[w] == begins(r["text"], w) for r in got for w in WORDS)
    assert longest(("a", "ab", "b")) == "(?:a(?:b)?|b)"


def test_trim_takes_what_the_pattern_takes(spark):
    chars = [chr(i) for i in range(1, 0x3100)]
    docs = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in chars], "t string")
    assert set(chars) >= set(structure.WHITE) and docs.filter(structure.trim(F.col("t")) != F.regexp_replace("t", rx(r"\A\s+|\s+\z"), "")).count() == 0


def test_prose_fixes_run_a_pattern_only_where_it_can_match(spark):
    docs = spark.createDataFrame([("It is  fine , NOTABLY so &mdash; ok \U0001f600. Now `a  notably` &#167; 3 .\n  # Head  ing\n٣. item  one .\nnothing here",), ("Plain text.",), (None,)], "text string")
    out = fix.fix(docs)
    assert [r["fixed"] for r in out.collect()] == ["It is fine so — ok. Now `a  notably` section 3.\n# Head ing\n٣. Item one.\nNothing here", "Plain text.", None]
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    assert "ontains(" in out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
