"""Texts that trigger the checks, made from the relational tables in both engines alike.

The documents of the test data are silent on most checks, so each derived document joins
templates chosen by the part's key, with the part's name in their gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

SENTENCES = (
    "Needless to say, {} is late.", "It is worth noting that {} is late.", "At the end of the day {} is fine.", "We say {} is needless to say late.", "Notably, {} arrived.", "The {} was, arguably, fine and ultimately sold.",
    "Big news: {} arrived.", "Note: {} arrived.", "Step 2: open {}.", "It is not {}.", "It is {}.", "This is not cheap.", "This is also not cheap.", "They were running, jumping and swimming for {}.",
    "The {} serves as a box and boasts a lid.", "The {} sold well, underscoring demand.", "In conclusion {} sold.", "Despite its success {} failed.", "Studies show that {} sells and experts agree.", "Use &mdash; and &sect; near {} &bull; often.",
    "It is not just {} but more.", "The {} is very good and really quite big.", "The {} is done ✨ and ✔.", "A robust, seamless and game-changing {}.", "The {} leverages steel and enables use.", "We delve into {} and delve about.", "An amazing hidden gem, {}.",
    "Roast it and tell me what's wrong.", "Everything changed.", "Something shifted.", "Full stop.", "That's it.", "Why {}?", "Because we said so.", "Not cheap.", "Not {}.", "Not new.", "We banned widget and gadget near {}.", "The part_key and max_part_size of {}.",
    "WARNING: but {} is hot.", "Caution: {} can cause harm.", "NOTICE:", "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty one two three four five six {}.",
    "He was running and they were being tested.", "The {} has written it and have been told.", "She had stopped but has three.", "You should wait and may need to stop.", "It would go if {} could run.", "They don't know; it's {}'s own.", "Stop the line when {} is on.", "If it is on then stop.",
    "Use tools, e.g. {}, etc. and so on.", "Check, verify and confirm {}.", "Delete or remove the settings and options.", "The woman and his men saw morning lighting.", "It was updated and is opening.",
)
LIST_LINES = ("- **Lead** about {}", "- **Done.** about {}", "* __Lead__ {}", "- A1: The {}", "- **AB-12** The {}", "1. X3 is {}", "2) plain {}", "+ **Bold**", "- A1 is {}")
CODE_LINES = (
    "# Import the {}", "# Set up because {}", "# Step 1: load {}", "# ------------", "# we moved {} here", "# The idea here is {}", "# previously this was {}", "# as per the spec", "except ValueError:", "", "    pass", "except OSError as ignored:", "    pass", "def f(a=[], b={ }, c=set()):",
    "    print(1)", "# TODO fix {}", "# FIXME see #12", "data1 = helper_2", "    assert True", "if True:", "while False:", "while True:", "x = 1", "# {}",
)
_LONG = " ".join(["word"] * 22)
PARTS = (
    "# The Grand Title Heading Of Steel", "# A quiet heading", "**a** and **b** and **c** and **d** and **e**", "**f** **g** **h** **i** {}", "| **x** | **y** |", "---", "***", "one — two — three &mdash; {}", "left &#8212; right — {}",
    "See [cite: 12] for {}", "As an AI language model I sell {}", _LONG + " {}", _LONG + " more {}", _LONG + " and even more of {}", _LONG + " but less of {}", _LONG + " or none of {}", "we run and execute {}", "show or display the config and settings",
)
LEXICON = {"widget": "say part", "gadget": ""}


def _picks(templates, count: int) -> list[tuple[int, int]]:
    """(factor, shift): the i-th template of a part is number (key * factor + shift) mod the number of templates. Neighbours stay neighbours, the last one varies."""
    return [(1 if i < count - 1 else 2 * i + 1, i) for i in range(count)]


def derived_column(templates, count: int, joiner: str):
    array = F.array(*[F.lit(t) for t in templates])
    picks = [F.get(array, ((F.col("p_partkey") * f + s) % len(templates)).cast("int")) for f, s in _picks(templates, count)]
    return F.replace(F.concat_ws(joiner, *picks), F.lit("{}"), F.col("p_name"))


KINDS = {"sentences": (SENTENCES, 3, " "), "lists": (LIST_LINES, 3, "\n"), "code": (CODE_LINES, 9, "\n"), "parts": (PARTS, 7, "\n\n")}


def derived(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """doc_id, text."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name"), "p_partkey")
    return part.select(F.col("p_partkey").alias("doc_id"), derived_column(*KINDS[kind]).alias("text"))


def derived_sql(kind: str) -> str:
    templates, count, joiner = KINDS[kind]
    items = ", ".join("'" + t.replace("'", "''") + "'" for t in templates)
    between = " || ".join({" ": "' '", "\n": "chr(10)"}[c] for c in joiner)
    picks = f" || {between} || ".join(f"([{items}])[(p_partkey * {f} + {s}) % {len(templates)} + 1]" for f, s in _picks(templates, count))
    return f"SELECT p_partkey AS doc_id, replace({picks}, '{{}}', p_name) AS text FROM part"
