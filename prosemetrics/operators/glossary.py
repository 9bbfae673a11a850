"""Terms for packs, mined from the pages of a glossary: headwords, categories, the dictionary's own words left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import rx
from ..sources.html import paragraph_texts, unescaped
from .vocabulary import pack_candidates

# Categories of a headword, in the order in which they are tried, with what its first paragraph says then.
CATEGORIES = (
    ("security", ("security", "encrypt", "password", "authentic", "vulnerab", "malware", "phish", "spoof", "firewall", "exploit")),
    ("networking", ("network", "protocol", "server", "connection", "wireless", "bluetooth", "ip address", "bandwidth", "router")),
    ("data/storage", ("database", "data structure", "storage", "record", "backup", "disk", "file system")),
    ("cloud/infrastructure", ("cloud", "virtual machine", "datacenter", "scalab", "container", "kubernetes")),
    ("accessibility", ("accessib", "screen reader", "assistive")),
    ("UI/interaction", ("button", "menu", "dialog box", "window", "click", "screen", "cursor", "touch")),
)
OTHERWISE = "software/tooling"


def category(paragraph: Column, categories=CATEGORIES, otherwise: str = OTHERWISE) -> Column:
    """The first category one of whose keywords stands in the paragraph, whatever the case."""
    said, out = F.lower(F.coalesce(paragraph, F.lit(""))), F.lit(None).cast("string")
    for label, words in categories:
        any_ = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(said, w))
        out = F.coalesce(out, F.when(any_, F.lit(label)))
    return F.coalesce(out, F.lit(otherwise))


def entries(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, title, paragraph: a page's first heading and first paragraph; pages without a heading give no row.

    Later paragraphs, tables and asides tell of other words than the one defined. A
    projection: no shuffle. A page without a paragraph has null there.
    """
    bare = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(style|script)\b[^>]*>.*?</\1\s*>", "")
    heading = F.regexp_extract(bare, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    title = F.trim(F.regexp_replace(unescaped(F.regexp_replace(heading, r"<[^>]*>", "")), rx(r"\s+"), " "))
    rows = pages.select(key, title.alias("title"), F.get(paragraph_texts(F.col(html), 1), F.lit(0)).alias("paragraph"))
    return rows.filter("title <> ''")


def mined(pages: DataFrame, dictionary: DataFrame, categories=CATEGORIES, otherwise: str = OTHERWISE, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """term, categories (sorted), pages: the headwords that may go into a pack, each once.

    A heading names one headword or several; words of the dictionary and regular forms of
    them are left out. A term that pages put into several categories has all of them, so
    the result does not depend on the order of pages.
    """
    rows = entries(pages, key=key, html=html)
    titles = rows.groupBy("title", category(F.col("paragraph"), categories, otherwise).alias("note")).agg(F.count("*").alias("pages"))
    kept = pack_candidates(titles.select("title", F.to_json(F.struct("note", "pages", "title")).alias("note")), dictionary)
    of = F.from_json("note", "note string, pages long, title string")
    per = kept.select("term", of.alias("of")).select("term", "of.*")
    # Categories are few: a set of them stays small however often a term comes.
    return per.groupBy("term").agg(F.array_sort(F.collect_set("note")).alias("categories"), F.sum("pages").alias("pages"))
