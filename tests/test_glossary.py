from prosemetrics.operators import glossary

PAGES = [
    (1, "<h1>Widgets, gadgets</h1><table><p>A server of tables.</p></table><p>A <b>Button</b> of ours.</p><p>A network.</p>"),
    (2, "<script>'<h1>no</h1>'</script><!-- <h1>no</h1> --><h1>Widgets (a gloss)</h1><p> </p><p>It has a Password &amp; a button.</p>"),
    (3, "<h1>Fish &amp; chips</h1>"), (4, "<p>No heading. A network.</p>"), (5, None), (6, ""), (7, "<h1> </h1>"), (8, "<h1>stops vs. widgets</h1><p>Nothing.</p>"),
    (9, "<h1>Utilized</h1><p>x</p>"), (10, "<h1>WIDGETS</h1><p>A button.</p>"),
]


def test_terms_of_a_glossary(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, html string").withColumnRenamed("html", "body")
    dictionary = spark.createDataFrame([("stop", "approved", None), ("utilize", "unapproved", "use")], "word string, status string, replacement string")
    found = {r["page_id"]: (r["title"], r["paragraph"]) for r in glossary.entries(pages, html="body").collect()}
    assert found[1] == ("Widgets, gadgets", "A Button of ours.") and found[2][0] == "Widgets (a gloss)" and found[3] == ("Fish & chips", None)
    assert set(found) == {1, 2, 3, 8, 9, 10}
    got = {r["term"]: (r["categories"], r["pages"]) for r in glossary.mined(pages, dictionary, html="body").collect()}
    assert got == {"widgets": (["UI/interaction", "security", "software/tooling"], 4), "gadgets": (["UI/interaction"], 1), "fish & chips": (["software/tooling"], 1)}
    again = {r["term"]: (r["categories"], r["pages"]) for r in glossary.mined(pages.repartition(5), dictionary, html="body").collect()}
    assert again == got
    assert glossary.mined(pages.limit(0), dictionary, html="body").count() == 0
