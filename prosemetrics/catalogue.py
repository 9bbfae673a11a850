"""The queries of the engine itself, each over its whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from . import catalogue_flow, catalogue_runs
from .checks import controlled, prose
from .operators import arms, config, corpus, embedded, experiment, fix, history, lint, routing, structure, terms, vocabulary
from .plans import oracles as O
from .plans.derived import LEXICON, derived, derived_sql
from .plans.registry import TERM_LISTS, built_in_terms, check_table, ruleset, rulesets, term_lists
from .sources import html, literals, rule_import, shell

FLAGSHIP = ("ing_form", "passive", "inclusive_language", "progressive", "trailing_condition")
ROUTES = [{"glob": "*/fr/*", "ruleset": "prose"}, {"glob": "*page=?", "ruleset": "controlled"}, {"glob": "*/en/*", "ruleset": None}, {"glob": "http*[0-9]", "ruleset": "code"}]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _only(rules: str, keep) -> list[str]:
    return [c.id for c in ruleset(rules).checks if c.id not in set(keep)]


# --- checks ---------------------------------------------------------------------------
_KIND = {"LINE": "lists", "DOCUMENT": "parts", "SENTENCE": "sentences", "SENTENCES": "sentences", "BLOCK": "sentences"}


def check_query(spark, sf_dir, rules: str, check: str):
    """doc_id, label, hits of one check on the derived texts. Checks that count give their count."""
    unit = ruleset(rules).table()[check].unit
    kind = "code" if rules == "code" else "sentences" if rules == "controlled" else _KIND[unit]
    docs = derived(spark, sf_dir, kind)
    found = lint.flags(docs, rules, {"lexicon": LEXICON}, disabled=_only(rules, [check]))
    return found.groupBy("doc_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("hits"))


#: Checks that are not silent on documents.
_HEARD = (("controlled", "ing_form"), ("controlled", "inclusive_language"), ("controlled", "passive"), ("controlled", "progressive"), ("controlled", "trailing_condition"), ("prose", "bold_density"))


def check_documents(spark, sf_dir, rules: str, check: str):
    """As ``check_query``, on all documents."""
    found = lint.flags(_table(spark, sf_dir, "documents"), rules, disabled=_only(rules, [check]))
    return found.groupBy("doc_id", F.coalesce("label", F.lit("")).alias("label")).agg(F.sum(F.coalesce("occurrences", F.lit(1))).cast("long").alias("hits"))


def _dictionary(spark):
    rows = [("it", "approved", None), ("is", "approved", None), ("late", "approved", None), ("use", "approved", None), ("be", "approved", None), ("the", "approved", None), ("stop", "approved", None), ("utilize", "unapproved", "use"), ("sell", "unapproved", "give"), ("fail", "unapproved", None), ("banned", "unapproved", "stopped")]
    return spark.createDataFrame(rows, "word string, status string, replacement string")


def vocabulary_join(spark, sf_dir):
    """type and number of the flags of the derived sentences against a small dictionary."""
    found = vocabulary.vocabulary_flags(derived(spark, sf_dir, "sentences"), _dictionary(spark))
    return found.groupBy("doc_id", "type").agg(F.count("*").alias("hits"))


_VOCABULARY_SQL = f"""{O.SENTS}, toks AS (SELECT doc_id, trim(lower(unnest(regexp_extract_all(s, '[A-Za-z'']+'))), '''') AS w FROM sents),
    dict(word, status, replacement) AS (VALUES ('it','approved',NULL),('is','approved',NULL),('late','approved',NULL),('use','approved',NULL),('be','approved',NULL),('the','approved',NULL),('stop','approved',NULL),('utilize','unapproved','use'),('sell','unapproved','give'),('fail','unapproved',NULL),('banned','unapproved','stopped')),
    irr(w, base) AS (VALUES {', '.join(f"({O.q(a)}, {O.q(b)})" for a, b in controlled.IRREGULAR_BASES.items())}),
    kept AS (SELECT t.*, d.status, d.replacement FROM toks t LEFT JOIN dict d ON t.w = d.word WHERE t.w <> '' AND t.w NOT IN ({', '.join(map(O.q, controlled.MODALS))}) AND coalesce(d.status, '') <> 'approved'),
    words AS (SELECT DISTINCT w FROM kept WHERE status IS NULL),
    cands AS (SELECT w, base AS c, 0 AS n FROM words JOIN irr USING (w)
        UNION ALL SELECT w, left(w, -3) || 'y', 1 FROM words WHERE ends_with(w, 'ies') AND length(w) > 4 UNION ALL SELECT w, left(w, -2), 2 FROM words WHERE ends_with(w, 'es') AND length(w) > 3
        UNION ALL SELECT w, left(w, -1), 3 FROM words WHERE ends_with(w, 's') AND length(w) > 2 UNION ALL SELECT w, left(w, -3) || 'y', 4 FROM words WHERE ends_with(w, 'ied') AND length(w) > 4
        UNION ALL SELECT w, left(w, -2), 5 FROM words WHERE ends_with(w, 'ed') AND length(w) > 3 UNION ALL SELECT w, left(w, -2) || 'e', 6 FROM words WHERE ends_with(w, 'ed') AND length(w) > 3
        UNION ALL SELECT w, left(w, -3), 7 FROM words WHERE ends_with(w, 'ed') AND length(w) > 4 AND substr(w, length(w) - 2, 1) = substr(w, length(w) - 3, 1) AND substr(w, length(w) - 2, 1) NOT IN ('a','e','i','o','u')),
    based AS (SELECT w, arg_min(status, n) AS bstatus FROM cands JOIN dict ON c = word GROUP BY w),
    typed AS (SELECT doc_id, CASE WHEN status = 'unapproved' THEN CASE WHEN replacement IS NULL THEN 'unapproved_no_replacement' ELSE 'unapproved_synonym' END WHEN bstatus = 'approved' THEN NULL WHEN bstatus IS NOT NULL THEN 'unapproved_synonym' ELSE 'unknown_vocabulary' END AS type FROM kept LEFT JOIN based USING (w))
    SELECT doc_id, type, count(*) AS hits FROM typed WHERE type IS NOT NULL GROUP BY ALL"""


# --- structure and shape ----------------------------------------------------------------
_PLAIN = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n[ \\t]*\\n', chr(31), 'g'), '\\n', ' ', 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '')"


def sentence_split(spark, sf_dir):
    docs = structure.with_units(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("sentences").cast("long").alias("sentences"), F.aggregate("sentences", F.lit(0).cast("long"), lambda a, s: a + F.length(s["sentence"])).alias("characters"))


_SENTENCE_SQL = f"""WITH paras AS (SELECT doc_id, text, {_PLAIN} AS ps FROM documents), ss AS (SELECT doc_id, flatten(list_transform(ps, lambda p: {O.split_sentences('p')})) AS s FROM paras)
    SELECT doc_id, len(s)::BIGINT AS sentences, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS characters FROM ss"""


def word_counts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", structure.blank_words(t).cast("long").alias("blank_words"), F.size(structure.words(t)).cast("long").alias("check_words"), F.size(structure.metric_words(t)).cast("long").alias("metric_words"))


_WORDS_SQL = "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS blank_words, len(regexp_extract_all(text, '[A-Za-z'']+'))::BIGINT AS check_words, len(regexp_extract_all(lower(text), '[a-z][a-z''-]*'))::BIGINT AS metric_words FROM documents"


def text_shape(spark, sf_dir):
    return experiment.text_shape(derived(spark, sf_dir, "sentences"), rounded=False)


_SHAPE_SQL = f"""{O.SENTS}, worded AS (SELECT doc_id, i, regexp_extract_all(lower(s), '[a-z][a-z''-]*') AS w FROM sents WHERE regexp_matches(s, '[A-Za-z]')),
    shape AS (SELECT doc_id, count(*)::INT AS sentences, avg(len(w)) AS mean_sentence_words, coalesce(stddev_samp(len(w)), 0) AS sentence_length_stdev FROM worded WHERE len(w) > 0 GROUP BY doc_id),
    totals AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS w FROM docs)
    SELECT t.doc_id, len(t.w)::BIGINT AS words, coalesce(s.sentences, 0)::INT AS sentences, coalesce(mean_sentence_words, 0) AS mean_sentence_words, coalesce(sentence_length_stdev, 0) AS sentence_length_stdev, CASE WHEN len(t.w) > 0 THEN len(list_distinct(t.w))::DOUBLE / len(t.w) ELSE 0 END AS type_token_ratio FROM totals t LEFT JOIN shape s USING (doc_id)"""


def text_shape_documents(spark, sf_dir):
    """Shape of all documents; those without text have zeros."""
    return experiment.text_shape(_table(spark, sf_dir, "documents"), rounded=False)


def blocks(spark, sf_dir):
    """Blocks of each type of the derived documents, with their characters."""
    b = structure.blocks(derived(spark, sf_dir, "parts"))
    return b.groupBy("doc_id", "type").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).cast("long").alias("characters"))


_BLOCKS_SQL = f"""{O.PARTS}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    typed AS (SELECT doc_id, line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{{1,6}}\\s') THEN 'header' WHEN regexp_matches(line, '^\\s*(?:[-*+]|\\d+[.)])\\s+.*$') THEN 'list_item' ELSE 'paragraph' END AS type FROM lines)
    SELECT doc_id, type, count(*) AS blocks, sum(length(line))::BIGINT AS characters FROM typed GROUP BY ALL"""


def html_paragraphs(spark, sf_dir):
    p = html.flat_paragraphs(_table(spark, sf_dir, "pages"))
    return p.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).cast("long").alias("characters"))


_HTML_SQL = """WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<table\\b[^>]*>.*?</table\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<sup\\b[^>]*>.*?</sup\\s*>', '', 'g'), '(?is)<figure\\b[^>]*>.*?</figure\\s*>', '', 'g'), '(?is)<figcaption\\b[^>]*>.*?</figcaption\\s*>', '', 'g') AS h FROM pages),
    ps AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1)) AS p FROM bare), clean AS (SELECT page_id, trim(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS p FROM ps)
    SELECT page_id, count(*) AS paragraphs, sum(length(p))::BIGINT AS characters FROM clean WHERE len(regexp_extract_all(p, '\\S+')) >= 20 GROUP BY page_id"""


def html_paragraphs_nested(spark, sf_dir):
    p = html.html_paragraphs(_table(spark, sf_dir, "pages"))
    return p.groupBy("page_id").agg(F.count("*").alias("paragraphs"))


# --- corpus analytics ---------------------------------------------------------------------
def _flagged(spark, docs, keep=FLAGSHIP):
    checks = check_table(spark, "controlled").filter(F.col("check_id").isin(*keep))
    context = {"dictionary": _dictionary(spark)}
    return lint.merged_flags(docs.select("doc_id", "text"), "controlled", context, disabled=_only("controlled", keep)), checks


def _activity(docs, keep, by=()):
    return corpus.activity_of(docs, "controlled", by, {"dictionary": _dictionary(docs.sparkSession)}, disabled=_only("controlled", keep))


def _sentences_cte(where: str = "") -> str:
    return f"""paras AS (SELECT doc_id, {_PLAIN} AS ps FROM docs {where}), ss AS (SELECT doc_id, flatten(list_transform(ps, lambda p: {O.split_sentences('p')})) AS ss FROM paras), sents AS (SELECT doc_id, unnest(ss) AS s FROM ss),
    raw AS (SELECT doc_id, 'ing_form' AS k, unnest(list_filter(regexp_extract_all(s, '(?i)\\b(\\w+ing)\\b', 1), lambda x: lower(x) NOT IN ({', '.join(map(O.q, (*controlled.ING_NOUNS, *controlled.ING_NEVER_VERBAL)))}))) AS label FROM sents
        UNION ALL SELECT doc_id, 'passive', unnest(list_transform({O._all(controlled.PASSIVE)}, lambda x: regexp_replace(x, '\\s+', ' '))) FROM sents
        UNION ALL SELECT doc_id, 'inclusive_language', unnest(list_filter(regexp_extract_all(s, '[A-Za-z'']+'), lambda x: lower(x) IN ({', '.join(map(O.q, (*controlled.PRONOUNS, *controlled.TERMS)))}))) FROM sents
        UNION ALL SELECT doc_id, 'progressive', unnest(CASE WHEN true THEN list_transform(list_filter({O._all(controlled.PROGRESSIVE)}, lambda x: NOT (regexp_matches(x, '(?i)^w') AND list_contains([{', '.join(map(O.q, controlled.PROGRESSIVE_PAST))}], lower(regexp_extract(x, '\\s(\\w+)$', 1))))), lambda x: regexp_replace(x, '\\s+', ' ')) END) FROM sents
        UNION ALL SELECT doc_id, 'trailing_condition', s || row_number() OVER () FROM sents WHERE {O._has(controlled.TRAILING)} AND NOT regexp_matches(s, '(?i)^(if|when)\\b')),
    merged AS (SELECT DISTINCT doc_id, k, lower(label) AS label FROM raw)"""


_DIM = "dim(check_id) AS (VALUES " + ", ".join(f"({O.q(c)})" for c in FLAGSHIP) + ")"


def activity_by_lang(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("lang = 'en'")
    found, checks = _flagged(spark, docs)
    return corpus.activity(docs, found, checks, ("lang", "source")).select("lang", "source", "check_id", "hits", "files", "words", "documents")


_ACTIVITY_SQL = f"""WITH docs AS (SELECT doc_id, text, lang, source FROM documents WHERE lang = 'en'), {_sentences_cte()}, {_DIM},
    tot AS (SELECT lang, source, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words, count(*) AS documents FROM docs GROUP BY ALL),
    per AS (SELECT lang, source, k, count(*) AS hits, count(DISTINCT doc_id) AS files FROM merged JOIN docs USING (doc_id) GROUP BY ALL)
    SELECT t.lang, t.source, d.check_id, coalesce(p.hits, 0)::BIGINT AS hits, coalesce(p.files, 0)::BIGINT AS files, t.words, t.documents FROM tot t CROSS JOIN dim d LEFT JOIN per p ON p.lang = t.lang AND p.source = t.source AND p.k = d.check_id"""


def flag_share(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("lang = 'en'")
    found, checks = _flagged(spark, docs)
    return corpus.activity(docs, found, checks).select("check_id", "hits", "share")


_SHARE_SQL = f"""WITH docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), {_sentences_cte()}, {_DIM}, per AS (SELECT k, count(*) AS n FROM merged GROUP BY k)
    SELECT check_id, coalesce(n, 0)::BIGINT AS hits, coalesce(coalesce(n, 0)::DOUBLE / nullif(sum(n) OVER (), 0), 0) AS share FROM dim LEFT JOIN per ON k = check_id"""


def _compared(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").filter("lang = 'en'").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    docs = docs.withColumn("control", F.when(F.col("quality") == 1, F.concat(F.lit("c"), F.pmod("doc_id", F.lit(3)).cast("string"))).otherwise("measured"))
    found, checks = _flagged(spark, docs)
    act = corpus.activity(docs, found, checks, ("control",))
    return corpus.compare(act.filter("control = 'measured'").drop("control"), act.filter("control <> 'measured'"), ("control",))


def compare_quality(spark, sf_dir):
    return _compared(spark, sf_dir).select("check_id", "control", "per_1k", "control_per_1k", "verdict")


def consensus_quality(spark, sf_dir):
    return corpus.consensus(_compared(spark, sf_dir))


def calibration(spark, sf_dir):
    return corpus.calibrate(_compared(spark, sf_dir), 1.5).select("check_id", "control_per_1k", "measured_per_1k", "target_per_1k", "skipped")


_COMPARED = f"""WITH docs AS (SELECT d.doc_id, text, CASE WHEN quality = 1 THEN 'c' || (d.doc_id % 3) ELSE 'measured' END AS control FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en'), {_sentences_cte()}, {_DIM},
    tot AS (SELECT control, sum(len(regexp_extract_all(text, '\\S+'))) AS words FROM docs GROUP BY ALL), per AS (SELECT control, k, count(*) AS hits FROM merged JOIN docs USING (doc_id) GROUP BY ALL),
    act AS (SELECT t.control, check_id, coalesce(round(coalesce(hits, 0) * 1000.0::DOUBLE / nullif(words, 0), 2), 0) AS per_1k FROM tot t CROSS JOIN dim LEFT JOIN per p ON p.control = t.control AND k = check_id),
    cmp AS (SELECT m.check_id, c.control, m.per_1k, c.per_1k AS control_per_1k, CASE WHEN m.per_1k = 0 AND c.per_1k = 0 THEN 'silent' WHEN c.per_1k = 0 OR m.per_1k / c.per_1k >= 2 THEN 'discriminates' WHEN m.per_1k / c.per_1k <= 0.5 THEN 'backwards' ELSE 'no signal' END AS verdict
        FROM act m JOIN act c ON m.check_id = c.check_id AND m.control = 'measured' AND c.control <> 'measured')"""
_CONSENSUS = "SELECT check_id, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) ELSE 'disputed' END AS verdict, count(*) AS controls FROM cmp GROUP BY check_id"
_CALIBRATION = f"""SELECT check_id, round(max(control_per_1k), 3) AS control_per_1k, min(per_1k) AS measured_per_1k, CASE WHEN max(control_per_1k) > 0 THEN round(max(control_per_1k) * 1.5, 3) END AS target_per_1k, CASE WHEN max(control_per_1k) > 0 THEN NULL ELSE 'no control evidence' END AS skipped
    FROM cmp WHERE check_id IN (SELECT check_id FROM ({_CONSENSUS}) WHERE verdict = 'discriminates') GROUP BY check_id"""


def _kind_counts(docs, keep):
    return corpus.kind_counts_of(docs, "controlled", {"dictionary": _dictionary(docs.sparkSession)}, disabled=_only("controlled", keep))


def kind_counts(spark, sf_dir):
    return _kind_counts(_table(spark, sf_dir, "documents").filter("lang = 'en'"), FLAGSHIP)


# The same over all documents, of any language or none, and all checks of the ruleset; RE2 can't express those, so without SQL.
_WHOLE = tuple(c.id for c in ruleset("controlled").checks)


def activity_whole(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _activity(docs, _WHOLE, ("lang", "source")).select("lang", "source", "check_id", "hits", "files", "words", "documents")


def flag_share_whole(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _activity(docs, _WHOLE).select("check_id", "hits", "share")


def _compared_whole(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    docs = docs.withColumn("control", F.when(F.col("quality") == 1, F.concat(F.lit("c"), F.pmod("doc_id", F.lit(3)).cast("string"))).otherwise("measured"))
    act = _activity(docs, _WHOLE, ("control",))
    return corpus.compare(act.filter("control = 'measured'").drop("control"), act.filter("control <> 'measured'"), ("control",))


def compare_quality_whole(spark, sf_dir):
    return _compared_whole(spark, sf_dir).select("check_id", "control", "per_1k", "control_per_1k", "verdict")


def consensus_quality_whole(spark, sf_dir):
    return corpus.consensus(_compared_whole(spark, sf_dir))


def calibration_whole(spark, sf_dir):
    return corpus.calibrate(_compared_whole(spark, sf_dir), 1.5).select("check_id", "control_per_1k", "measured_per_1k", "target_per_1k", "skipped")


def kind_counts_whole(spark, sf_dir):
    return _kind_counts(_table(spark, sf_dir, "documents"), _WHOLE)


def manifest(spark, sf_dir):
    return corpus.manifest(_table(spark, sf_dir, "documents"))


_MANIFEST_SQL = catalogue_runs.manifest_sql(3, corpus.MANIFEST_RANGE)


# --- flags to verdicts ----------------------------------------------------------------------
_INTENSE = ("vague_intensifier", "marketing_adjective", "stock_adverb")
_MERGED_SQL = f"""{O.SENTS}, raw AS (SELECT doc_id, 'vague_intensifier' AS kind, 'semantic' AS bucket, unnest({O._all(O._longest(prose.VAGUE_INTENSIFIERS).join(('\\b(', ')\\b')), 1)}) AS label FROM sents
    UNION ALL SELECT doc_id, 'marketing_adjective', 'semantic', unnest({O._all(O._longest(prose.MARKETING_ADJECTIVES).join(('\\b(', ')\\b')), 1)}) FROM sents
    UNION ALL SELECT doc_id, 'stock_adverb', 'mechanical', unnest({O._all(O._longest(prose.STOCK_ADVERBS).join(('\\b(', ')\\b')), 1)}) FROM sents),
    merged AS (SELECT doc_id, kind, bucket, lower(label) AS label, count(*) AS n FROM raw GROUP BY ALL)"""


def _intense(spark, sf_dir):
    return lint.merged_flags(derived(spark, sf_dir, "sentences"), "prose", disabled=_only("prose", _INTENSE))


def dedup_flags(spark, sf_dir):
    m = _intense(spark, sf_dir)
    return m.select("doc_id", "kind", "bucket", F.lower("label").alias("label"), F.coalesce("occurrences", F.lit(1)).cast("long").alias("n"))


def _strict(spark):
    return check_table(spark, "prose").withColumn("threshold", F.when(F.col("check_id") == "vague_intensifier", 2).otherwise(F.col("threshold"))).withColumn("action", F.when(F.col("check_id").isin(*_INTENSE), "block").otherwise(F.col("action")))


def gate_decision(spark, sf_dir):
    docs = derived(spark, sf_dir, "sentences")
    return lint.gate_documents(docs, "prose", config=_strict(spark), disabled=_only("prose", _INTENSE)).select("doc_id", "kind", "weight", "blocks")


def gate_merged(spark, sf_dir):
    """The same, from flags that are rows already."""
    return lint.gate(_intense(spark, sf_dir), _strict(spark)).select("doc_id", "kind", "weight", "blocks")


_GATE_SQL = f"{_MERGED_SQL} SELECT doc_id, kind, sum(n)::BIGINT AS weight, sum(n) >= CASE WHEN kind = 'vague_intensifier' THEN 2 ELSE 1 END AS blocks FROM merged WHERE bucket = 'semantic' GROUP BY doc_id, kind"


def lint_status(spark, sf_dir):
    return lint.lint(derived(spark, sf_dir, "sentences"), "prose", config=_strict(spark), disabled=_only("prose", _INTENSE))


def dedup_rows(spark, sf_dir):
    """``dedup_flags``, merged by a shuffle from flags that are rows already."""
    m = lint.dedup(lint.flags(derived(spark, sf_dir, "sentences"), "prose", disabled=_only("prose", _INTENSE)), "prose")
    return m.select("doc_id", "kind", "bucket", F.lower("label").alias("label"), F.coalesce("occurrences", F.lit(1)).cast("long").alias("n"))


def verdicts_merged(spark, sf_dir):
    docs = derived(spark, sf_dir, "sentences")
    return lint.verdicts(docs, _intense(spark, sf_dir), _strict(spark))


#: Files made of the derived texts: every fifth is out of scope, every seventh of no rule; of the others, blog/ has no adverb check.
_SCAN_RULES = [{"glob": "vendor/*", "ruleset": None}, {"glob": "blog/*.md", "ruleset": "prose", "disable": ["stock_adverb"]}, {"glob": "*.md", "ruleset": "prose"}]


def _scan_files(spark, sf_dir):
    folder = F.when(F.col("doc_id") % 5 == 0, "vendor/").when(F.col("doc_id") % 2 == 0, "blog/").otherwise("docs/")
    path = F.concat(folder, F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".html").otherwise(".md"))
    return derived(spark, sf_dir, "sentences").select(path.alias("path"), "text")


def _scan(spark, sf_dir):
    overrides = spark.createDataFrame([("vague_intensifier", "blog/*.md", "threshold", "2"), *[(c, None, "action", "block") for c in _INTENSE]], "check_id string, glob string, field string, value string")
    return routing.lint_routed(_scan_files(spark, sf_dir), _SCAN_RULES, overrides, {"prose": _only("prose", _INTENSE)})


def scan_routed(spark, sf_dir):
    """Path to rule, ruleset, disabled checks and thresholds, then the verdict of each file."""
    return _scan(spark, sf_dir)


def scan_counts(spark, sf_dir):
    return routing.routed_summary(_scan(spark, sf_dir))


_SCAN_CTE = f"""{_MERGED_SQL}, f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'vendor/' WHEN doc_id % 2 = 0 THEN 'blog/' ELSE 'docs/' END AS folder, CASE WHEN doc_id % 7 = 0 THEN '.html' ELSE '.md' END AS ext FROM docs),
    r AS (SELECT *, folder || doc_id || ext AS path, CASE WHEN folder = 'vendor/' THEN 0 WHEN ext <> '.md' THEN NULL WHEN folder = 'blog/' THEN 1 ELSE 2 END AS rule_ord FROM f),
    m AS (SELECT r.*, kind, bucket, label, n FROM r LEFT JOIN merged USING (doc_id) WHERE rule_ord > 0 AND NOT (rule_ord = 1 AND coalesce(kind, '') = 'stock_adverb') OR kind IS NULL),
    k AS (SELECT path, kind, sum(n) >= CASE WHEN rule_ord = 1 AND kind = 'vague_intensifier' THEN 2 ELSE 1 END AS b FROM m WHERE bucket = 'semantic' AND rule_ord > 0 GROUP BY path, kind, rule_ord),
    c AS (SELECT path, count(*) FILTER (bucket = 'semantic') AS semantic, count(*) FILTER (bucket = 'mechanical') AS mechanical FROM m WHERE rule_ord > 0 GROUP BY path), w AS (SELECT path, bool_or(b) AS would_block FROM k GROUP BY path),
    v AS (SELECT path, rule_ord, CASE WHEN rule_ord > 0 THEN 'prose' END AS ruleset, CASE WHEN rule_ord IS NULL OR rule_ord = 0 THEN 'out_of_scope' WHEN coalesce(semantic, 0) > 0 THEN 'semantic_flags' WHEN coalesce(mechanical, 0) > 0 THEN 'mechanical_violations' ELSE 'clean' END AS status,
        coalesce(semantic, 0)::BIGINT AS semantic, coalesce(mechanical, 0)::BIGINT AS mechanical, coalesce(would_block, false) AS would_block FROM r LEFT JOIN c USING (path) LEFT JOIN w USING (path))"""
_SCAN_COUNTS = "SELECT count(*) FILTER (status <> 'out_of_scope') AS scanned, count(*) FILTER (status = 'out_of_scope') AS out_of_scope, 0::BIGINT AS blank, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status IN ('semantic_flags', 'mechanical_violations') AND NOT would_block) AS with_notes, count(*) FILTER (would_block) AS failed FROM v"


def gate_documents(spark, sf_dir):
    """Weights and decisions of all prose checks on all documents."""
    return lint.gate_documents(_table(spark, sf_dir, "documents"), "prose")


def lint_rulesets_documents(spark, sf_dir):
    """Verdicts of all three rulesets, whole, on all documents, by path: a source's number chooses the ruleset."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".md"), F.lit(".py"), F.lit(".txt")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))).alias("path"), "text")
    return routing.lint_routed(docs, [{"glob": "*.txt", "ruleset": "controlled"}, *routing.DEFAULT_RULES])


_STATUS_SQL = f"""{_MERGED_SQL}, counts AS (SELECT doc_id, count(*) FILTER (bucket = 'semantic') AS semantic, count(*) FILTER (bucket = 'mechanical') AS mechanical FROM merged GROUP BY doc_id),
    blk AS (SELECT doc_id, bool_or(b) AS would_block FROM (SELECT doc_id, sum(n) >= CASE WHEN kind = 'vague_intensifier' THEN 2 ELSE 1 END AS b FROM merged WHERE bucket = 'semantic' GROUP BY doc_id, kind) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN coalesce(semantic, 0) > 0 THEN 'semantic_flags' WHEN coalesce(mechanical, 0) > 0 THEN 'mechanical_violations' ELSE 'clean' END AS status, coalesce(semantic, 0)::BIGINT AS semantic, coalesce(mechanical, 0)::BIGINT AS mechanical, coalesce(would_block, false) AS would_block FROM docs d LEFT JOIN counts USING (doc_id) LEFT JOIN blk USING (doc_id)"""


def lint_status_documents(spark, sf_dir):
    """Verdicts of all prose checks on all documents."""
    return lint.lint(_table(spark, sf_dir, "documents"), "prose")


def ratchet(spark, sf_dir):
    """The derived text of a part against that of the part before it."""
    docs = derived(spark, sf_dir, "sentences")
    pairs = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("after")).join(docs.select((F.col("doc_id") + 1).alias("path"), F.col("text").alias("before")).hint("merge"), "path", "left")
    rules = ruleset("prose")
    only = type(rules)("prose", tuple(c for c in rules.checks if c.id in _INTENSE), rules.whole, rules.lines, rules.keep_apart)
    return lint.ratchet(pairs, only, config=_strict(spark))


_RATCHET_SQL = f"""{_MERGED_SQL}, w AS (SELECT doc_id, sum(w) AS w FROM (SELECT doc_id, kind, sum(n) AS w FROM merged WHERE bucket = 'semantic' GROUP BY ALL HAVING sum(n) >= CASE WHEN kind = 'vague_intensifier' THEN 2 ELSE 1 END) GROUP BY doc_id),
    p AS (SELECT d.doc_id AS path, b.doc_id IS NULL AS fresh, coalesce(wb.w, 0)::BIGINT AS before_weight, coalesce(wa.w, 0)::BIGINT AS after_weight FROM docs d LEFT JOIN docs b ON b.doc_id = d.doc_id - 1 LEFT JOIN w wa ON wa.doc_id = d.doc_id LEFT JOIN w wb ON wb.doc_id = d.doc_id - 1)
    SELECT path, before_weight, after_weight, after_weight > 0 AND (fresh OR after_weight > before_weight) AS deny FROM p"""


# --- routing, terms, registry -----------------------------------------------------------------
def route_first_match(spark, sf_dir):
    return routing.route(_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "http/").alias("path")), ROUTES).select("page_id", "rule_ord", "ruleset")


_ROUTE_SQL = """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', 'http/') AS path FROM pages), r(ord, pat, rs) AS (VALUES (0, '(?s)^.*/fr/.*$', 'prose'), (1, '(?s)^.*page=.$', 'controlled'), (2, '(?s)^.*/en/.*$', NULL), (3, '(?s)^http.*[0-9]$', 'code'))
    SELECT page_id, min(ord)::INT AS rule_ord, arg_min_null(rs, ord) AS ruleset FROM p LEFT JOIN r ON regexp_matches(path, pat) GROUP BY page_id"""


_PACK_RULES = [{"glob": "*/fr/*", "ruleset": "prose", "packs": {"weasel_attribution": ["law"], "terminology": ["law", "web"]}}, {"glob": "*page=?", "ruleset": "controlled", "packs": {"project_terms": ["web"]}}, {"glob": "*/en/*", "ruleset": None}]


def packs_for_path(spark, sf_dir):
    """Packs that the first matching rule binds to each page, over all lists and for one."""
    paths = _table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "http/").alias("path"))
    out = config.packs_for_path(paths, _PACK_RULES).withColumnRenamed("packs", "every").drop("rule_ord")
    return config.packs_for_path(out, _PACK_RULES, "terminology").select("page_id", F.array_join("every", ",").alias("every"), F.array_join("packs", ",").alias("terminology"))


_PACKS_SQL = """WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', 'http/') AS path FROM pages) SELECT page_id, CASE WHEN path LIKE '%/fr/%' THEN 'law,web' WHEN path LIKE '%page=_' THEN 'web' ELSE '' END AS every, CASE WHEN path LIKE '%/fr/%' THEN 'law,web' ELSE '' END AS terminology FROM p"""


def _part_rules(spark, sf_dir):
    """A rule a part: odd ones carry what belongs to another ruleset."""
    n = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").select(n.cast("int").alias("ord"), F.concat(F.lit("*"), n.cast("string"), F.lit(".py")).alias("glob"), F.when(n % 4 != 3, F.element_at(F.array(F.lit("prose"), F.lit("code"), F.lit("controlled")), (n % 3 + 1).cast("int"))).alias("ruleset"), F.create_map(F.when(n % 2 == 0, "generic_naming").otherwise("terminology"), F.array("p_name")).alias("packs"), F.array(F.when(n % 2 == 0, "passive").otherwise("print_debug")).alias("disable"), F.when(n % 5 == 0, "controlled").alias("embedded_prose"))
    return part, check_table(spark), term_lists(spark)


def orphaned_extras(spark, sf_dir):
    found = config.orphaned_extras(*_part_rules(spark, sf_dir))
    return found.select("glob", F.array_join(F.map_keys("packs"), ",").alias("packs"), F.array_join("disable", ",").alias("disable"))


_PART_RULES_SQL = """WITH r AS (SELECT p_partkey AS n, '*' || p_partkey || '.py' AS "glob", CASE WHEN p_partkey % 4 <> 3 THEN (['prose', 'code', 'controlled'])[p_partkey % 3 + 1] END AS rs, CASE WHEN p_partkey % 2 = 0 THEN 'generic_naming' ELSE 'terminology' END AS pack, CASE WHEN p_partkey % 2 = 0 THEN 'passive' ELSE 'print_debug' END AS dis, p_partkey % 5 = 0 AS emb FROM part),
    j AS (SELECT *, (pack = 'generic_naming' AND rs = 'code') OR (pack = 'terminology' AND rs = 'prose') AS pack_fits, (dis = 'passive' AND (rs = 'controlled' OR emb)) OR (dis = 'print_debug' AND rs = 'code') AS dis_fits FROM r)"""
_ORPHANS_SQL = f"{_PART_RULES_SQL} SELECT \"glob\", CASE WHEN NOT pack_fits THEN pack END AS packs, CASE WHEN NOT dis_fits THEN dis END AS disable FROM j WHERE rs IS NOT NULL AND NOT (pack_fits AND dis_fits)"


def saved_rules(spark, sf_dir):
    """The part rules saved anew, every third with another ruleset and none with extras of its own."""
    old, checks, lists = _part_rules(spark, sf_dir)
    moved = F.when(F.col("ord") % 3 == 0, "code").otherwise(F.col("ruleset"))
    new = old.select("ord", "glob", moved.alias("ruleset"), F.lit(None).cast("map<string,array<string>>").alias("packs"), F.lit(None).cast("array<string>").alias("disable"), F.lit(None).cast("string").alias("embedded_prose"))
    return config.save_rules(new, old, checks, lists).select("glob", "ruleset", F.array_join(F.map_keys("packs"), ",").alias("packs"), F.array_join("disable", ",").alias("disable"), "embedded_prose")


_SAVED_SQL = """WITH r AS (SELECT p_partkey AS n, '*' || p_partkey || '.py' AS "glob", CASE WHEN p_partkey % 4 <> 3 THEN (['prose', 'code', 'controlled'])[p_partkey % 3 + 1] END AS was, CASE WHEN p_partkey % 2 = 0 THEN 'generic_naming' ELSE 'terminology' END AS pack, CASE WHEN p_partkey % 2 = 0 THEN 'passive' ELSE 'print_debug' END AS dis, CASE WHEN p_partkey % 5 = 0 THEN 'controlled' END AS emb FROM part),
    m AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'code' ELSE was END AS rs FROM r), j AS (SELECT *, rs IS NOT DISTINCT FROM was AS same, (pack = 'generic_naming' AND rs = 'code') OR (pack = 'terminology' AND rs = 'prose') AS pack_fits, (dis = 'passive' AND (rs = 'controlled' OR emb IS NOT NULL)) OR (dis = 'print_debug' AND rs = 'code') AS dis_fits FROM m)
    SELECT "glob", rs AS ruleset, CASE WHEN same OR pack_fits THEN pack END AS packs, CASE WHEN same OR dis_fits THEN dis END AS disable, emb AS embedded_prose FROM j"""


def enablement(spark, sf_dir):
    """Replace against merge: what each leaves on, by check."""
    every = check_table(spark)
    merge = config.enable(config.enable_exactly(every, ["passive", "modal", "print_debug"]), {"modal": False, "filler_verb": True})
    return merge.filter("enabled").select("ruleset", "check_id")


_ENABLED_SQL = "SELECT * FROM (VALUES ('controlled', 'passive'), ('code', 'print_debug'), ('prose', 'filler_verb')) t(ruleset, check_id)"


def custom_feeds(spark, sf_dir):
    """Terms in force by check, where a list of one's own feeds a check besides the built-in lists."""
    lists = config.add_term_list(term_lists(spark), "prose", "house_style", feeds="terminology")
    own = _table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(F.lit("prose").alias("ruleset"), F.lit("house_style").alias("list_id"), F.lower("p_name").alias("term"))
    fed = config.extra_by_check(own.unionByName(own.withColumn("list_id", F.lit("unread"))), lists)
    return fed.select("ruleset", "check_id", F.size("terms").alias("terms"))


_FEEDS_SQL = "SELECT 'prose' AS ruleset, 'terminology' AS check_id, count(DISTINCT lower(p_name))::INT AS terms FROM part WHERE p_partkey % 10 = 0"


def _layers(spark, sf_dir):
    """A vocabulary made of the parts' names: types are lists, brands packs."""
    part = _table(spark, sf_dir, "part").withColumn("term", F.lower("p_name"))
    layer = F.element_at(F.array(F.lit("built_in"), F.lit("pack"), F.lit("project")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select(F.lit("prose").alias("ruleset"), F.col("p_type").alias("list_id"), "term", layer.alias("layer"), F.when(layer == "pack", F.col("p_brand")).alias("pack"), F.lit(None).cast("string").alias("note"), (F.col("p_partkey") % 17 == 0).alias("removed"))


def terms_resolve(spark, sf_dir):
    resolved = terms.resolve(_layers(spark, sf_dir))
    return resolved.select("ruleset", "list_id", "term", "layer", "pack", "state")


_TERMS_CTE = """WITH l AS (SELECT 'prose' AS ruleset, p_type AS list_id, lower(p_name) AS term, ['built_in', 'pack', 'project'][p_partkey % 3 + 1] AS layer, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS pack, p_partkey % 17 = 0 AS removed FROM part),
    live AS (SELECT *, row_number() OVER (PARTITION BY list_id, term ORDER BY CASE layer WHEN 'project' THEN 3 WHEN 'pack' THEN 2 ELSE 1 END DESC, pack NULLS FIRST) AS n FROM l WHERE NOT removed),
    gone AS (SELECT DISTINCT list_id, term FROM l WHERE removed),
    res AS (SELECT ruleset, live.list_id, live.term, layer, pack, CASE WHEN gone.term IS NOT NULL THEN 'suppressed' ELSE 'effective' END AS state FROM live LEFT JOIN gone ON gone.list_id = live.list_id AND gone.term = live.term WHERE n = 1)"""


def term_layer_counts(spark, sf_dir):
    rows = _layers(spark, sf_dir)
    return terms.layer_counts(rows, terms.resolve(rows))


_LAYER_SQL = f"""{_TERMS_CTE}, raw AS (SELECT ruleset, list_id, count(DISTINCT term) FILTER (layer = 'built_in') AS built_in, count(DISTINCT term) FILTER (layer = 'pack') AS packs, count(DISTINCT term) FILTER (layer = 'project') AS project FROM l WHERE NOT removed GROUP BY ALL),
    st AS (SELECT list_id, count(*) FILTER (state = 'suppressed') AS suppressed, count(*) FILTER (state = 'effective') AS effective FROM res GROUP BY ALL)
    SELECT ruleset, raw.list_id, built_in, packs, project, coalesce(suppressed, 0)::BIGINT AS suppressed, coalesce(effective, 0)::BIGINT AS effective FROM raw LEFT JOIN st ON st.list_id = raw.list_id"""


def check_dimension(spark, sf_dir):
    return check_table(spark).select("ruleset", "check_id", "ord", "unit", "kind", "bucket", "threshold", "action")


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else O.q(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_DIM_SQL = "SELECT * FROM (VALUES " + _values([(r, c.id, i, c.unit, c.kind, c.bucket_name, c.threshold, c.action) for r in rulesets() for i, c in enumerate(ruleset(r).checks)]) + ") t(ruleset, check_id, ord, unit, kind, bucket, threshold, action)"


def complement_checks(spark, sf_dir):
    return routing.complement(check_table(spark)).select("ruleset", "check_id")


def remedies(spark, sf_dir):
    return terms.remedies(check_table(spark), term_lists(spark)).select("ruleset", "check_id", "list_id", "polarity")


def built_in_vocabulary(spark, sf_dir):
    return terms.resolve(built_in_terms(spark)).groupBy("ruleset", "list_id").agg(F.count("*").alias("terms"))


# --- event log -----------------------------------------------------------------------------------
def _events(spark, sf_dir):
    """The events as logs of a thousand decisions each."""
    e = _table(spark, sf_dir, "events")
    action = F.element_at(F.array(F.lit("deny"), F.lit("deny"), F.lit("auto_fix"), F.lit("clean")), (F.floor(F.col("event_id") / 3) % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 0.9).alias("ts"), action.alias("action"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("f"), (F.col("event_id") / 4).cast("long").cast("string"))).alias("file"), F.array("event_type").alias("kinds"), F.lit("prose").alias("ruleset"), F.floor(F.col("event_id") / 1000).alias("log"))


_EVENTS = """WITH e AS (SELECT event_id AS seq, event_id * 0.9::DOUBLE AS ts, ['deny', 'deny', 'auto_fix', 'clean'][(event_id // 3) % 4 + 1] AS action, CASE WHEN user_id % 5 <> 0 THEN 'f' || (event_id // 4) END AS file, event_type AS kind, event_id // 1000 AS log FROM events)"""
_DEDUPED = f"{_EVENTS}, l AS (SELECT *, lag(file) OVER w AS pf, lag(action) OVER w AS pa, lag(ts) OVER w AS pt FROM e WINDOW w AS (PARTITION BY log ORDER BY seq)), d AS (SELECT * FROM l WHERE NOT coalesce(file = pf AND action = pa AND ts - pt < 2.0, false))"


def double_fire(spark, sf_dir):
    return history.dedupe_double_fire(_events(spark, sf_dir), ("log",)).select("seq", "action", "file")


def deny_streak(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("file", F.concat(F.lit("g"), (F.col("seq") % 7).cast("string")))
    return history.deny_streaks(e)


_STREAK_SQL = f"{_EVENTS}, g AS (SELECT seq, action, 'g' || (seq % 7) AS file FROM e), o AS (SELECT file, max(seq) FILTER (action <> 'deny') AS m FROM g GROUP BY file) SELECT g.file, count(*) FILTER (action = 'deny' AND seq > coalesce(m, -1)) AS streak, count(*) FILTER (action = 'deny' AND seq > coalesce(m, -1)) >= 3 AS capped FROM g JOIN o ON g.file = o.file GROUP BY g.file"


def recent_deny(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("seq") * 37.0)
    return history.recent_deny(e, ("log",)).groupBy("log", "nearby_deny").agg(F.count("*").alias("events"))


_RECENT_SQL = f"{_EVENTS}, w AS (SELECT log, coalesce(seq * 37.0 - max(CASE WHEN action = 'deny' THEN seq * 37.0 END) OVER (PARTITION BY log ORDER BY seq ROWS 19 PRECEDING) < 300, false) AS nearby_deny FROM e) SELECT log, nearby_deny, count(*) AS events FROM w GROUP BY ALL"


def _kinds(spark):
    return spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view", "never")], "check_id string")


def hit_counts(spark, sf_dir):
    e = history.dedupe_double_fire(_events(spark, sf_dir), ("log",))
    return history.hit_counts(e, _kinds(spark))


_HITS_SQL = f"{_DEDUPED} SELECT k AS check_id, count(kind) AS hits, max(ts) AS last_fired, (SELECT count(*) FROM d) AS gate_events FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('never')) v(k) LEFT JOIN d ON kind = k GROUP BY k"


def never_fired(spark, sf_dir):
    return history.never_fired(hit_counts(spark, sf_dir))


def status_counts(spark, sf_dir):
    return history.status_counts(_events(spark, sf_dir))


def top_kinds(spark, sf_dir):
    return history.top_kinds(_events(spark, sf_dir))


def feed(spark, sf_dir):
    return history.feed(_events(spark, sf_dir), 100_000.0, action="deny").select("seq", "file", "ago")


_FEED_SQL = f"{_EVENTS}, n AS (SELECT seq, file, 100000.0 - ts AS s FROM e WHERE action = 'deny' ORDER BY seq DESC LIMIT 50) SELECT seq, file, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN trunc(s / 60)::INT || 'm ago' WHEN s < 86400 THEN trunc(s / 3600)::INT || 'h ago' ELSE trunc(s / 86400)::INT || 'd ago' END AS ago FROM n"


# --- experiments --------------------------------------------------------------------------------
def _arms(spark, sf_dir):
    """Conversations as arms: the role is the arm, words of the first two turns the score."""
    c = _table(spark, sf_dir, "conversations").filter("turn < 2")
    return c.select(F.lit("r").alias("run"), F.col("conv_id").alias("prompt_id"), F.col("role").alias("arm"), structure.blank_words(F.col("text")).cast("long").alias("score"))


_ARMS = "WITH arms AS (SELECT 'r' AS run, conv_id AS prompt_id, role AS arm, len(regexp_extract_all(text, '\\S+')) AS score FROM conversations WHERE turn < 2)"
_PAIRS = f"{_ARMS}, p AS (SELECT a.score::DOUBLE AS a, b.score::DOUBLE AS b FROM arms a JOIN arms b ON a.prompt_id = b.prompt_id AND a.arm = 'user' AND b.arm = 'assistant')"


def sign_test(spark, sf_dir):
    out = experiment.sign_test(experiment.paired(_arms(spark, sf_dir), "user", "assistant", "score"))
    return out.select("run", "wins", "losses", "ties", F.round("p", 9).alias("p"))


_SIGN_SQL = f"""{_PAIRS}, c AS (SELECT count(*) FILTER (a < b) AS wins, count(*) FILTER (a > b) AS losses, count(*) FILTER (a = b) AS ties FROM p),
    t AS (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2.0))) AS s FROM c, unnest(range(0, least(wins, losses) + 1)) u(k))
    SELECT 'r' AS run, wins, losses, ties, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * s) END, 9) AS p FROM c, t"""


def leaderboard(spark, sf_dir):
    return experiment.leaderboard(_arms(spark, sf_dir), "score")


_BOARD_SQL = f"{_ARMS}, g AS (SELECT arm, count(*) AS prompts, sum(score)::DOUBLE AS total, avg(score) AS mean FROM arms GROUP BY arm) SELECT *, row_number() OVER (ORDER BY total, arm)::INT AS rank FROM g"


def _arms_whole(spark, sf_dir):
    """Conversations as arms: the role is the arm, words of all its turns the score; one row a conversation and role."""
    words = structure.blank_words(F.coalesce("text", F.lit(""))).cast("long")
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.sum(words).alias("score"))
    return c.select(F.lit("r").alias("run"), F.col("conv_id").alias("prompt_id"), F.col("role").alias("arm"), "score")


_ARMS_WHOLE = """WITH arms AS (SELECT 'r' AS run, conv_id AS prompt_id, role AS arm,
    sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS score FROM conversations GROUP BY ALL)"""
#: The same SQL over all turns.
_SIGN_WHOLE_SQL, _BOARD_WHOLE_SQL = (sql.replace(_ARMS, _ARMS_WHOLE) for sql in (_SIGN_SQL, _BOARD_SQL))


def sign_test_whole(spark, sf_dir):
    return experiment.sign_test(experiment.paired(_arms_whole(spark, sf_dir), "user", "assistant", "score")).select("run", "wins", "losses", "ties", F.round("p", 9).alias("p"))


def leaderboard_whole(spark, sf_dir):
    return experiment.leaderboard(_arms_whole(spark, sf_dir), "score")


def drift_by_turn(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("role").alias("arm"), "turn", structure.blank_words(F.col("text")).alias("total"))
    return experiment.drift(c)


_DRIFT_SQL = "WITH g AS (SELECT role AS arm, turn, sum(len(regexp_extract_all(text, '\\S+')))::DOUBLE AS total, count(*) AS prompts FROM conversations GROUP BY ALL) SELECT *, total - first_value(total) OVER (PARTITION BY arm ORDER BY turn) AS change FROM g"


def arm_changes(spark, sf_dir):
    """Each role's mean words against the users', the system's turns standing for the second sample."""
    out = arms.changes(_arms_whole(spark, sf_dir), "score", "user", "system")
    return out.select("arm", F.round("mean", 6).alias("mean"), F.round("change", 6).alias("change"), "percent", "direction", F.round("noise_floor", 6).alias("noise_floor"), "finding")


_CHANGES_SQL = """WITH w AS (SELECT conv_id, role, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS score FROM conversations GROUP BY ALL), m AS (SELECT role AS arm, avg(score) AS mean FROM w GROUP BY role),
    b AS (SELECT max(mean) FILTER (arm = 'user') AS base, max(mean) FILTER (arm = 'system') AS control FROM m)
    SELECT arm, round(mean, 6) AS mean, round(mean - base, 6) AS change, round((mean - base) * 100 / base) AS percent, CASE WHEN abs(mean - base) < 1e-9 THEN 'no change' WHEN mean < base THEN 'better' ELSE 'WORSE' END AS direction, round(abs(control - base), 6) AS noise_floor, abs(mean - base) > abs(control - base) AS finding FROM m, b WHERE arm <> 'user'"""


def bootstrap_ci(spark, sf_dir):
    return experiment.bootstrap(experiment.paired(_arms_whole(spark, sf_dir), "user", "assistant", "score"))


def replay_join(spark, sf_dir):
    """Requests that repeat a digest take its recordings in turn; how many are found and missed."""
    e = _table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("call_seq"), F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")).alias("digest"))
    recorded = spark.range(50).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("occurrence")).withColumn("output", F.concat_ws("/", "digest", F.col("occurrence").cast("string")))
    hits, misses = experiment.replay(requests, recorded)
    return hits.groupBy("digest").agg(F.count("*").alias("found")).join(misses.groupBy("digest").agg(F.count("*").alias("missed")), "digest", "left").fillna(0, ["missed"])


_REPLAY_SQL = "WITH r AS (SELECT 'd' || (user_id % 50) AS digest, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) - 1 AS o FROM events) SELECT digest, count(*) FILTER (o < 10) AS found, count(*) FILTER (o >= 10) AS missed FROM r GROUP BY digest"


# --- fixes, code, commands, imports -----------------------------------------------------------------
def fix_prose(spark, sf_dir):
    docs = structure.with_units(derived(spark, sf_dir, "sentences"))
    fixed = docs.withColumn("s", F.transform("sentences", lambda s: fix.fix_prose_sentence(s["sentence"])))
    return fixed.select("doc_id", F.array_join("s", " ").alias("fixed"))


_ADVERB = "(?i)(,\\s*)?\\b(" + O._longest(prose.STOCK_ADVERBS) + ")\\b(,\\s*|\\s+)?"
_FIX_SQL = f"""{O.SENTS}, a AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, {O.q(_ADVERB)}, ' ', 'g'), {O.q(prose.EM_DASH_ENTITY)}, '—', 'g'), {O.q(prose.SECTION_ENTITY)}, 'section', 'g'), {O.q(prose.MIDDOT_ENTITY)}, ',', 'g'), {O.q(prose.EMOJI)}, '', 'g') AS t FROM sents),
    b AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(t, '\\s{{2,}}', ' ', 'g')), '\\s+([.,!?])', '\\1', 'g') AS t FROM a)
    SELECT doc_id, string_agg(upper(substr(t, 1, 1)) || substr(t, 2), ' ' ORDER BY i) AS fixed FROM b GROUP BY doc_id"""


def fix_documents(spark, sf_dir):
    """The prose fixes on all documents, block by block."""
    return fix.fix(_table(spark, sf_dir, "documents")).select("doc_id", F.sha2("fixed", 256).alias("fixed_sha256"), F.length("fixed").alias("characters"))


def fix_controlled(spark, sf_dir):
    return fix.fix(derived(spark, sf_dir, "sentences"), "controlled").select("doc_id", "fixed")


def prose_segments(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit('"""About the part '), "p_name", F.lit('."""\nx = "too short"\ny = f"the {x} price of the '), "p_name", F.lit('"\n')).alias("text"))
    return literals.prose_segments(files)


def embedded_prose(spark, sf_dir):
    files = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit('"""This is a very robust '), "p_name", F.lit('."""\ny = f"Needless to say the '), "p_name", F.lit(' is amazing"\n')).alias("text"))
    return embedded.embedded_flags(files).select("path", "kind", "label", "embedded_line")


_SEGMENTS_SQL = "SELECT p_partkey AS path, 1 AS line, 0 AS ord, 'About the part ' || p_name || '.' AS segment FROM part UNION ALL SELECT p_partkey, 3, 1, 'the X price of the ' || p_name FROM part"
_EMBEDDED_SQL = "SELECT p_partkey AS path, kind, label, embedded_line FROM part, (VALUES ('vague_intensifier', 'very', 1), ('marketing_adjective', 'robust', 1), ('filler_opener', 'Needless to say', 2), ('marketing_cliche', 'amazing', 2)) t(kind, label, embedded_line)"


def admissible_packs(spark, sf_dir):
    """Packs by kind, a part each, against the lists of all rulesets: how many each list can read."""
    kind = F.element_at(F.array(F.lit("word"), F.lit("phrase"), F.lit("pattern"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    packs = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("pack_id"), kind.alias("content_kind"))
    return terms.admissible(term_lists(spark), packs).groupBy("ruleset", "list_id").agg(F.count("*").alias("packs"))


_ADMISSIBLE_SQL = f"""WITH lists(ruleset, list_id, kind) AS (VALUES ('prose', 'weasel_attribution', 'phrase'), ('prose', 'marketing_adjective', 'word'), ('prose', 'filler_verb', 'pattern'), ('prose', 'marketing_cliche', 'phrase'), ('prose', 'stock_adverb', 'word'), ('prose', 'copula_avoidance', 'phrase'), ('prose', 'section_template', 'phrase'), ('prose', 'terminology', 'word'), ('code', 'generic_naming', 'word'), ('controlled', 'project_terms', 'word')),
    p AS (SELECT (['word', 'phrase', 'pattern', NULL])[p_partkey % 4 + 1] AS kind FROM part) SELECT ruleset, list_id, count(*) AS packs FROM lists l JOIN p ON p.kind IS NULL OR p.kind = l.kind GROUP BY ALL"""


def shell_writes(spark, sf_dir):
    c = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("cat > notes.md <<'EOF'\nThe "), "p_name", F.lit("\nEOF\n")).alias("command"))
    return shell.shell_writes(c).select("p_partkey", "target", "text")


_SHELL_SQL = "SELECT p_partkey, 'notes.md' AS target, 'The ' || p_name || chr(10) AS text FROM part"
_STYLE = "extends: substitution\nmessage: Use the plain word\nlevel: error\nignorecase: true\nswap:\n  robust: strong\n  \"late\": delayed\n"


def import_rules(spark, sf_dir):
    checks, _ = rule_import.import_rules([("Plain.Words", _STYLE)], spark)
    rules = ruleset("prose").with_checks(tuple(checks))
    found = lint.flags(derived(spark, sf_dir, "sentences"), rules, disabled=[c.id for c in ruleset("prose").checks])
    return found.groupBy("doc_id", "label", "replacement").agg(F.count("*").alias("hits"))


_IMPORT_SQL = f"{O.SENTS}, h AS (SELECT doc_id, regexp_extract(s, '(?i)\\b(?:robust|late)\\b') AS label FROM sents WHERE regexp_matches(s, '(?i)\\b(?:robust|late)\\b')) SELECT doc_id, label, CASE lower(label) WHEN 'robust' THEN 'strong' ELSE 'delayed' END AS replacement, count(*) AS hits FROM h GROUP BY ALL"

_QUERIES = {f.__name__: f for f in (activity_by_lang, flag_share, compare_quality, consensus_quality, calibration, kind_counts, activity_whole, flag_share_whole, compare_quality_whole, consensus_quality_whole, calibration_whole, kind_counts_whole, manifest, sentence_split, word_counts, text_shape, text_shape_documents, blocks, html_paragraphs, html_paragraphs_nested, vocabulary_join, dedup_flags, dedup_rows, gate_decision, gate_merged, lint_status, verdicts_merged, lint_status_documents, gate_documents, lint_rulesets_documents, scan_routed, scan_counts, packs_for_path, orphaned_extras, saved_rules, enablement, custom_feeds, ratchet, route_first_match, terms_resolve, term_layer_counts, check_dimension, complement_checks, remedies, built_in_vocabulary, double_fire, deny_streak, recent_deny, hit_counts, never_fired, status_counts, top_kinds, feed, sign_test, leaderboard, sign_test_whole, leaderboard_whole, drift_by_turn, arm_changes, bootstrap_ci, replay_join, fix_prose, fix_documents, fix_controlled, prose_segments, embedded_prose, admissible_packs, shell_writes, import_rules)}


def queries():
    out = _QUERIES | catalogue_flow.queries() | catalogue_runs.queries()
    for r in rulesets():
        out.update({f"check_{c.id}": partial(check_query, rules=r, check=c.id) for c in ruleset(r).checks if c.id != "vocabulary"})
    return out | {f"check_{c}_documents": partial(check_documents, rules=r, check=c) for r, c in _HEARD}


def oracle_sql():
    out = {f"check_{k}": v for k, v in O.CHECKS.items()} | catalogue_flow.oracle_sql() | catalogue_runs.oracle_sql()
    return out | {
        "activity_by_lang": _ACTIVITY_SQL, "flag_share": _SHARE_SQL, "compare_quality": f"{_COMPARED} SELECT * FROM cmp", "consensus_quality": f"{_COMPARED} {_CONSENSUS}", "calibration": f"{_COMPARED} {_CALIBRATION}",
        "kind_counts": f"WITH docs AS (SELECT doc_id, text FROM documents WHERE lang = 'en'), {_sentences_cte()} SELECT k AS kind, count(*) AS flags FROM merged GROUP BY k", "manifest": _MANIFEST_SQL,
        "sentence_split": _SENTENCE_SQL, "word_counts": _WORDS_SQL, "text_shape": _SHAPE_SQL, "blocks": _BLOCKS_SQL, "html_paragraphs": _HTML_SQL, "vocabulary_join": _VOCABULARY_SQL,
        "dedup_rows": f"{_MERGED_SQL} SELECT doc_id, kind, bucket, label, n FROM merged", "gate_merged": _GATE_SQL, "verdicts_merged": _STATUS_SQL, "scan_routed": f"{_SCAN_CTE} SELECT * FROM v", "scan_counts": f"{_SCAN_CTE} {_SCAN_COUNTS}",
        "packs_for_path": _PACKS_SQL, "orphaned_extras": _ORPHANS_SQL, "saved_rules": _SAVED_SQL, "enablement": _ENABLED_SQL, "custom_feeds": _FEEDS_SQL,
        "dedup_flags": f"{_MERGED_SQL} SELECT doc_id, kind, bucket, label, n FROM merged", "gate_decision": _GATE_SQL, "lint_status": _STATUS_SQL, "ratchet": _RATCHET_SQL, "route_first_match": _ROUTE_SQL,
        "terms_resolve": f"{_TERMS_CTE} SELECT * FROM res", "term_layer_counts": _LAYER_SQL, "check_dimension": _DIM_SQL, "complement_checks": f"SELECT ruleset, check_id FROM ({_DIM_SQL}) WHERE action <> 'block'",
        "remedies": "SELECT * FROM (VALUES " + _values([(r, f, l, p) for r, l, f, _, p, _, _ in TERM_LISTS]) + ") t(ruleset, check_id, list_id, polarity)",
        "double_fire": f"{_DEDUPED} SELECT seq, action, file FROM d", "deny_streak": _STREAK_SQL, "recent_deny": _RECENT_SQL, "hit_counts": _HITS_SQL, "never_fired": f"SELECT check_id FROM ({_HITS_SQL}) WHERE hits = 0 AND gate_events >= 25",
        "status_counts": f"{_EVENTS} SELECT action, count(*) AS events FROM e GROUP BY action", "top_kinds": f"{_EVENTS} SELECT kind, count(*) AS hits, min(seq) AS first_seq FROM e GROUP BY kind ORDER BY hits DESC, first_seq LIMIT 5", "feed": _FEED_SQL,
        "sign_test": _SIGN_SQL, "leaderboard": _BOARD_SQL, "sign_test_whole": _SIGN_WHOLE_SQL, "leaderboard_whole": _BOARD_WHOLE_SQL, "arm_changes": _CHANGES_SQL, "drift_by_turn": _DRIFT_SQL, "replay_join": _REPLAY_SQL, "fix_prose": _FIX_SQL, "shell_writes": _SHELL_SQL, "prose_segments": _SEGMENTS_SQL, "embedded_prose": _EMBEDDED_SQL, "admissible_packs": _ADMISSIBLE_SQL, "import_rules": _IMPORT_SQL,
    }
