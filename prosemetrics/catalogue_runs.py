"""Queries of rulesets kept as rows, of whole runs and their reports, of resampling, manifests and glossaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .checks import controlled, prose
from .operators import corpus, experiment, glossary, lint, report, runs, structure
from .plans import oracles as O
from .plans import stored
from .plans.derived import derived, derived_sql
from .plans.registry import ruleset
from .plans.shared import new_folder


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- a ruleset that is a table ----------------------------------------------------------
_FIXED_ROWS = (
    ("late", 100, "SENTENCE", "words", None, ["late", "fine"], None, "mechanical", 1, "warn"),
    ("nots", 101, "SENTENCE", "repeated", r"\bis\b", None, 2, "semantic", 2, "block"),
    ("opens", 102, "SENTENCE", "opening", None, ["we", "the", "it is"], None, "semantic", 1, "warn"),
    ("wordy", 103, "SENTENCE", "longer", None, None, 12, "semantic", 1, "warn"),
    ("unsold", 104, "DOCUMENT", "missing", "s[oe]l[dl]", None, None, "semantic", 1, "warn"),
    ("broken", 105, "SENTENCE", "pattern", "(never", None, None, "semantic", 1, "block"),
)


def stored_rows(spark, sf_dir):
    """Rules of a stock: a check for each type of part, whose terms are the names of its larger parts, and some that are written out."""
    parts = _table(spark, sf_dir, "part").filter("p_size > 40")
    name = F.concat(F.lit("of_"), F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_")))
    terms = F.array_sort(F.collect_set(F.lower("p_name")))  # the names of a catalogue, some dozens a type
    by_type = parts.groupBy(name.alias("check_id")).agg(terms.alias("terms"))
    order = "check_id string, ord int, unit string, finder string, pattern string, terms array<string>, least int, bucket string, threshold int, action string"
    fixed = spark.createDataFrame([*_FIXED_ROWS], order)
    words = {"ord": F.lit(1), "unit": F.lit("SENTENCE"), "finder": F.lit("words"), "threshold": F.lit(2), "action": F.lit("block")}
    return by_type.withColumns(words).unionByName(fixed, allowMissingColumns=True).withColumns({"ruleset": F.lit("stock"), "note": F.lit("say the number")})


def stored_verdicts(spark, sf_dir):
    """Verdicts of that ruleset on the derived sentences; its broken row is put aside."""
    made, refused = stored.compile_rows(stored_rows(spark, sf_dir))
    assert [r["check_id"] for r in refused] == ["broken"]
    return lint.lint(derived(spark, sf_dir, "sentences"), made["stock"])


_STORED = f"""{O.SENTS}, per_type AS (SELECT 'of_' || lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) AS kind, lower(p_name) AS term FROM part WHERE p_size > 40 GROUP BY ALL),
    raw AS (
        SELECT doc_id, kind, true AS counts, lower(term) AS label, len(regexp_extract_all(lower(s), '\\b' || term || '\\b')) AS n FROM sents, per_type WHERE contains(lower(s), term)
        UNION ALL SELECT doc_id, 'late', false, unnest(regexp_extract_all(lower(s), '\\b(?:late|fine)\\b')), 1 FROM sents
        UNION ALL SELECT doc_id, 'nots', true, NULL, len(regexp_extract_all(lower(s), '\\bis\\b')) FROM sents WHERE len(regexp_extract_all(lower(s), '\\bis\\b')) >= 2
        UNION ALL SELECT doc_id, 'opens', true, regexp_extract(lower(s), '^\\s*(it is|the|we)\\b', 1), 1 FROM sents WHERE regexp_matches(lower(s), '^\\s*(?:it is|the|we)\\b')
        UNION ALL SELECT doc_id, 'wordy', true, NULL, 1 FROM sents WHERE len(regexp_extract_all(s, '\\S+')) > 12
        UNION ALL SELECT doc_id, 'unsold', true, NULL, 1 FROM docs WHERE NOT regexp_matches(lower(text), 's[oe]l[dl]')),
    per AS (SELECT doc_id, kind, counts, sum(n) AS weight, count(DISTINCT label) + count(*) FILTER (label IS NULL) AS merged FROM raw WHERE n > 0 GROUP BY ALL),
    v AS (SELECT d.doc_id, coalesce(sum(merged) FILTER (counts), 0)::BIGINT AS semantic, coalesce(sum(merged) FILTER (NOT counts), 0)::BIGINT AS mechanical,
            coalesce(bool_or(counts AND weight >= 2 AND (kind = 'nots' OR starts_with(kind, 'of_'))), false) AS would_block
        FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id GROUP BY d.doc_id)
    SELECT doc_id, CASE WHEN semantic > 0 THEN 'semantic_flags' WHEN mechanical > 0 THEN 'mechanical_violations' ELSE 'clean' END AS status, semantic, mechanical, would_block FROM v"""


# --- a whole run ---------------------------------------------------------------------------
_TOLD = {"plain": "Write plainly. "}
_VAGUE = O._longest(prose.VAGUE_INTENSIFIERS)


def _echo(calls):
    """A generator that writes what it is asked, and at a request for a revision leaves out the first vague word of its text."""
    last = F.element_at("messages", -1)["content"]
    text = F.get("messages", F.size("messages") - 2)["content"]
    fewer = F.regexp_replace(text, rf"(?is)^(.*?)\b(?:{_VAGUE})\b", "$1")
    return calls.select("call_id", F.when(F.size("messages") == 1, last).when(last.startswith("Revise"), fewer).otherwise(text).alias("text"))


def whole_run(spark, sf_dir):
    """Six arms over a prompt for each part: what each ends with. The gate is on vague words; a judge sees marketing words too."""
    prompts = derived(spark, sf_dir, "sentences").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))
    off = [c.id for c in ruleset("prose").checks if c.id not in ("vague_intensifier", "marketing_adjective")]
    judge = runs.lint_judge("prose", ["vague_intensifier"], disabled=off)
    out = runs.run(prompts, _echo, judge, new_folder(spark), instructions=_TOLD, combined=("plain",))
    return out.select("arm", F.col("prompt_id").cast("long").alias("prompt_id"), "iterations", "passed", "flags", "total", F.md5("text").alias("text_md5"))


def _found(words, text="text") -> str:
    return f"list_transform(regexp_extract_all({text}, {O.q('(?i)' + chr(92) + 'b(' + O._longest(words) + ')' + chr(92) + 'b')}, 1), lambda x: lower(x))"


def _without_first(text: str, times: str) -> str:
    once = lambda t: f"regexp_replace({t}, {O.q('(?i)' + chr(92) + 'b(?:' + _VAGUE + ')' + chr(92) + 'b')}, '')"
    return f"CASE {times} WHEN 0 THEN {text} WHEN 1 THEN {once(text)} WHEN 2 THEN {once(once(text))} ELSE {once(once(once(text)))} END"


_RUN = f"""WITH prompts AS ({derived_sql('sentences')}),
    arms(arm, gated, told) AS (VALUES ('ungated', false, ''), ('control', false, ''), ('plain', false, 'Write plainly. '), ('gated', true, ''), ('plain+gated', true, 'Write plainly. '), ('blind', false, '')),
    opened AS (SELECT arm, gated, doc_id AS prompt_id, told || text AS text, least(3, len({_found(prose.VAGUE_INTENSIFIERS)}))::INT AS revisions FROM prompts, arms),
    ended AS (SELECT arm, gated, prompt_id, revisions, CASE WHEN gated THEN {_without_first('text', 'revisions')} ELSE text END AS text FROM opened),
    scored AS (SELECT *, len(list_distinct({_found(prose.VAGUE_INTENSIFIERS)})) AS flags, len(list_distinct({_found(prose.MARKETING_ADJECTIVES)})) AS more FROM ended)
    SELECT arm, prompt_id, CASE WHEN gated OR arm = 'blind' THEN 1 + revisions ELSE 1 END::INT AS iterations, CASE WHEN gated THEN flags = 0 END AS passed,
        flags::BIGINT AS flags, (flags + more)::BIGINT AS total, md5(text) AS text_md5 FROM scored"""


# --- reports ---------------------------------------------------------------------------------
def _report_rows(spark, sf_dir):
    """Conversations as a run: the role is the arm; each of its turns, and all of them together as the end."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.coalesce("text", F.lit("")).alias("text"))
    scored = c.select(
        F.col("conv_id").alias("prompt_id"), F.col("role").alias("arm"), "turn", structure.blank_words(F.col("text")).cast("long").alias("words"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("enforced_flags"), F.regexp_count("text", F.lit("[,;]")).cast("long").alias("held_out_flags"),
    )
    ends = scored.groupBy("prompt_id", "arm").agg(F.count("*").alias("iterations"), *[F.sum(m).alias(m) for m in ("words", "enforced_flags", "held_out_flags")])
    ends = ends.withColumns({"turn": F.lit(None).cast("int"), "passed": F.col("enforced_flags") == 0})
    return scored.groupBy("prompt_id", "arm", "turn").agg(*[F.sum(m).alias(m) for m in ("words", "enforced_flags", "held_out_flags")]).unionByName(ends, allowMissingColumns=True)


def _totals(spark, sf_dir):
    return report.totals(_report_rows(spark, sf_dir), gated="assistant")


def report_totals(spark, sf_dir):
    """Totals of the roles over all conversations, over those in which the assistant spoke more than once, and by turn."""
    return _totals(spark, sf_dir).select("scope", "arm", "turn", "prompts", F.round("generations", 6).alias("generations"), "passed", "revised", "words", "enforced_flags", "held_out_flags", F.round("mean_words", 6).alias("mean_words"))


def report_comparison(spark, sf_dir):
    """The assistant's means against the user's, with the system's as the second sample."""
    metrics = {"words": False, "enforced_flags": True, "held_out_flags": True}
    out = report.comparison(_totals(spark, sf_dir), metrics, ("user", "system", "assistant"), "user", "assistant", "system")
    return out.select("scope", "metric", *[F.round(c, 6).alias(c) for c in ("user", "system", "assistant", "change")], "percent", "direction", F.round("noise", 6).alias("noise"), "finding")


def report_board(spark, sf_dir):
    return report.board(_totals(spark, sf_dir), "words", "user").withColumn("generations", F.round("generations", 6))


def report_drift(spark, sf_dir):
    return report.drift_table(_totals(spark, sf_dir), "words").select("arm", F.size("turns").alias("turns"), F.element_at("turns", -1).alias("last"), "change")


_TOTALS = """WITH scored AS (SELECT conv_id AS prompt_id, role AS arm, turn, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS words, sum(len(regexp_extract_all(coalesce(text, ''), '[!?]'))) AS enforced_flags,
        sum(len(regexp_extract_all(coalesce(text, ''), '[,;]'))) AS held_out_flags, count(*) AS n FROM conversations GROUP BY ALL),
    ends AS (SELECT prompt_id, arm, NULL::INT AS turn, sum(words) AS words, sum(enforced_flags) AS enforced_flags, sum(held_out_flags) AS held_out_flags, sum(n) AS iterations, sum(enforced_flags) = 0 AS passed FROM scored GROUP BY prompt_id, arm),
    touched AS (SELECT prompt_id FROM ends WHERE arm = 'assistant' AND iterations > 1),
    rows_ AS (SELECT 'turn' AS scope, prompt_id, arm, turn, words, enforced_flags, held_out_flags, NULL AS iterations, NULL AS passed FROM scored
        UNION ALL SELECT 'all', * FROM ends UNION ALL SELECT 'revised', * FROM ends WHERE prompt_id IN (FROM touched)),
    totals AS (SELECT scope, arm, turn, count(*) AS prompts, avg(iterations) AS generations, count(*) FILTER (passed) AS passed, count(*) FILTER (prompt_id IN (FROM touched)) AS revised,
            sum(words)::DOUBLE AS words, sum(enforced_flags)::DOUBLE AS enforced_flags, sum(held_out_flags)::DOUBLE AS held_out_flags,
            avg(words) AS mean_words, avg(enforced_flags) AS mean_enforced_flags, avg(held_out_flags) AS mean_held_out_flags FROM rows_ GROUP BY scope, arm, turn)"""
_REPORT_TOTALS = f"{_TOTALS} SELECT scope, arm, turn, prompts, round(generations, 6) AS generations, passed, revised, words, enforced_flags, held_out_flags, round(mean_words, 6) AS mean_words FROM totals"
_REPORT_COMPARISON = f"""{_TOTALS}, long AS (SELECT scope, arm, 'words' AS metric, mean_words AS m FROM totals UNION ALL SELECT scope, arm, 'enforced_flags', mean_enforced_flags FROM totals UNION ALL SELECT scope, arm, 'held_out_flags', mean_held_out_flags FROM totals),
    wide AS (SELECT scope, metric, max(m) FILTER (arm = 'user') AS u, max(m) FILTER (arm = 'system') AS s, max(m) FILTER (arm = 'assistant') AS a FROM long WHERE scope <> 'turn' GROUP BY ALL)
    SELECT scope, metric, round(u, 6) AS user, round(s, 6) AS system, round(a, 6) AS assistant, round(a - u, 6) AS change, CASE WHEN u <> 0 THEN round((a - u) * 100 / u) END AS percent,
        CASE WHEN a - u IS NULL THEN NULL WHEN abs(a - u) < 1e-9 THEN 'no change' WHEN (a < u) = (metric <> 'words') THEN 'better' ELSE 'WORSE' END AS direction,
        round(abs(s - u), 6) AS noise, abs(a - u) > coalesce(abs(s - u), 0) AS finding FROM wide"""
_REPORT_BOARD = f"""{_TOTALS}, b AS (SELECT arm, words AS total, round(generations, 6) AS generations, max(words) FILTER (arm = 'user') OVER () AS base FROM totals WHERE scope = 'all')
    SELECT arm, total, CASE WHEN base <> 0 THEN round((total - base) * 100 / base) END AS percent, generations, row_number() OVER (ORDER BY total, arm)::INT AS rank FROM b"""
_REPORT_DRIFT = f"{_TOTALS} SELECT arm, count(*)::INT AS turns, arg_max(words, turn) AS last, arg_max(words, turn) - arg_min(words, turn) AS change FROM totals WHERE scope = 'turn' GROUP BY arm"


# --- resampling, manifests -------------------------------------------------------------------
def bootstrap_merged(spark, sf_dir):
    """The interval of the assistants' words over the users', a pair a conversation, from sums that tasks add up."""
    words = F.sum(structure.blank_words(F.coalesce("text", F.lit(""))).cast("long"))
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(words.alias("score"))
    rows = c.select(F.lit("r").alias("run"), F.col("conv_id").alias("prompt_id"), F.col("role").alias("arm"), "score")
    return experiment.bootstrap_merged(experiment.paired(rows, "user", "assistant", "score"))


def manifest_ranges(spark, sf_dir):
    """The manifest of all documents by exact ranges of 100."""
    return corpus.manifest(_table(spark, sf_dir, "documents"), per_range=100)


def _tree(levels: int, per: int) -> str:
    """SQL of digests of digests, in so many levels of ``per``; a list of ``per`` or fewer is joined once."""
    up = lambda t, n: f"{t}{n} AS (SELECT source, r // {per} AS r, CASE WHEN {n} > 1 AND max(max(r)) OVER (PARTITION BY source) = 0 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY r)) END AS d FROM {t}{n - 1} GROUP BY source, r // {per})"
    return ", ".join(up("l", n) for n in range(1, levels + 1))


def manifest_sql(levels: int, per: int) -> str:
    """SQL of ``corpus.manifest`` by ranges of ``per``, for up to per ** levels documents a source."""
    return f"""WITH l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, d) - 1 AS r, d FROM
        (SELECT source, doc_id, sha256(coalesce(source, '') || chr(10) || coalesce(text, '')) AS d FROM documents)), {_tree(levels, per)},
    n AS (SELECT source, count(*) AS documents, sum(len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS words FROM documents GROUP BY source)
    SELECT n.source, documents, words, l{levels}.d AS sha256 FROM n JOIN l{levels} ON n.source IS NOT DISTINCT FROM l{levels}.source"""


_RANGES = manifest_sql(5, 100)


# --- glossaries ------------------------------------------------------------------------------
_TOPICS = (("network", ("network", "thening", " der ")), ("storage", ("record", "onhe", " les ")), ("security", ("exploit", " und ", " the ")))


def glossary_terms(spark, sf_dir):
    """Headwords of all pages by the topic of their first paragraph; the dictionary is the words that begin one page's title in three."""
    pages = _table(spark, sf_dir, "pages")
    first = F.lower(F.regexp_extract("title", r"^([A-Za-z]+)", 1))
    words = glossary.entries(pages).filter("page_id % 3 = 0").select(first.alias("word")).distinct().filter("word <> ''")
    out = glossary.mined(pages, words.withColumns({"status": F.lit("approved"), "replacement": F.lit(None).cast("string")}), _TOPICS, "other")
    return out.select("term", F.array_join("categories", "|").alias("categories"), "pages")


_CASE = " ".join(f"WHEN {' OR '.join(f'contains(p, {O.q(w)})' for w in words)} THEN {O.q(label)}" for label, words in _TOPICS)
_GLOSSARY = f"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<style\\b[^>]*>.*?</style\\s*>|<script\\b[^>]*>.*?</script\\s*>', '', 'g') AS h FROM pages),
    plain AS (SELECT page_id, h, regexp_replace(h, '(?is)<table\\b[^>]*>.*?</table\\s*>|<sup\\b[^>]*>.*?</sup\\s*>|<figure\\b[^>]*>.*?</figure\\s*>|<figcaption\\b[^>]*>.*?</figcaption\\s*>', '', 'g') AS b FROM bare),
    e AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(h, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
            list_filter(list_transform(list_filter(regexp_split_to_array(b, '(?i)</p\\s*>')[:-2], lambda x: regexp_matches(x, '(?i)<p\\b')),
                lambda x: trim(regexp_replace(regexp_replace(regexp_extract(x, '(?is)^.*<p\\b[^>]*>(.*)$', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')[1] AS paragraph FROM plain),
    noted AS (SELECT page_id, title, lower(coalesce(paragraph, '')) AS p FROM e WHERE title <> ''),
    topics AS (SELECT page_id, title, CASE {_CASE} ELSE 'other' END AS note FROM noted),
    dict AS (SELECT DISTINCT lower(regexp_extract(title, '^([A-Za-z]+)', 1)) AS word FROM topics WHERE page_id % 3 = 0 AND regexp_matches(title, '^[A-Za-z]')),
    terms AS (SELECT DISTINCT page_id, note, lower(trim(unnest(regexp_split_to_array(regexp_replace(title, '\\([^)]*\\)', '', 'g'), '\\s*,\\s*|\\s+(?:vs\\.?|versus)\\s+')))) AS w FROM topics),
    words AS (SELECT DISTINCT w FROM terms WHERE w <> ''), irr(w, base) AS (VALUES {{IRREGULAR}}),
    cands AS (SELECT w, w AS c FROM words UNION ALL SELECT w, base FROM words JOIN irr USING (w)
        UNION ALL SELECT w, left(w, -3) || 'y' FROM words WHERE ends_with(w, 'ies') AND length(w) > 4
        UNION ALL SELECT w, left(w, -2) FROM words WHERE ends_with(w, 'es') AND length(w) > 3
        UNION ALL SELECT w, left(w, -1) FROM words WHERE ends_with(w, 's') AND length(w) > 2
        UNION ALL SELECT w, left(w, -3) || 'y' FROM words WHERE ends_with(w, 'ied') AND length(w) > 4
        UNION ALL SELECT w, left(w, -2) FROM words WHERE ends_with(w, 'ed') AND length(w) > 3
        UNION ALL SELECT w, left(w, -2) || 'e' FROM words WHERE ends_with(w, 'ed') AND length(w) > 3
        UNION ALL SELECT w, left(w, -3) FROM words WHERE ends_with(w, 'ed') AND length(w) > 4
            AND substr(w, length(w) - 2, 1) = substr(w, length(w) - 3, 1) AND substr(w, length(w) - 2, 1) NOT IN ('a', 'e', 'i', 'o', 'u')),
    barred AS (SELECT DISTINCT w FROM cands JOIN dict ON c = word)
    SELECT w AS term, string_agg(DISTINCT note, '|' ORDER BY note) AS categories, count(*)::BIGINT AS pages FROM terms WHERE w <> '' AND w NOT IN (FROM barred) GROUP BY w""".replace(
    "{IRREGULAR}", ", ".join(f"({O.q(w)}, {O.q(base)})" for w, base in controlled.IRREGULAR_BASES.items())
)


def queries():
    made = (stored_verdicts, whole_run, report_totals, report_comparison, report_board, report_drift, bootstrap_merged, manifest_ranges, glossary_terms)
    return {f.__name__: f for f in made}


def oracle_sql():
    return {
        "stored_verdicts": _STORED, "whole_run": _RUN, "report_totals": _REPORT_TOTALS, "report_comparison": _REPORT_COMPARISON,
        "report_board": _REPORT_BOARD, "report_drift": _REPORT_DRIFT, "manifest_ranges": _RANGES, "glossary_terms": _GLOSSARY,
    }
