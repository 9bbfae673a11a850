"""Queries of whole flows: controlled verdicts, write decisions, routed lint with packs and embedded prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from .checks import controlled, prose
from .operators import decision, lint, routing
from .plans import oracles as O
from .plans.derived import derived, derived_sql
from .plans.registry import ruleset

WORDED = ("vague_intensifier", "marketing_adjective", "stock_adverb")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _but(name: str, keep) -> list[str]:
    return [c.id for c in ruleset(name).checks if c.id not in keep]


# --- the controlled ruleset with its dictionary -----------------------------------------
#: A small dictionary: word, status, replacement.
DICTIONARY = (
    *[(w, "approved", None) for w in ("it", "is", "late", "use", "be", "the", "stop")],
    ("utilize", "unapproved", "use"), ("sell", "unapproved", "give"), ("arrive", "unapproved", "come"), ("boast", "unapproved", None),
)


def dictionary(spark):
    return spark.createDataFrame([*DICTIONARY], "word string, status string, replacement string")


def controlled_verdicts(spark, sf_dir):
    """Verdicts of all 13 controlled checks, vocabulary among them, on the derived sentences."""
    docs = derived(spark, sf_dir, "sentences")
    return lint.lint(docs, "controlled", {"dictionary": dictionary(spark)})


def controlled_weights(spark, sf_dir):
    """doc_id, kind, weight of the same: what the gate weighs."""
    docs = derived(spark, sf_dir, "sentences")
    found = lint.gate_documents(docs, "controlled", {"dictionary": dictionary(spark)})
    return found.select("doc_id", "kind", "weight", "blocks")


def _values(rows) -> str:
    sql = lambda v: "NULL" if v is None else O.q(v)
    return ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)


# Words by a dictionary, in SQL: the candidates of a base form in order of likelihood.
_VOCABULARY = f"""{O.SENTS},
    toks AS (SELECT doc_id, unnest(regexp_extract_all(s, '[A-Za-z'']+')) AS label FROM sents),
    dict(word, status, replacement) AS (VALUES {_values(DICTIONARY)}),
    irr(w, base) AS (VALUES {_values(controlled.IRREGULAR_BASES.items())}),
    kept AS (SELECT doc_id, label, trim(lower(label), '''') AS w FROM toks),
    judged AS (SELECT k.*, d.status FROM kept k LEFT JOIN dict d ON w = d.word
        WHERE w <> '' AND w NOT IN ({', '.join(map(O.q, controlled.MODALS))}) AND coalesce(d.status, '') <> 'approved'),
    words AS (SELECT DISTINCT w FROM judged WHERE status IS NULL),
    cands AS (SELECT w, base AS c, 0 AS n FROM words JOIN irr USING (w)
        UNION ALL SELECT w, left(w, -3) || 'y', 1 FROM words WHERE ends_with(w, 'ies') AND length(w) > 4
        UNION ALL SELECT w, left(w, -2), 2 FROM words WHERE ends_with(w, 'es') AND length(w) > 3
        UNION ALL SELECT w, left(w, -1), 3 FROM words WHERE ends_with(w, 's') AND length(w) > 2
        UNION ALL SELECT w, left(w, -3) || 'y', 4 FROM words WHERE ends_with(w, 'ied') AND length(w) > 4
        UNION ALL SELECT w, left(w, -2), 5 FROM words WHERE ends_with(w, 'ed') AND length(w) > 3
        UNION ALL SELECT w, left(w, -2) || 'e', 6 FROM words WHERE ends_with(w, 'ed') AND length(w) > 3
        UNION ALL SELECT w, left(w, -3), 7 FROM words WHERE ends_with(w, 'ed') AND length(w) > 4
            AND substr(w, length(w) - 2, 1) = substr(w, length(w) - 3, 1)
            AND substr(w, length(w) - 2, 1) NOT IN ('a', 'e', 'i', 'o', 'u')),
    based AS (SELECT w, arg_min(status, n) AS base_status FROM cands JOIN dict ON c = word GROUP BY w)
    SELECT doc_id, label, count(*) AS hits FROM judged LEFT JOIN based USING (w)
    WHERE status = 'unapproved' OR base_status IS NULL OR base_status <> 'approved' GROUP BY ALL"""
_MECHANICAL = ("perfect_tense", "punctuation", "latin_abbrev")
_APART = ("length", "trailing_condition", "synonym_rotation", "safety_instruction")
_PAST = ", ".join(map(O.q, controlled.PROGRESSIVE_PAST))
_MODAL = r"(?i)\b(?:should|would|may|might|could)\b(?:\s+(?:need|want|have|wish|like)\s+to\b)?"


def _controlled_flags() -> str:
    """SQL: doc_id, kind, mechanical, label, hits of every controlled check."""
    parts = []
    for c in ruleset("controlled").checks:
        if c.id == "modal":  # fixed unless "should", or before "need to" and the like
            found = f"SELECT doc_id, unnest(regexp_extract_all(s, {O.q(_MODAL)})) AS m FROM sents"
            sql = f"""{O.SENTS} SELECT doc_id, NOT (m ILIKE 'should%' OR regexp_matches(m, '\\s')) AS mechanical,
                lower(regexp_extract(m, '^\\w+')) AS label, count(*) AS hits FROM ({found}) GROUP BY ALL"""
            parts.append(f"SELECT doc_id, 'modal' AS kind, mechanical, label, hits FROM ({sql})")
            continue
        sql = _VOCABULARY if c.id == "vocabulary" else O.CHECKS[c.id]
        mechanical = "true" if c.id in _MECHANICAL else "false"
        if c.id == "progressive":  # fixed where the past is known
            mechanical = f"regexp_matches(label, '(?i)^w') AND list_contains([{_PAST}], lower(regexp_extract(label, '(\\w+)$', 1)))"
        parts.append(f"SELECT doc_id, {O.q(c.id)} AS kind, {mechanical} AS mechanical, label, hits FROM ({sql})")
    return " UNION ALL ".join(parts)


_CONTROLLED = f"""WITH flags AS ({_controlled_flags()}),
    per AS (SELECT doc_id, kind, mechanical, sum(hits)::BIGINT AS weight,
            CASE WHEN kind IN ({', '.join(map(O.q, _APART))}) THEN sum(hits)
                 ELSE count(DISTINCT lower(label)) FILTER (label <> '') + coalesce(sum(hits) FILTER (label = ''), 0) END AS merged
        FROM flags GROUP BY doc_id, kind, mechanical)"""
_CONTROLLED_VERDICTS = f"""{_CONTROLLED}, all_docs AS ({derived_sql('sentences')}),
    n AS (SELECT d.doc_id, coalesce(sum(merged) FILTER (NOT mechanical), 0)::BIGINT AS semantic,
            coalesce(sum(merged) FILTER (mechanical), 0)::BIGINT AS mechanical,
            coalesce(bool_or(NOT mechanical AND kind <> 'vocabulary'), false) AS would_block
        FROM all_docs d LEFT JOIN per p ON d.doc_id = p.doc_id GROUP BY d.doc_id)
    SELECT doc_id, CASE WHEN semantic > 0 THEN 'semantic_flags' WHEN mechanical > 0 THEN 'mechanical_violations' ELSE 'clean' END AS status,
        semantic, mechanical, would_block FROM n"""
_CONTROLLED_WEIGHTS = f"""{_CONTROLLED} SELECT doc_id, kind, weight, kind <> 'vocabulary' AS blocks FROM per WHERE NOT mechanical"""


# --- writes ---------------------------------------------------------------------------------
#: Two words of emphasis, or one of marketing, stop a write.
_OVERRIDES = (("vague_intensifier", None, "threshold", "2"), ("vague_intensifier", None, "action", "block"), ("marketing_adjective", None, "action", "block"))
_WRITE_RULES = [{"glob": "d/*5.md", "ruleset": None}, {"glob": "d/*.md", "ruleset": "prose", "disable": _but("prose", WORDED)}]


def _overrides(spark):
    return spark.createDataFrame([*_OVERRIDES], "check_id string, glob string, field string, value string")


def writes(spark, sf_dir):
    """A write to each document, made from a part's sentences: whole, as an edit, as one whose place is not found, by a shell."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"))
    said = derived(spark, sf_dir, "sentences").select(F.col("doc_id").alias("part"), F.col("text").alias("said"))
    both = docs.join(said, F.col("doc_id") % 200 == F.col("part"))
    k, old = F.col("doc_id") % 4, F.substring("before", 1, 12)
    edited = F.when(k == 1, F.concat(old, F.lit(" "), "said", F.lit(" "))).otherwise(F.col("said"))
    return both.select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(k == 0, "write").when(k == 3, "shell").otherwise("edit").alias("tool"), "before",
        F.when(k == 0, F.concat("before", F.lit("\n\n"), "said")).when(k == 3, F.col("said")).alias("content"),
        F.when(k == 1, old).when(k == 2, F.lit("\x01")).alias("old"), F.when(k.isin(1, 2), edited).alias("new"), F.lit(False).alias("every"),
    )


def write_decisions(spark, sf_dir):
    """The decision on a write to each document."""
    out = decision.decide_writes(writes(spark, sf_dir), _WRITE_RULES, _overrides(spark))
    return out.select("path", "decision", "before_weight", "after_weight", "flags")


def _listed(text: str, terms) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '\\s+', ' ', 'g'), {O.q('(?i)' + chr(92) + 'b(' + O._longest(terms) + ')' + chr(92) + 'b')}, 1)"


def _distinct(found: str) -> str:
    return f"len(list_distinct(list_transform({found}, lambda x: lower(x))))"


def _weighed(text: str) -> tuple[str, str]:
    """SQL: the weight of a text's blocking flags, and how many flags these are."""
    v, m = _listed(text, prose.VAGUE_INTENSIFIERS), _listed(text, prose.MARKETING_ADJECTIVES)
    weight = f"(CASE WHEN len({v}) >= 2 THEN len({v}) ELSE 0 END + len({m}))"
    return weight, f"(CASE WHEN len({v}) >= 2 THEN {_distinct(v)} ELSE 0 END + {_distinct(m)})"


_WRITES = f"""WITH said AS ({derived_sql('sentences')}),
    w AS (SELECT d.doc_id, coalesce(d.text, '') AS before, s.text AS said, d.doc_id % 4 AS k FROM documents d JOIN said s ON s.doc_id = d.doc_id % 200),
    chunked AS (SELECT *, CASE WHEN k = 0 THEN before || chr(10) || chr(10) || said WHEN k = 1 THEN substr(before, 1, 12) || ' ' || said || ' ' ELSE said END AS chunk FROM w),
    placed AS (SELECT *, CASE WHEN k = 0 THEN chunk WHEN k = 1 AND before <> '' THEN chunk || substr(before, 13) END AS after FROM chunked),
    weighed AS (SELECT *, {_weighed('coalesce(after, chunk)')[0]} AS now, {_weighed('coalesce(after, chunk)')[1]} AS n, {_weighed('before')[0]} AS was,
        {_distinct(_listed('chunk', prose.STOCK_ADVERBS))} AS mechanical, doc_id % 10 = 5 AS out FROM placed),
    compared AS (SELECT *, now > 0 AND after IS NOT NULL AND trim(before) <> '' AS had FROM weighed),
    judged AS (SELECT *, now > 0 AND (NOT had OR now > was) AS worse FROM compared)
    SELECT 'd/' || doc_id || '.md' AS path,
        CASE WHEN out THEN 'out_of_scope' WHEN worse OR (mechanical > 0 AND k = 3) THEN 'deny' WHEN mechanical > 0 THEN 'auto_fix' ELSE 'clean' END AS decision,
        CASE WHEN had AND NOT out THEN was END::BIGINT AS before_weight, CASE WHEN had AND NOT out THEN now END::BIGINT AS after_weight,
        CASE WHEN out THEN 0 WHEN worse THEN n ELSE mechanical END::INT AS flags FROM judged"""


# --- packs and embedded prose ------------------------------------------------------------------
_PACK_RULES = [
    {"glob": "p/*", "ruleset": "prose", "packs": {"marketing_adjective": ["things"]}, "disable": _but("prose", WORDED[1:2])},
    {"glob": "q/*", "ruleset": "prose", "disable": _but("prose", WORDED[1:2])},
]


def routed_packs(spark, sf_dir):
    """Verdicts on the derived sentences under two rules; the first binds a pack, the names of the larger things among the parts."""
    docs = derived(spark, sf_dir, "sentences")
    here = F.when(F.col("doc_id") % 2 == 0, "p/").otherwise("q/")
    files = docs.select(F.concat(here, F.col("doc_id").cast("string")).alias("path"), "text")
    things = _table(spark, sf_dir, "part").filter("p_size > 25").select(F.lit("things").alias("pack"), F.substring_index("p_name", " ", -1).alias("term"))
    out = routing.lint_routed(files, _PACK_RULES, _overrides(spark), packs=things)
    return out.select("path", "status", "semantic", "would_block")


_PACKS = f"""WITH docs AS ({derived_sql('sentences')}), things AS (SELECT DISTINCT lower(split_part(p_name, ' ', -1)) AS term FROM part WHERE p_size > 25),
    own AS (SELECT doc_id, {_distinct(_listed('text', prose.MARKETING_ADJECTIVES))} AS n FROM docs),
    toks AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(text, '\\w+'), lambda x: lower(x))) AS term FROM docs WHERE doc_id % 2 = 0),
    more AS (SELECT doc_id, count(*) AS n FROM toks JOIN things USING (term) GROUP BY doc_id),
    v AS (SELECT o.doc_id, o.n + coalesce(m.n, 0) AS n FROM own o LEFT JOIN more m ON o.doc_id = m.doc_id)
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'p/' ELSE 'q/' END || doc_id AS path, CASE WHEN n > 0 THEN 'semantic_flags' ELSE 'clean' END AS status,
        n::BIGINT AS semantic, n > 0 AS would_block FROM v"""
#: Sources of Python: prose in a docstring, in a formatted string, too short, in a comment, in a text that doesn't parse, in two calls.
_SOURCES = (
    '"""A robust {} that is sold here."""\n', 'x = f"the {y} of a very amazing and seamless {}"\n', 'x = "robust {}"\n', "# a robust and seamless {} of ours\nx = 1\n",
    'def f(:\n    "a robust {} in a broken file"\n', 'f("this is the robust {}")\ng("and this is quite robust too, {}")\n',
)
_SOURCE_RULES = [{"glob": "*.py", "ruleset": "code", "embedded_prose": "prose", "disable": [*_but("code", ()), *_but("prose", WORDED[:2])]}]


def routed_embedded(spark, sf_dir):
    """Verdicts on sources made from the parts: the code ruleset is silent, their literals are judged as prose."""
    source = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("p_partkey") % len(_SOURCES) + 1).cast("int"))
    text = F.replace(source, F.lit("{}"), F.col("p_name"))
    files = _table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    out = routing.lint_routed(files, _SOURCE_RULES, _overrides(spark))
    return out.select("path", "status", "semantic", "would_block")


# What the literals say, by source; words are counted as the checks do.
_SAID = ("A robust {} that is sold here.", "the X of a very amazing and seamless {}", "", "", "", "this is the robust {}\n\nand this is quite robust too, {}")
_EMBEDDED = f"""WITH said AS (SELECT p_partkey AS k, replace(([{', '.join("'" + s.replace(chr(10), "' || chr(10) || '") + "'" for s in _SAID)}])[p_partkey % {len(_SAID)} + 1], '{{}}', p_name) AS t FROM part),
    n AS (SELECT k, {_distinct(_listed('t', prose.VAGUE_INTENSIFIERS))} AS v, len({_listed('t', prose.VAGUE_INTENSIFIERS)}) AS weight, {_distinct(_listed('t', prose.MARKETING_ADJECTIVES))} AS m FROM said)
    SELECT 'src/' || k || '.py' AS path, CASE WHEN v + m > 0 THEN 'semantic_flags' ELSE 'clean' END AS status, (v + m)::BIGINT AS semantic, m > 0 OR weight >= 2 AS would_block FROM n"""


def queries():
    return {f.__name__: f for f in (controlled_verdicts, controlled_weights, write_decisions, routed_packs, routed_embedded)}


def oracle_sql():
    return {
        "controlled_verdicts": _CONTROLLED_VERDICTS, "controlled_weights": _CONTROLLED_WEIGHTS, "write_decisions": _WRITES,
        "routed_packs": _PACKS, "routed_embedded": _EMBEDDED,
    }
