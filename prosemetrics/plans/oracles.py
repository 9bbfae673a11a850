"""SQL (DuckDB) that gives the rows of the catalogue's queries. Its regular expressions have no look-around, so some are put differently."""

from __future__ import annotations

from ..checks import code as K
from ..checks import controlled as C
from ..checks import prose as P
from .derived import LEXICON, derived_sql

_CUT = "chr(30)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def split_sentences(text: str) -> str:
    """SQL: the sentences of a one-paragraph text."""
    marked = f"regexp_replace(trim({text}), '([.!?])\\s+([A-Z])', '\\1' || {_CUT} || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, {_CUT}), lambda x: trim(x)), lambda x: x <> '')"


SENTS = f"WITH docs AS ({derived_sql('sentences')}), lists AS (SELECT doc_id, {split_sentences('text')} AS ss FROM docs), sents AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM lists)"
LINES = f"WITH docs AS ({derived_sql('lists')}), sents AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM docs)"
CODE = f"""WITH docs AS ({derived_sql('code')}), split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
    looked AS (SELECT *, trim(s) AS t, lead(s) OVER w AS nxt FROM split WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    sents AS (SELECT *, (SELECT arg_min(trim(b.s), b.i) FROM split b WHERE b.doc_id = a.doc_id AND b.i > a.i AND trim(b.s) <> '') AS following,
              regexp_matches(text, '(?m)^\\s*(?:async\\s+def|def|class)\\s') AS defines FROM looked a)"""
PARTS = f"WITH docs AS ({derived_sql('parts')})"


def _hits(head: str, labels: str, source: str = "sents") -> str:
    """Rows (doc_id, label, hits) from an SQL list of labels of each row of ``source``."""
    return f"{head} SELECT doc_id, coalesce(label, '') AS label, count(*) AS hits FROM (SELECT doc_id, unnest({labels}) AS label FROM {source}) GROUP BY ALL"


def _all(pattern: str, group: int = 0, flags: str = "(?i)") -> str:
    return f"regexp_extract_all(s, {q(flags + pattern)}, {group})"


def _first(pattern: str, flags: str = "(?i)", of: str = "s", cut: int | None = None, group: int = 0) -> str:
    value = f"regexp_extract({of}, {q(flags + pattern)}, {group})"
    value = f"trim({value})" if cut == 50 else value
    return f"CASE WHEN regexp_matches({of}, {q(flags + pattern)}) THEN [{f'substr({value}, 1, {cut})' if cut else value}] ELSE [] END"


def _has(pattern: str, of: str = "s", flags: str = "(?i)") -> str:
    return f"regexp_matches({of}, {q(flags + pattern)})"


def _if(condition: str, label: str) -> str:
    return f"CASE WHEN {condition} THEN [{label}] ELSE [] END"


def _alternatives(terms) -> str:
    import re

    return "|".join(re.escape(t).replace("\\ ", " ").replace("\\'", "'") for t in terms)


def _longest(terms) -> str:
    return _alternatives(sorted(terms, key=lambda t: (-len(t), t)))


def _listed(phrases, test) -> str:
    cases = " ".join(f"WHEN {test(p)} THEN [{q(p)}]" for p in phrases)
    return f"CASE {cases} ELSE [] END"


def _pairs(condition: str, head: str = SENTS) -> str:
    return f"""{head}, pairs AS (SELECT doc_id, i, s AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM sents)
    SELECT doc_id, a AS label, count(*) AS hits FROM pairs WHERE b IS NOT NULL AND {condition} GROUP BY ALL"""


def _map(mapping: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in mapping.items()) + "}"


_IS = r"^(it'?s|it is|this is|that is)"
_UNLESS_BOLD = "NOT starts_with(regexp_replace(b, '^[-—•\\t ]+', ''), '**')"
_COLON = f"""{SENTS}, cut AS (SELECT doc_id, trim(regexp_extract(s, '^(.{{1,60}}?):\\s+(\\S.*)$', 1)) AS b FROM sents WHERE regexp_matches(s, '^(.{{1,60}}?):\\s+(\\S.*)$'))
    SELECT doc_id, b || ':' AS label, count(*) AS hits FROM cut WHERE {_UNLESS_BOLD} AND NOT regexp_matches(b, {q('(?i)' + P.NUMBERED_LABEL)})
    AND len(regexp_extract_all(b, '\\S+')) BETWEEN 1 AND 6 AND regexp_replace(lower(regexp_extract(b, '(\\S+)$', 1)), '^[.,;:]+|[.,;:]+$', '', 'g') NOT IN ({', '.join(map(q, P.COLON_LABELS))}) GROUP BY ALL"""
_NEGATIVE = f"""{SENTS}, marked AS (SELECT *, regexp_matches(s, '(?i)^not\\b') AS neg FROM sents),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, neg ORDER BY i) AS run FROM marked),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id, run) AS len FROM runs WHERE neg)
    SELECT doc_id, s AS label, count(*) AS hits FROM placed WHERE n % 2 = 1 AND n < len GROUP BY ALL"""


def _count(counted: str, of: str = "docs") -> str:
    return f"{PARTS} SELECT doc_id, '' AS label, ({counted})::BIGINT AS hits FROM {of} WHERE ({counted}) > 0"


_BODY = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*\\|.*\\|\\s*$')), chr(10))"
_TITLE = f"""{PARTS}, heads AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}\\s+\\S'))) AS line FROM docs),
    named AS (SELECT doc_id, trim(regexp_replace(line, '^#+\\s+', '')) AS h FROM heads), worded AS (SELECT *, regexp_extract_all(h, '[A-Za-z][\\w''-]*') AS w FROM named),
    picked AS (SELECT *, list_filter(w[2:], lambda x: lower(x) NOT IN ({', '.join(map(q, P.SMALL_WORDS))})) AS r FROM worded)
    SELECT doc_id, min(substr(h, 1, 60)) AS label, 1::BIGINT AS hits FROM picked WHERE len(w) >= 3 AND len(r) >= 2 AND len(list_filter(r, lambda x: regexp_matches(x, '^[A-Z]') AND upper(x) <> x)) = len(r) GROUP BY doc_id"""
_UNIFORM = f"""{PARTS}, paras AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n\\s*\\n'))) AS p FROM docs),
    sized AS (SELECT doc_id, len(regexp_extract_all(p, '\\S+')) AS n FROM paras WHERE p <> '' AND NOT regexp_matches(p, '^(?:[#*>|-]|```)'))
    SELECT doc_id, count(*) || ' paragraphs, spread ' || printf('%.2f', stddev_samp(n) / avg(n)) AS label, 1::BIGINT AS hits FROM sized WHERE n >= {P.LONG_PARAGRAPH} GROUP BY doc_id HAVING count(*) >= {P.PARAGRAPHS} AND stddev_samp(n) / avg(n) < {P.UNIFORM_BELOW}"""
_BULLET = r"^(\s*(?:[-*+]|\d+\.)\s+)"
_LABEL = r"^\s*(?:[-*+]|\d+[.)])\s+(\*\*|__)?([A-Z]{1,4}-?\d{1,2}(?:\.\d{1,2})?)(.*)$"
_TAIL = "^[:).]?\\s+(?:[-–—]\\s*)?[*_\"'']?[A-Z]"
_ID = f"""{LINES}, cut AS (SELECT doc_id, regexp_extract(s, '{_LABEL}', 1) AS b, regexp_extract(s, '{_LABEL}', 2) AS label, regexp_extract(s, '{_LABEL}', 3) AS rest FROM sents WHERE regexp_matches(s, '{_LABEL}'))
    SELECT doc_id, label, count(*) AS hits FROM cut WHERE starts_with(rest, b) AND regexp_matches(substr(rest, length(b) + 1), '{_TAIL}') GROUP BY ALL"""
_SAFETY = f"""{SENTS}, blocks AS (SELECT doc_id, text AS t FROM docs WHERE regexp_matches(text, {q('(?i)' + C.SAFETY_LABEL)})),
    cut AS (SELECT doc_id, upper(regexp_extract(t, {q('(?i)' + C.SAFETY_LABEL)}, 1)) AS label, trim(regexp_replace(t, {q('(?i)' + C.SAFETY_LABEL)}, '')) AS b FROM blocks),
    hits AS (SELECT doc_id, label FROM cut WHERE b = '' UNION ALL SELECT doc_id, label FROM cut WHERE b <> '' AND regexp_replace(lower(regexp_extract(b, '^\\S+')), '^[.,;:]+|[.,;:]+$', '', 'g') IN ({', '.join(map(q, C.WEAK_STARTS))})
             UNION ALL SELECT doc_id, label FROM cut WHERE b <> '' AND NOT regexp_matches(b, {q('(?i)' + C.CONSEQUENCE)}))
    SELECT doc_id, label, count(*) AS hits FROM hits GROUP BY ALL"""
_ROTATION = " + ".join(f"(len(list_distinct(list_transform(regexp_extract_all(t, {q('(?i)' + p)}, 1), lambda x: rtrim(lower(x), 's')))) > 1)::INT" for _, p in C.ROTATIONS)
_COMMENT = "starts_with(t, '#') AND NOT starts_with(t, '#!')"
_B = "trim(substr(t, 2))"
_TRIVIAL_CODE = "[({=;}\\]>]"
_TRIVIAL = f"""{_COMMENT} AND length({_B}) <= {K.LONGEST_TRIVIAL} AND NOT {_has(K.EXPLAINING, _B)} AND NOT (contains({_B}, '(') AND contains({_B}, ')')) AND NOT {_has(_TRIVIAL_CODE, _B, '')}
    AND coalesce(trim(nxt) <> '', true) AND NOT {_has('[─━═╌╍┄┅│┃]|^-{3,}', _B, '')} AND {_has('^#\\s*This (?:function|method|class) (?:will |is used to )?|^#\\s*(?:' + '|'.join(K.TRIVIAL_STEMS) + ')(?:e|es|ing|s)?\\b', 't')}"""
_NARRATIVE = " OR ".join([_has(r"^#\s*[-=─━~_*]{6,}\s*$", "t", ""), _has(r"^#\s*(Phase|Step|Section|Part)\s+\d+\s*[:.\-]", "t"), _has("|".join(K.CROSS_REFERENCES), "t"), _has("|".join(K.NARRATION_OPENERS), "t")])
_META = " OR ".join([_has("|".join(K.PLAN_REFERENCES), "t"), _has("|".join(K.BEFORE_AFTER), "t")])
_NAMED = f"lower(regexp_extract(t, '^except(?:\\s+[\\w.]+)?\\s+as\\s+(\\w+)\\s*:\\s*$', 1)) NOT IN ({', '.join(map(q, K.IGNORED_NAMES))})"
_MODAL_ALL = r"\b(?:should|would|may|might|could)\b"

CHECKS: dict[str, str] = {
    "filler_opener": _hits(SENTS, "CASE " + " ".join(f"WHEN {_has('^' + p)} THEN [regexp_extract(s, {q('(?i)^' + p)})]" for p in P.FILLER_OPENERS) + " ELSE [] END"),
    "stock_adverb": _hits(SENTS, _all(rf"\b({_longest(P.STOCK_ADVERBS)})\b", 1)),
    "colon_reveal": _COLON,
    "binary_contrast": _pairs(f"{_has(_IS + ' not' + chr(92) + 'b', 'a')} AND {_has(_IS + chr(92) + 'b', 'b')} AND NOT {_has(chr(92) + 'bnot' + chr(92) + 'b', 'b')}"),
    "rule_of_three": _hits(SENTS, _first(r"\b(\w+ing)\b,\s+(\w+ing)\b,?\s+and\s+(\w+ing)\b", cut=60)),
    "copula_avoidance": _hits(SENTS, _listed(P.COPULA_DODGES, lambda p: f"contains(lower(s), {q(p)})")),
    "participial_tail": _hits(SENTS, _first(r",\s+(" + "|".join(P.TAIL_PARTICIPLES) + r")\b", cut=50)),
    "section_template": _hits(SENTS, _listed(P.SECTION_TEMPLATES, lambda p: f"(starts_with(ltrim(lower(s), '#* -'), {q(p)}) OR contains(ltrim(lower(s), '#* -'), {q(' ' + p)}))")),
    "bold_density": _count(f"len(regexp_extract_all({_BODY}, '\\*\\*[^*\\n]{{1,80}}\\*\\*'))"),
    "thematic_break": _count("len(regexp_extract_all(CASE WHEN starts_with(text, '---') THEN regexp_replace(text, '(?s)\\A---.*?\\n---', '') ELSE text END, '(?m)^\\s*(?:---+|\\*\\*\\*+|___+)\\s*$'))"),
    "title_case_heading": _TITLE,
    "ai_markup_remnant": _hits(PARTS, f"CASE WHEN {_has(P.REMNANTS, 'text')} THEN [substr(regexp_extract(text, {q('(?i)' + P.REMNANTS)}), 1, 50)] ELSE [] END", "docs"),
    "paragraph_uniformity": _UNIFORM,
    "em_dash_cluster": _count(f"len(regexp_extract_all(text, {q('—|' + P.EM_DASH_ENTITY)}))"),
    "weasel_attribution": _hits(SENTS, _all(rf"\b({_alternatives(P.WEASEL_PHRASES)})\b", 1)),
    "entity_encoded_punctuation": _hits(SENTS, " || ".join(_all(p, 0, "") for p in (P.EM_DASH_ENTITY, P.SECTION_ENTITY, P.MIDDOT_ENTITY))),
    "bold_bullet_lead": _hits(LINES, " || ".join(f"CASE WHEN {_has(_BULLET + d + '(.+?)' + d + '(.*)$', 's', '')} AND NOT regexp_matches(regexp_extract(s, {q(_BULLET + d + '(.+?)' + d + '(.*)$')}, 2), '[.:?!]$') AND regexp_matches(regexp_extract(s, {q(_BULLET + d + '(.+?)' + d + '(.*)$')}, 3), '\\S') THEN [regexp_extract(s, {q(_BULLET + d + '(.+?)' + d + '(.*)$')}, 2)] ELSE [] END" for d in (r"\*\*", "__"))),
    "id_label_lead": _ID,
    "not_just_x_but_y": _hits(SENTS, _first(r"\bnot just\b[^.?!]{0,60}?\bbut\b")),
    "vague_intensifier": _hits(SENTS, _all(rf"\b({_longest(P.VAGUE_INTENSIFIERS)})\b", 1)),
    "emoji_in_prose": _hits(SENTS, _all(P.EMOJI, 0, "")),
    "marketing_adjective": _hits(SENTS, _all(rf"\b({_longest(P.MARKETING_ADJECTIVES)})\b", 1)),
    "filler_verb": _hits(SENTS, _all(r"\b(" + "|".join(P.FILLER_VERBS) + r")\b", 1) + " || " + _all(r"\b(delves?)\s+(?:into|deeper)", 1)),
    "marketing_cliche": _hits(SENTS, _all(rf"\b({_alternatives(P.MARKETING_CLICHES)})\b", 1)),
    "solicit_criticism": _hits(SENTS, " || ".join(_first(p) for p in P.SOLICITATIONS)),
    "unearned_profundity": _hits(SENTS, _if(_has(f"^(?:{_alternatives(P.PROFUNDITIES)})\\.?$"), "s")),
    "dramatic_fragmentation": _hits(SENTS, _if(_has(f"^(?:{_alternatives(P.FRAGMENTS)})\\.?$"), "s")),
    "canned_question_answer": _pairs(f"{_has('^' + chr(92) + 'S+(?:' + chr(92) + 's+' + chr(92) + 'S+){0,4}' + chr(92) + '?$', 'a', '')} AND {_has('^(it|this|the|that|why|because)' + chr(92) + 'b', 'b')}"),
    "negative_listing": _NEGATIVE,
    "terminology": _hits(SENTS, _all(rf"\b({_longest(LEXICON)})\b", 1)),
    "identifier_in_prose": _hits(SENTS, _all(P.IDENTIFIER, 0, "")),
    "trivial_comment": _hits(CODE, _if(_TRIVIAL, "t")),
    "narrative_comment": _hits(CODE, _if(f"{_COMMENT} AND ({_NARRATIVE})", "t")),
    "meta_comment": _hits(CODE, _if(f"{_COMMENT} AND NOT {_has(K.WHY_OR_TODO, 't')} AND ({_META})", "t")),
    "swallowed_exception": _hits(CODE, _if(f"{_has('^except(?:' + chr(92) + 's+[' + chr(92) + 'w.]+)?' + chr(92) + 's*(?:as' + chr(92) + 's+' + chr(92) + 'w+)?' + chr(92) + 's*:' + chr(92) + 's*$', 't', '')} AND {_NAMED} AND following = 'pass'", "t")),
    "mutable_default_arg": _hits(CODE, f"CASE WHEN {_has(K.DEF_LINE, 's', '')} THEN list_transform(range(1, len({_all(r'(\w+)\s*=\s*(\[\]|\{\}|set\(\))', 1, '')}) + 1), lambda i: {_all(r'(\w+)\s*=\s*(\[\]|\{\}|set\(\))', 1, '')}[i] || '=' || {_all(r'(\w+)\s*=\s*(\[\]|\{\}|set\(\))', 2, '')}[i]) ELSE [] END"),
    "print_debug": _hits(CODE, _if(f"defines AND {_has(r'^\s*print\(', 's', '')}", "t")),
    "todo_stub": _hits(CODE, _if(f"{_has(r'#\s*(TODO|FIXME|HACK)\b[:\s]*(.*)$')} AND NOT regexp_matches(regexp_extract(s, {q('(?i)' + r'#\s*(TODO|FIXME|HACK)\b[:\s]*(.*)$')}, 2), {q('(?i)' + r'#\d+|[A-Z]{2,}-\d+|https?://')})", f"trim(regexp_extract(s, {q('(?i)' + r'#\s*(TODO|FIXME|HACK)\b[:\s]*(.*)$')}))")),
    "generic_naming": _hits(CODE, f"CASE WHEN {_has(K.DEF_LINE, 's', '')} OR contains(s, '=') THEN {_all(rf'\b({_longest(K.GENERIC_STEMS)})_?\d+\b')} ELSE [] END"),
    "tautological_assert": _hits(CODE, _if(_has(r"^\s*assert\s+True\s*$", "s", ""), "t")),
    "constant_condition": _hits(CODE, _if(_has(r"^\s*(?:if\s+(True|False)|while\s+(False))\s*:\s*$", "s", ""), r"regexp_extract(s, '(True|False)')")),
    "safety_instruction": _SAFETY,
    "length": _hits(SENTS, _if("len(regexp_extract_all(s, '\\S+')) > 20", "''")),
    "ing_form": _hits(SENTS, f"list_filter({_all(r'\b(\w+ing)\b', 1)}, lambda x: lower(x) NOT IN ({', '.join(map(q, (*C.ING_NOUNS, *C.ING_NEVER_VERBAL)))}))"),
    "perfect_tense": _hits(SENTS, f"list_transform({_all(r'\b(has|have|had)\s+been\b', 1)}, lambda x: x || ' been') || list_filter(list_transform({_all(r'\b(?:has|have|had)\s+\w+\b')}, lambda x: regexp_replace(x, '\\s+', ' ')), lambda x: regexp_matches(x, '(?i)ed$') AND NOT regexp_matches(x, '(?i) been$') OR list_contains([{', '.join(map(q, C.PARTICIPLES))}], lower(regexp_extract(x, ' (\\w+)$', 1))))"),
    "progressive": _hits(SENTS, f"list_transform({_all(C.PROGRESSIVE)}, lambda x: regexp_replace(x, '\\s+', ' '))"),
    "passive": _hits(SENTS, f"list_transform({_all(C.PASSIVE)}, lambda x: regexp_replace(x, '\\s+', ' '))"),
    "modal": _hits(SENTS, f"list_transform({_all(_MODAL_ALL)}, lambda x: lower(x))"),
    "punctuation": _hits(SENTS, f"(CASE WHEN contains(s, ';') THEN [''] ELSE [] END) || list_filter({_all(chr(92) + 'b' + chr(92) + 'w+' + chr(39) + chr(92) + 'w+' + chr(92) + 'b', 0, '')}, lambda x: list_contains([{', '.join(map(q, C.CONTRACTIONS))}], lower(x)))"),
    "trailing_condition": _hits(SENTS, _if(f"{_has(C.TRAILING)} AND NOT {_has(r'^(if|when)' + chr(92) + 'b')}", "''")),
    "latin_abbrev": _hits(SENTS, _all(C.LATIN_PATTERN.replace("\\ ", " "), 1)),
    "inclusive_language": _hits(SENTS, f"list_filter(regexp_extract_all(s, '[A-Za-z'']+'), lambda x: lower(x) IN ({', '.join(map(q, (*C.PRONOUNS, *C.TERMS)))}))"),
    "synonym_rotation": f"{SENTS}, whole AS (SELECT doc_id, array_to_string(ss, ' ') AS t FROM lists) SELECT doc_id, '' AS label, ({_ROTATION})::BIGINT AS hits FROM whole WHERE ({_ROTATION}) > 0",
}
