"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .licenses import DIGESTS, EQUAL, GOES_ON, KNOWN
from .mixing import EPOCHS, SHARE, WEIGHTS
from .quality_rules import MEASURES, REACH, SIGMAS

_WORD = r"[^ \t\n\x0b\f\r]+"
_LINE = r"[^ \t\n\x0b\f\r]"


def mixing() -> str:
    kinds = ", ".join(f"{float(w)}" for w in WEIGHTS)
    return f"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
        FROM documents),
    per AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               list_extract([{kinds}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT)::DOUBLE AS weight
        FROM sized GROUP BY source),
    capped AS (SELECT *, {float(EPOCHS)}::DOUBLE * source_size AS cap FROM per),
    levels AS (
        SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM capped),
    water AS (SELECT arg_min(level, row(cap / weight, source IS NULL, source)) AS level FROM levels WHERE level <= cap / weight),
    wanted AS (SELECT source, source_size, least(cap, coalesce(w.level * weight, 0)) AS target FROM levels, water w),
    placed AS (
        SELECT s.doc_id, s.size, w.source_size, w.target, w.target - floor(w.target / nullif(w.source_size, 0)) * w.source_size AS rest,
               coalesce(floor(w.target / nullif(w.source_size, 0)), 0) AS epochs,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source),
    dealt AS (SELECT *, (epochs + CASE WHEN coalesce(rest, 0) > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
    SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM dealt"""


def quality_rules() -> str:
    inside, fences = [], []
    for m, (count, units, both) in MEASURES.items():
        q = lambda p, m=m: f"quantile_disc({m}, {p})"
        reach = f"{REACH}::DOUBLE * ({q(0.75)} - {q(0.25)})"
        fences.append(f"{q(0.75)} + {reach} AS most_{m}")
        fences.append(f"greatest({q(0.25)} - {reach}, 0.0) AS least_{m}" if both else f"0.0::DOUBLE AS least_{m}")
        for end, sign, way in (("most", "+", "<="), ("least", "-", ">=")):
            x = f"{units} * {end}_{m}"
            inside.append(f"coalesce({count} {way} {x} {sign} ({SIGMAS}::DOUBLE * sqrt({x}) + {SIGMAS}::DOUBLE), true)")
    return f"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
    numbered AS (SELECT row_number() OVER () AS r, * FROM d),
    windows AS (SELECT r, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM numbered)),
    again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM windows) WHERE c > 1),
    gaps AS (SELECT r, least(5, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - 5)) AS n FROM again),
    repeats AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM gaps GROUP BY r),
    lined AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered) WHERE regexp_matches(line, '{_LINE}') GROUP BY r),
    counted AS (
        SELECT n.r, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               coalesce(n_lines, 0) AS n_lines
        FROM numbered n LEFT JOIN lined l ON n.r = l.r LEFT JOIN repeats p ON n.r = p.r),
    measured AS (
        SELECT *, CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words END AS symbols_per_word, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words END AS chars_per_word,
               CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines END AS dup_line_share,
               (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed
        FROM counted),
    fences AS (SELECT lang, source, {', '.join(fences)} FROM measured GROUP BY lang, source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {' AND '.join(inside)}) AS kept
    FROM measured m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    # A line that begins with "copyright" stays if the text of a licence goes on there: without look-ahead, by a mark for the time.
    goes_on = f"(?m)^([^a-z0-9\\n]*)copyright\\b([^a-z0-9\\n]*\\n?[^a-z0-9\\n]*(?:{GOES_ON})\\b)"
    kept = f"regexp_replace(lower({text}), {_quoted(goes_on)}, '\\1zzkeepcopyright\\2', 'g')"
    out = f"regexp_replace({kept}, '(?m)^[^a-z0-9\\n]*(copyright\\b|\\(c\\)|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    out = f"replace({out}, 'zzkeepcopyright', 'copyright')"
    out = f"' ' || trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for a, b in EQUAL:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"sha256(trim({out}))"


def license_scan() -> str:
    known = ", ".join(f"({_quoted(a)}, {_quoted(t)})" for a, t in KNOWN)
    digests = ", ".join(f"({_quoted(d)}, {_quoted(a)})" for a, d in DIGESTS)
    return f"""
    WITH given(license, text) AS (VALUES {known}), more(digest, license) AS (VALUES {digests}),
    known AS (SELECT digest, min(license) AS license FROM (SELECT {_canonical('text')} AS digest, license FROM given UNION ALL SELECT digest, license FROM more) GROUP BY 1),
    notices AS (SELECT {_canonical('text')} AS digest, min(license) AS license FROM given WHERE NOT contains(text, chr(10)) GROUP BY 1),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
    hits AS (SELECT r, license FROM (SELECT r, {_canonical('line')} AS digest FROM lines) JOIN notices USING (digest)),
    found AS (SELECT r, list_sort(list(DISTINCT license)) AS line_licenses, count(*) AS n FROM hits GROUP BY r)
    SELECT doc_id, k.license AS text_license, coalesce(line_licenses, []::VARCHAR[]) AS line_licenses, coalesce(n, 0)::BIGINT AS n_notice_lines
    FROM (SELECT r, doc_id, {_canonical('text')} AS digest FROM docs) d LEFT JOIN known k USING (digest) LEFT JOIN found f USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan(), "op6_quality_rules": quality_rules(), "op7_mixing": mixing()}
