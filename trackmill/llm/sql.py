"""DuckDB SQL that must return the same rows as a query."""

from __future__ import annotations

from trackmill.llm import secrets


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(pattern: str) -> str:
    words = "password|passwd|secret|token|api_?key"
    cased = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)
    return pattern.replace(f"(?i:{words})", f"(?:{cased})")


def _cut(kind: int, pattern: str) -> str:
    p = _literal(_either_case(pattern))
    return f"regexp_split_to_array(t, {p}) AS gap{kind}, regexp_extract_all(t, {p}) AS hit{kind}"


def _placed(kind: int) -> str:
    start = f"list_sum(list_transform(gap{kind}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit{kind}[1:i-1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len(hit{kind}) + 1), lambda i: {{'s': ({start})::BIGINT, 'k': {kind}, 'e': ({start} + length(hit{kind}[i]))::BIGINT, 'b': hit{kind}[i]}})"


def secret_scan() -> str:
    """op2: spans placed by the lengths between them, entropy of each window counted anew."""
    body = _literal(r"([A-Za-z0-9+/_.=-]+)$")
    threshold = "CASE " + " ".join(f"WHEN regexp_matches(c.b, {_literal(p)}) THEN {bits}" for _, p, bits in secrets.CLASSES) + " END"
    allowed = " AND ".join(f"NOT regexp_matches(c.b, {_literal(p)})" for p in secrets.ALLOWED)
    w = secrets.WINDOW
    entropy = f"list_aggregate(string_split(substr(c.b, j, {w}), ''), 'entropy')"
    text = "array_to_string(list_transform({0}, lambda x: ['assign','access','hex','entropy'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    strip = "list_transform({0}, lambda x: {{'s': x.s, 'k': x.k, 'e': x.e}})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cuts AS (SELECT doc_id, {_cut(0, secrets.ASSIGN)}, {_cut(1, secrets.ACCESS)}, {_cut(2, secrets.HEX)}, {_cut(3, secrets.CANDIDATE)} FROM d),
placed AS (SELECT doc_id,
  list_filter({_placed(0)}, lambda x: length(regexp_extract(regexp_replace(x.b, '^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?', ''), {body}, 1)) >= 6) AS m0,
  {_placed(1)} AS m1, {_placed(2)} AS m2, {_placed(3)} AS m3 FROM cuts),
based AS (SELECT doc_id, len(m0) AS n0, len(m1) AS n1, len(m2) AS n2,
  list_sort(list_concat(list_concat({strip.format("m0")}, {strip.format("m1")}), {strip.format("m2")})) AS base, m3 FROM placed),
cand AS (SELECT doc_id, base, unnest(m3) AS c FROM based),
judged AS (SELECT doc_id, c.s AS s, list_filter(range(1, length(c.b) - {w - 2}), lambda j: {entropy} >= {threshold}) AS hot FROM cand
  WHERE regexp_matches(c.b, '[0-9]') AND regexp_matches(c.b, '[A-Za-z]') AND {allowed}
  AND len(list_filter(base, lambda b: b.s <= c.s AND b.e >= c.e)) = 0),
extra AS (SELECT doc_id, list({{'s': (s + hot[1] - 1)::BIGINT, 'k': 3, 'e': (s + hot[-1] + {w - 1})::BIGINT}}) AS more FROM judged WHERE len(hot) > 0 GROUP BY doc_id)
SELECT b.doc_id, n0::BIGINT AS n_assign, n1::BIGINT AS n_access, n2::BIGINT AS n_hex,
  coalesce(len(more), 0)::BIGINT AS n_entropy,
  sha256({text.format("base")}) AS base_sha256,
  {text.format("list_sort(list_concat(base, coalesce(more, [])))")} AS spans
FROM based b LEFT JOIN extra USING (doc_id)"""


def quality_rules() -> str:
    """op3: windows as strings in rows, the binomial sum by the logarithm of the gamma function."""
    from trackmill.llm import quality_rules as q

    space = r"[\x20\x09-\x0D]+"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.RISK}) + (n - i) * ln(1 - {q.RISK}))"
    at = "CASE " + " ".join(f"WHEN {q.RULES[rule][0]} > {cut} THEN {i}" for i, (rule, cut) in enumerate(q.STEPS)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
copies AS (SELECT r, min(g) AS copy FROM (SELECT r, g, split_part(g, ' ', 1) AS a, min(split_part(g, ' ', 1)) OVER (PARTITION BY r) AS m FROM win) WHERE a = m GROUP BY r),
f AS (SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {at} AS hit FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
trials AS (SELECT stratum, copy, min(hit) AS hit FROM b JOIN copies USING (r) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum, copy),
tests AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (hit <= step) AS k FROM trials, (SELECT unnest(range(0, {len(q.STEPS)})) AS step) GROUP BY stratum, step),
judged AS (SELECT *, CASE WHEN k >= n * {q.RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END
  > {q.DELTA} / (SELECT count(DISTINCT stratum) FROM trials) AS fails FROM tests),
c AS (SELECT stratum, max(step) AS last FROM (SELECT *, bool_or(fails) OVER (PARTITION BY stratum ORDER BY step) AS stopped FROM judged) WHERE NOT stopped GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT coalesce(hit <= last, false)) AS kept
FROM b LEFT JOIN c USING (stratum)"""


def fill_in_middle() -> str:
    """op12: lines by the grammar itself, outputs by joining slices, and the text again by the pieces' places in the output."""
    draw = lambda k: f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT"
    join = lambda a, b: f"coalesce(array_to_string(u[{a}:{b}], ''), '')"
    part = lambda at, size: f"substr(o, ({at})::BIGINT, ({size})::BIGINT)"
    p, m, rest = "length(p)", "length(m)", "length(t) - length(p) - length(m)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u FROM d),
b AS (SELECT *, len(u)::BIGINT AS n, {draw(0)} % (len(u) + 1) AS x, {draw(1)} % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= 100 THEN 'plain' WHEN {draw(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
s AS (SELECT *, {join(1, "least(x, y)")} AS p, {join("least(x, y) + 1", "greatest(x, y)")} AS m, {join("greatest(x, y) + 1", "n")} AS z FROM b),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END AS o FROM s)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN {part("4", p)} || {part(f"10 + {p} + ({rest})", m)} || {part(f"7 + {p}", rest)}
    ELSE {part(f"7 + ({rest})", p)} || {part(f"10 + {p} + ({rest})", m)} || {part("4", rest)} END) AS restored_sha256
FROM o
"""
