"""DuckDB SQL of the queries. Patterns follow the contract: words are runs of characters other than
space and the controls 9 to 13."""

ORACLES: dict[str, str] = {}

_WS = r"[\x20\x09-\x0D]+"

ORACLES["op1_line_frequency"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS host FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '{_WS}'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_WS}', '', 'g') <> '') AS ls FROM d
), lines AS (
  SELECT doc_id, host, t, lower(trim(regexp_replace(l, '{_WS}', ' ', 'g'))) AS l, length(regexp_replace(l, '^{_WS}|{_WS}$', '', 'g')) AS c
  FROM (SELECT doc_id, host, t, unnest(ls) AS l FROM w)
), docs AS (
  SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host
), freq AS (
  SELECT l.host, l.l FROM (SELECT host, l, count(DISTINCT t) AS n FROM lines GROUP BY host, l) l JOIN docs ON docs.host = l.host
  WHERE (l.n >= 10 AND l.n > docs.n * 0.1) OR l.n > 10000
), gone AS (
  SELECT doc_id, count(f.l) AS k, coalesce(sum(c) FILTER (f.l IS NOT NULL), 0) AS gc, sum(c) AS ac
  FROM lines LEFT JOIN freq f ON f.host = lines.host AND f.l = lines.l GROUP BY doc_id
), win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
    coalesce(k, 0)::BIGINT AS n_removed_lines, coalesce(gc, 0)::BIGINT AS removed_chars, coalesce(ac, 0) AS ac
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (ac - removed_chars < ac * 0.2) AS kept,
  n_removed_lines, removed_chars, (ac - removed_chars < ac * 0.2) AS depleted
FROM c
"""

ORACLES["op3_block_naming"] = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

ORACLES["op8_schema_fingerprint"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def _licences() -> str:
    from draftlake.llm.licences import PHRASES, TEMPLATES, THRESHOLD, template_words, window_words

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in PHRASES.items())
    templates = ", ".join(
        f"({i}, {quote(label)}, [{', '.join(map(quote, sorted(template_words(t))))}], {window_words(t)})"
        for i, (label, t) in enumerate(TEMPLATES)
    )
    return rf"""
WITH p(phrase, label) AS (VALUES {phrases}), t(i, label, words, size) AS (VALUES {templates}), d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '{sep}'), lambda x: x <> '') AS ws FROM d
), places AS (
  SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) s
  JOIN p ON list_slice(ws, i, i + len(string_split(phrase, ' ')) - 1) = string_split(phrase, ' ')
), base AS (
  SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS ls FROM places GROUP BY doc_id
), near AS (
  SELECT doc_id, ws, label, words, size FROM w CROSS JOIN t WHERE len(list_intersect(ws, words)) >= ceil(len(words) * {THRESHOLD} - 1e-9)
), windows AS (
  SELECT doc_id, label, words, list_slice(ws, i, i + size - 1) AS ws FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM near)
  WHERE list_contains(words, ws[i])
), hits AS (
  SELECT doc_id, list(DISTINCT label) AS ls, max(len(list_intersect(ws, words)) / len(words)) AS s FROM windows
  WHERE len(list_intersect(ws, words)) >= ceil(len(words) * {THRESHOLD} - 1e-9) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(hits.ls, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(s, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN hits USING (doc_id)
"""


ORACLES["op7_template_join"] = _licences()
