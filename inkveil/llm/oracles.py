"""DuckDB SQL for the queries that SQL can express, written apart from the Spark plans."""

from __future__ import annotations

from inkveil.llm import decontaminate, quality

_W = "[\\x20\\x09-\\x0D]+"


def _numbers(values) -> str:
    return "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in values) + "]"


def _strings(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def quality_sql(documents: str = "documents") -> str:
    """``(doc_id, n_words, …, kept)`` by windows over exploded words, where Spark uses arrays within the row."""
    chars = ", ".join(_numbers([x / sum(ref) for x in ref]) for ref in quality.CHAR_REFERENCE.values())
    lists = ", ".join(_strings(ref) for ref in quality.WORD_REFERENCE.values())
    words = ", ".join(_numbers([x / 1000 for x in ref.values()] + [1 - sum(ref.values()) / 1000]) for ref in quality.WORD_REFERENCE.values())
    every = sorted({f for ref in quality.WORD_REFERENCE.values() for w in ref for f in (w, w.capitalize())})
    js = lambda p, q: (
        f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: "
        "CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0.0 END)) / 2))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
a AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{_W}'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
m AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) AS BIGINT) AS n_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[0-9]')) AS n_digits,
  len(regexp_extract_all(text, '[.,;:!?''"()-]')) AS n_punct,
  list_transform(list_filter(w, lambda x: list_contains({_strings(every)}, x)), lambda x: lower(x)) AS common FROM a LEFT JOIN rep USING (r)),
s AS (SELECT *, [n_upper / n_chars, n_digits / n_chars, n_punct / n_chars, n_symbols / n_chars, (n_chars - word_chars) / n_chars] AS c,
  list_transform([{lists}], lambda l: len(list_filter(common, lambda x: list_contains(l, x)))) AS listed FROM m),
t AS (SELECT *, list_append(c, greatest(0.0, 1 - list_sum(c))) AS cs, list_position(listed, list_max(listed)) AS lang FROM s),
u AS (SELECT *, list_transform(([{lists}])[lang], lambda x: len(list_filter(common, lambda y: y = x)) / n_words) AS held FROM t),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_append(held, greatest(0.0, 1 - list_sum(held))) AS ws, ([{words}])[lang] AS ref FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (n_words >= {quality.GUARD_CHARS} AND list_min(list_transform([{chars}], lambda q: {js("cs", "q")})) > {quality.MOST_CHARS})
  AND NOT (n_words >= {quality.GUARD_WORDS} AND {js("ws", "ref")} > {quality.MOST_WORDS}) AS kept
FROM v"""


def secrets_sql(documents: str = "documents") -> str:
    """Spans by splitting: the gaps between matches give the offsets."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    rules = [
        ("assign", f"({keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        ("slack", "xox[bpars]-[A-Za-z0-9-]{10,}", 0, 1),
        ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1),
        ("stripe", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 1),
        ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ]
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{rx}', 0) AS m, "
        f"regexp_extract_all(text, '{rx}', {group}) AS p, regexp_split_to_array(text, '{rx}') AS g FROM d"
        for k, (kind, rx, group, least) in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
f AS ({found}),
e AS (SELECT r, k, kind, least, unnest(m) AS m, unnest(p) AS p, unnest(g[1:len(m)]) AS g, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
o AS (SELECT r, k, kind, least, length(p) AS n, length(m) AS size,
  sum(length(g) + length(m)) OVER (PARTITION BY r, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM e),
s AS (SELECT r, k, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span, stop - size AS start FROM o WHERE n >= least),
t AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (k < 3), '') AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


def decontaminate_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """Windows as joined strings and an equality join, where Spark intersects posting lists."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM {documents}),
b AS (SELECT item_id, {split} AS w FROM {benchmark}),
q AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
t AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM d),
uw AS (SELECT g, unnest(list_distinct(string_split(g, ' '))) AS t FROM (SELECT DISTINCT g FROM q)),
c AS (SELECT t, count(*) AS c FROM t WHERE t IN (SELECT t FROM uw) GROUP BY t),
rare AS (SELECT g, t, need FROM (SELECT uw.g, uw.t, c.c, count(*) OVER (PARTITION BY g) AS need, row_number() OVER (PARTITION BY g ORDER BY c NULLS FIRST, t) AS n FROM uw LEFT JOIN c USING (t)) WHERE n = 1 AND c IS NOT NULL),
anchor AS (SELECT g, need, r, pos FROM rare JOIN t USING (t)),
close AS (SELECT a.g, a.r, a.pos FROM anchor a JOIN t ON t.r = a.r AND t.pos BETWEEN a.pos - {decontaminate.NEAR} AND a.pos + {decontaminate.NEAR} JOIN uw ON uw.g = a.g AND uw.t = t.t
  GROUP BY a.g, a.r, a.pos, a.need HAVING count(DISTINCT t.t) = a.need),
near AS (SELECT r, count(DISTINCT item_id) AS n FROM close JOIN q USING (g) GROUP BY r),
p AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT DISTINCT r, p.n, k, item_id FROM p JOIN q ON p.g = q.g AND p.n = q.n),
hit AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, n, k FROM h), (SELECT unnest(range(0, 10)) AS j) WHERE j < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)"""


def lines_sql(documents: str = "documents") -> str:
    """Lines exploded with running offsets; a window over equal normalised lines marks all but the first."""
    norm = "translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
l AS (SELECT r, doc_id, unnest(ls) AS l, unnest(range(0, len(ls))) AS line FROM d),
o AS (SELECT r, doc_id, line, l, sum(length(l) + 1) OVER (PARTITION BY r ORDER BY line ROWS UNBOUNDED PRECEDING) - length(l) - 1 AS start,
  list_filter(regexp_split_to_array(l, '{_W}'), lambda x: x <> '') AS w FROM l),
u AS (SELECT r, doc_id, line, start, start + length(l) AS stop, {norm} AS norm FROM o WHERE len(w) >= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, line, r) AS n FROM u),
g AS (SELECT r, count(*) AS n_units, count(*) FILTER (n > 1) AS n_removed, CAST(coalesce(sum(stop - start) FILTER (n > 1), 0) AS BIGINT) AS removed_chars,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start) FILTER (n > 1), '') AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed_chars, 0) AS removed_chars, coalesce(spans, '') AS spans,
  coalesce(n_removed, 0) > 0 AS repeats
FROM d LEFT JOIN g USING (r)"""
