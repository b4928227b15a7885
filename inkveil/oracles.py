"""DuckDB SQL for the library's queries, each written apart from its Spark plan."""

from __future__ import annotations

from inkveil import case_oracles
from inkveil.functions.lexicon import KEY_PARTICLES, LANDMARK_SUFFIXES, ORG_SUFFIXES, stop_words

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = "\\b[A-Za-z0-9_.%+-]+@([A-Za-z0-9-]+\\.)+[A-Za-z]{2,}\\b"
URL = "\\b(https?://[^\\s<>\"'']+|www(\\.[A-Za-z0-9-]+){2,}[^\\s<>\"'']*)"
IP = f"\\b{_OCTET}(\\.{_OCTET}){{3}}\\b"
CARD = "\\b([0-9][ -]?){12,18}[0-9]\\b"
TOKEN = "[A-Za-z][A-Za-z''’-]*"
#: White space of the features, and what is not.
_S, _NS = "[ \\t\\n\\x0b\\f\\r]", "[^ \\t\\n\\x0b\\f\\r]"
_KINDS = {"EMAIL": EMAIL, "URL": URL, "IP_ADDRESS": IP, "CREDIT_DEBIT_CARD_NUMBER": CARD}
_DIGITS = "list_reverse(string_split(regexp_replace({m}, '[^0-9]', '', 'g'), ''))"
_LUHN = (
    "(list_sum(list_transform({d}, lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) * 2 > 9 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0)"
)


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words))


def _step(n: int, kind: str, rx: str) -> str:
    """One masking step: matches as rows, numbered by where their original first comes up, joined up again."""
    ok = _LUHN.format(d=_DIGITS.format(m="m")) if kind.startswith("CREDIT") else "true"
    return f"""
x{n} AS (SELECT r, regexp_extract_all(t, '{rx}', 0) AS h, regexp_split_to_array(t, '{rx}') AS g FROM s{n - 1}),
m{n} AS (SELECT r, unnest(h) AS m, unnest(range(1, len(h) + 1)) AS i FROM x{n} WHERE len(h) > 0),
k{n} AS (SELECT *, {ok} AS ok FROM m{n}),
f{n} AS (SELECT *, min(CASE WHEN ok THEN i END) OVER (PARTITION BY r, m) AS first FROM k{n}),
d{n} AS (SELECT *, CASE WHEN ok THEN dense_rank() OVER (PARTITION BY r, ok ORDER BY first) END AS idx FROM f{n}),
j{n} AS (SELECT d.r, string_agg(CASE WHEN ok THEN '{{{kind}_' || idx || '}}' ELSE m END || x.g[d.i + 1], '' ORDER BY i) AS tail, count(*) FILTER (ok) AS n FROM d{n} d JOIN x{n} x USING (r) GROUP BY d.r),
s{n} AS (SELECT s.r, CASE WHEN j.r IS NULL THEN s.t ELSE x.g[1] || j.tail END AS t, s.n + coalesce(j.n, 0) AS n FROM s{n - 1} s JOIN x{n} x USING (r) LEFT JOIN j{n} j USING (r))"""


def _mask(source: str, key: str, col: str, kinds: list[str]) -> str:
    steps = ",".join(_step(k + 1, kind, _KINDS[kind]) for k, kind in enumerate(kinds))
    return (
        f"WITH b AS (SELECT row_number() OVER () AS r, {key}, coalesce({col}, '') AS t0 FROM {source}), s0 AS (SELECT r, t0 AS t, 0 AS n FROM b),{steps}\n"
        f"SELECT b.{key}, s.t AS masked_text, CAST(s.n AS BIGINT) AS n_masked FROM b JOIN s{len(kinds)} s USING (r)"
    )


_TOKENS = f"""
p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}', 0) AS h, regexp_split_to_array(coalesce(text, ''), '{TOKEN}') AS g FROM documents),
q AS (SELECT doc_id, unnest(h) AS token, unnest(g[1:len(h)]) AS gap, unnest(range(0, len(h))) AS pos FROM p WHERE len(h) > 0),
tok AS (SELECT doc_id, pos, token, CAST(sum(length(token) + length(gap)) OVER w - length(token) AS BIGINT) AS start, CAST(sum(length(token) + length(gap)) OVER w AS BIGINT) AS stop
  FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""

_HEADS = """
hl AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
hs AS (SELECT *, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS b, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(l) - 1 AS start FROM hl),
hp AS (SELECT *, coalesce(lag(b = '') OVER (PARTITION BY doc_id ORDER BY i), true) AS after_blank FROM hs),
heads AS (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(l) AS BIGINT) AS stop FROM hp WHERE after_blank AND b <> '' AND length(b) < 60 AND NOT regexp_matches(b, '[.!?]$'))"""


def _spans(rx: str) -> str:
    return f"""
a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{rx}', 0) AS h, regexp_split_to_array(coalesce(text, ''), '{rx}') AS g FROM documents),
u AS (SELECT doc_id, unnest(h) AS m, unnest(g[1:len(h)]) AS gap, unnest(range(0, len(h))) AS i FROM a WHERE len(h) > 0),
sp AS (SELECT doc_id, m, CAST(sum(length(m) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(m) AS BIGINT) AS start FROM u)"""


_KEY = "lower(translate({c}, '#_', '  '))"
_GAZ = f"""
gz AS (SELECT (['place', 'full', 'title'])[n_nationkey % 3 + 1] AS tier, {_KEY.format(c="n_name")} AS key FROM nation
  UNION ALL SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'short' ELSE 'demonym' END, {_KEY.format(c="r_name")} FROM region
  UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'full' ELSE 'title' END, {_KEY.format(c="c_name")} FROM customer
  UNION ALL SELECT 'title', {_KEY.format(c="c_name")} FROM customer WHERE c_custkey % 6 = 0)"""

_FOLD = "trim(regexp_replace(lower(translate({c}, '_', ' ')), '[^a-z0-9''-]+', ' ', 'g'))"
_TIERS = f"""
lab AS (SELECT {_FOLD.format(c="p_name")} AS key, max(p_partkey % 200) AS links FROM part WHERE p_partkey % 200 > 0 GROUP BY 1),
one AS (SELECT 'w' || (p_partkey % 90) AS key, max(p_partkey % 200) AS links FROM part WHERE p_partkey % 200 > 0 GROUP BY 1),
town AS (SELECT {_FOLD.format(c="n_name")} AS key, max(n_nationkey * 20) AS links FROM nation WHERE n_nationkey > 0 GROUP BY 1),
census AS (SELECT 'w' || (c_custkey % 90) AS name, max(c_custkey * 37 % 40000) AS bearers FROM customer GROUP BY 1),
births AS (SELECT 'w' || (s_suppkey % 50) AS name, sum(s_suppkey * 53 % 3600) AS births FROM supplier GROUP BY 1),
given AS (SELECT name AS key FROM births WHERE births >= 1800 AND length(name) >= 2 AND NOT regexp_matches(name, '[-'']')),
wide AS (SELECT key, links, string_split(key, ' ') AS w FROM lab),
full_ AS (SELECT key FROM lab WHERE contains(key, ' ') UNION SELECT w[1] || ' ' || w[3] FROM wide WHERE links >= 100 AND len(w) = 3 AND len(list_filter(w, lambda x: list_contains([{_list(KEY_PARTICLES)}], x))) = 0),
sf AS (SELECT w[-1] AS key FROM wide WHERE links >= 100 AND len(w) >= 2
  UNION SELECT w[-2] || ' ' || w[-1] FROM wide WHERE links >= 100 AND len(w) >= 2 AND list_contains([{_list(KEY_PARTICLES)}], w[-2])
  UNION SELECT w[-3] || ' ' || w[-2] || ' ' || w[-1] FROM wide WHERE links >= 100 AND len(w) >= 3 AND list_contains([{_list(KEY_PARTICLES)}], w[-3])),
short_ AS (SELECT key FROM sf LEFT JOIN census ON key = name WHERE coalesce(bearers, 0) < 25000),
place_ AS (SELECT key FROM town WHERE links >= CASE WHEN contains(key, ' ') THEN 30 ELSE 150 END),
title_ AS (SELECT key FROM wide WHERE links >= 10 AND len(w) >= 2 AND len(list_filter(w, lambda x: NOT list_contains([{_list(stop_words())}], x))) > 0),
dem_ AS (SELECT key FROM one LEFT JOIN census ON key = name WHERE key NOT IN (SELECT key FROM given) AND coalesce(bearers, 0) < 10000),
towns AS (SELECT key, max(links) AS links FROM (SELECT * FROM one UNION ALL SELECT * FROM town) GROUP BY key),
set_ AS (SELECT key FROM towns LEFT JOIN census ON key = name WHERE links >= 30 AND key NOT IN (SELECT key FROM given) AND coalesce(bearers, 0) < 10000 AND key NOT IN (SELECT key FROM place_)),
tiers AS (SELECT 'full' AS tier, key FROM full_ UNION ALL SELECT 'short', key FROM short_ UNION ALL SELECT 'place', key FROM place_ UNION ALL SELECT 'given', key FROM given
  UNION ALL SELECT 'title', key FROM title_ UNION ALL SELECT 'demonym', key FROM dem_ UNION ALL SELECT 'settlement', key FROM set_)"""


def oracle_sql() -> dict[str, str]:
    core = ["EMAIL", "URL", "IP_ADDRESS", "CREDIT_DEBIT_CARD_NUMBER"]
    stub = "coalesce(text, '')"
    # Word boundaries here know ASCII only. A letter between other letters is one inside a word, so letters that aren't
    # ASCII stand between two marked ones while the patterns with boundaries run.
    for kind, rx in (
        ("EMAIL", "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+"), ("US_SOCIAL_SECURITY_NUMBER", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b"),
        ("CREDIT_DEBIT_CARD_NUMBER", "\\b([0-9][ -]?){13,16}\\b"), ("PHONE", "\\b(\\+?1[-.\\s]?)?\\(?[0-9]{3}\\)?[-.\\s]?[0-9]{3}[-.\\s]?[0-9]{4}\\b"),
        ("IP_ADDRESS", "\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b"),
    ):
        stub = f"regexp_replace({stub}, '{rx}', '{{{kind}}}', 'g')"
        if kind == "EMAIL":
            stub = f"regexp_replace({stub}, '([^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}])', 'q' || chr(2) || '\\1' || chr(2) || 'q', 'g')"
    stub = f"replace(replace({stub}, 'q' || chr(2), ''), chr(2) || 'q', '')"
    # Letters whose marks DuckDB strips, curly quotes and dashes made plain, then letters, digits, ' and - only.
    plain = "translate(x, '‘’ʼ′‐‑‒–—−', repeat(chr(39), 4) || '------')"
    key = f"trim(regexp_replace(lower(regexp_replace(strip_accents({plain}), '\\p{{Mn}}', '', 'g')), '[^\\p{{L}}\\p{{N}}''-]+', ' ', 'g'))"
    tail = "CASE WHEN (ends_with(k, '''s') OR ends_with(k, 's''')) AND length(k) > 3 THEN trim(rtrim(k[:length(k) - 2], '''')) ELSE k END"
    suffix = "lower(regexp_replace(list_extract(string_split(name, ' '), -1), '^[.,]+|[.,]+$', '', 'g'))"
    return case_oracles.oracle_sql() | {
        "mask_structured_core": _mask("documents", "doc_id", "text", core),
        "mask_email": _mask("documents", "doc_id", "text", ["EMAIL"]),
        "mask_ip": _mask("documents", "doc_id", "text", ["IP_ADDRESS"]),
        "mask_card_luhn": _mask("documents", "doc_id", "text", ["CREDIT_DEBIT_CARD_NUMBER"]),
        "mask_url_pages": _mask("pages", "page_id", "html", ["URL"]),
        "restore_roundtrip": "SELECT doc_id, true AS same, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM documents",
        "stub_mask": f"SELECT doc_id, md5({stub}) AS masked_md5 FROM documents",
        "kind_counts": "WITH o AS (" + _mask("documents", "doc_id", "text", core) + "), k AS (SELECT doc_id, unnest(regexp_extract_all(masked_text, '\\{([A-Z_]+?)(_[0-9]+)?\\}', 1)) AS kind FROM o) "
        "SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY kind",
        "minted_dense_rank": f"WITH {_spans(IP)}, fs AS (SELECT *, min(start) OVER (PARTITION BY doc_id, m) AS first FROM sp) "
        "SELECT doc_id, start, m AS text, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS idx FROM fs",
        "token_offsets": f"WITH {_TOKENS} SELECT doc_id, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends, CAST(sum(start * (pos + 1)) AS BIGINT) AS weighted FROM tok GROUP BY doc_id",
        "stopword_filter": f"WITH {_TOKENS} SELECT doc_id, count(*) AS n_stop, count(DISTINCT lower(token)) AS n_words FROM tok "
        f"WHERE trim(regexp_replace(lower(token), '^(.+?)(n[''’]t|[''’](re|ve|ll|s|m|d|t))$', '\\1'), '''’') IN ({_list(stop_words())}) GROUP BY doc_id",
        "heading_lines": f"WITH {_HEADS} SELECT doc_id, start, stop FROM heads",
        "allcaps_runs": f"WITH {_TOKENS}, c AS (SELECT *, length(token) > 1 AND upper(token) = token AND lower(token) <> token AS caps FROM tok), "
        "g AS (SELECT *, sum(CASE WHEN caps THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM c) "
        "SELECT doc_id, min(start) AS start, max(stop) AS stop, count(*) AS n, count(*) < 3 AS emphasis FROM g WHERE caps GROUP BY doc_id, grp",
        "capitalisation_habit": f"WITH {_HEADS}, {_spans('[A-Z][a-z]{2,}')}, e AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
        f"k AS (SELECT sp.doc_id, sp.start, sp.start + length(m) AS stop FROM sp JOIN e USING (doc_id) WHERE start >= 2 AND regexp_matches(substr(text, CAST(start AS INT) - 1, 2), '[a-z,;:]{_S}')), "
        "o AS (SELECT doc_id, count(*) AS marks FROM k WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = k.doc_id AND k.start < h.stop AND k.stop > h.start) GROUP BY doc_id), "
        f"c AS (SELECT doc_id, coalesce(marks, 0) AS marks, CAST(len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*', 0), lambda x: regexp_matches(x, '{_NS}'))) AS BIGINT) AS units, "
        f"CAST(len(regexp_extract_all(chr(1) || text, '(\\x01|[.!?]{_S}){_S}*[a-z]', 0)) AS BIGINT) AS openings, "
        "regexp_matches(text, '(^|[^\\p{L}\\p{N}_])i($|[^\\p{L}\\p{N}_])') AS bare_i FROM e LEFT JOIN o USING (doc_id)) "
        "SELECT *, CASE WHEN marks < 2 THEN CASE WHEN bare_i OR openings > 0 THEN 'lowercase' ELSE 'silent' END WHEN bare_i OR openings / greatest(1, units) >= 0.10 THEN 'inconsistent' ELSE 'consistent' END AS habit FROM c",
        "candidate_spans": f"WITH {_spans('[A-Z][a-z]+( [A-Z][a-z]+)+')} SELECT doc_id, start, m AS text FROM sp",
        "org_suffix_classify": "WITH n AS (SELECT p_partkey, p_name || ' ' || (['Bank', 'School', 'Park', 'Museum', 'Smith'])[p_partkey % 5 + 1] AS name FROM part) "
        f"SELECT p_partkey, CASE WHEN {suffix} IN ({_list(ORG_SUFFIXES)}) THEN 'ORGANIZATION' WHEN contains(name, ' ') AND {suffix} IN ({_list(LANDMARK_SUFFIXES)}) THEN 'LANDMARK' ELSE 'NAME' END AS kind FROM n",
        "title_ngrams": f"WITH {_TOKENS}, w AS (SELECT doc_id, pos, replace(lower(token), '’', '''') AS t FROM tok), "
        f"tl AS (SELECT DISTINCT regexp_extract_all(l, '{TOKEN}', 0) AS ts FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)), "
        "k AS (SELECT DISTINCT len(ts) AS n, replace(lower(array_to_string(ts, ' ')), '’', '''') AS key FROM tl WHERE len(ts) BETWEEN 2 AND 8), "
        "r AS (SELECT doc_id, pos, list(t) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ts FROM w), "
        "x AS (SELECT doc_id, pos, n, array_to_string(ts[1:n], ' ') AS key FROM r, (SELECT unnest(range(2, 9)) AS n) WHERE len(ts) >= n) "
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(max(x.n) AS BIGINT) AS n FROM x JOIN k USING (n, key) GROUP BY doc_id, pos",
        "tier_lookup": f"WITH {_GAZ}, nm AS (SELECT {_KEY.format(c='c_name')} AS key FROM customer UNION ALL SELECT {_KEY.format(c='n_name')} FROM nation UNION ALL SELECT {_KEY.format(c='r_name')} FROM region), "
        "h AS (SELECT nm.key, (SELECT list(DISTINCT tier) FROM gz WHERE gz.key = nm.key) AS ts FROM nm), "
        "t AS (SELECT key, CASE WHEN list_contains(ts, 'place') THEN 'place' WHEN NOT contains(key, ' ') THEN CASE WHEN list_contains(ts, 'short') THEN 'iconic_short' WHEN list_contains(ts, 'demonym') THEN 'demonym' ELSE 'not_notable' END "
        f"WHEN len(string_split(key, ' ')) <= 3 AND string_split(key, ' ')[1] IN ({_list(KEY_PARTICLES)}) AND list_contains(ts, 'short') THEN 'iconic_short' "
        "WHEN list_contains(ts, 'full') THEN 'full_name' WHEN list_contains(ts, 'title') THEN 'title' ELSE 'not_notable' END AS tier FROM h) "
        "SELECT tier, count(*) AS n, min(key) AS low, max(key) AS high FROM t GROUP BY tier",
        "surname_corroboration": f"WITH {_spans('[A-Z][a-z]+( [A-Z][a-z]+)*')}, k AS (SELECT doc_id, start, lower(m) AS key FROM sp) "
        "SELECT doc_id, start, key FROM k WHERE NOT contains(key, ' ') AND EXISTS (SELECT 1 FROM k f WHERE f.doc_id = k.doc_id AND contains(f.key, ' ') AND string_split(f.key, ' ')[-1] = k.key)",
        "fold_names": "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS ws FROM documents), "
        f"f AS (SELECT doc_id, list_transform(list_transform(ws, lambda x: {key}), lambda k: {tail}) AS keys FROM w) "
        "SELECT doc_id, CAST(len(keys) AS BIGINT) AS n_tokens, md5(array_to_string(keys, ' ')) AS keys_md5 FROM f",
        "build_tiers": f"WITH {_TIERS} SELECT tier, count(*) AS n, min(key) AS low, max(key) AS high FROM tiers GROUP BY tier",
        "gazetteer_counts": f"WITH {_TIERS} SELECT tier, count(DISTINCT key) AS n, max(len(string_split(key, ' '))) AS most_tokens FROM tiers GROUP BY tier",
        "census_exposure": f"WITH {_TIERS}, single AS (SELECT DISTINCT tier, key FROM tiers WHERE tier IN ('short', 'place', 'demonym') AND NOT contains(key, ' ')), "
        "tot AS (SELECT CAST(sum(bearers) AS BIGINT) AS bearers, count(*) AS names FROM census), "
        "hit AS (SELECT tier, name, c.bearers AS b FROM census c JOIN single ON name = key) "
        "SELECT tier, (SELECT bearers FROM tot) AS bearers, CAST(sum(b) AS BIGINT) AS exposed_bearers, (SELECT names FROM tot) AS names, count(*) AS exposed_names FROM hit GROUP BY tier "
        "UNION ALL SELECT NULL, (SELECT bearers FROM tot), CAST(coalesce(sum(b), 0) AS BIGINT), (SELECT names FROM tot), count(*) FROM (SELECT DISTINCT name, b FROM hit)",
        "overfire_by_source": "WITH o AS (" + _mask("documents", "doc_id", "text", core) + ") SELECT source, count(*) AS docs, CAST(sum(CASE WHEN n_masked > 0 THEN 1 ELSE 0 END) AS BIGINT) AS docs_touched, "
        "CAST(sum(n_masked) AS BIGINT) AS spans, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, sum(n_masked) / count(*) AS per_doc, "
        "CASE WHEN sum(length(coalesce(text, ''))) > 0 THEN sum(n_masked) * 1000 / sum(length(coalesce(text, ''))) END AS per_1k FROM o JOIN documents USING (doc_id) GROUP BY source",
        "tally_grouping_sets": "SELECT held_out, verdict, frame_id, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total FROM "
        "(SELECT o_orderkey % 2 = 0 AS held_out, o_orderstatus AS verdict, o_orderpriority AS frame_id, o_totalprice > 100000 AS passed FROM orders) "
        "GROUP BY GROUPING SETS ((held_out, verdict), (verdict), (frame_id), ())",
        "billed_units": "SELECT source, count(*) AS calls, CAST(sum(ceil(length(coalesce(text, '')) / 1000)) AS BIGINT) AS units FROM documents GROUP BY source",
        "corpus_band_select": "SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS sha256 FROM (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents) WHERE length(t) BETWEEN 1000 AND 4000 ORDER BY doc_id LIMIT 20",
        "sidecar_resume": "SELECT mode, essay_id FROM (SELECT doc_id AS essay_id, unnest(['local', 'stub']) AS mode FROM documents) EXCEPT ALL SELECT CASE WHEN toxic = 1 THEN 'stub' ELSE 'local' END, doc_id FROM labels",
        "latency_percentiles": "SELECT event_type, CAST(len(v) AS BIGINT) AS n, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS INT) + 1] AS p95, v[-1] AS most "
        "FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)",
        "carrier_injection": "WITH i AS (SELECT row_number() OVER (ORDER BY item_id, text) - 1 AS f, text FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark), "
        "e AS (SELECT doc_id, coalesce(text, '') AS text, CAST(floor(length(coalesce(text, '')) * 2 / 3) AS INT) AS hi, CAST(floor(length(coalesce(text, '')) / 3) AS INT) AS lo, doc_id % n.n AS a, (doc_id + 1) % n.n AS b FROM documents, n), "
        "j AS (SELECT e.*, CASE WHEN hi = lo AND b > a THEN y.text ELSE x.text END AS later, CASE WHEN hi = lo AND b > a THEN x.text ELSE y.text END AS sooner FROM e JOIN i x ON x.f = e.a JOIN i y ON y.f = e.b), "
        "o AS (SELECT doc_id, substr(text, 1, lo) || sooner || ' ' || substr(text, lo + 1, hi - lo) || later || ' ' || substr(text, hi + 1) AS t FROM j) "
        "SELECT doc_id AS essay_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM o",
        "corpus_reconciliation": "SELECT doc_id AS essay_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "json_fields": "SELECT event_id, event_type || '|' || event_type AS fields FROM events",
        "manifest_digests": "SELECT item_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM benchmark",
        "held_out_figures": f"WITH {_TIERS}, k AS (SELECT DISTINCT key FROM tiers WHERE tier IN ('full', 'short', 'place', 'title', 'demonym')), "
        "p AS (SELECT lower(p_name) AS f, string_split(lower(p_name), ' ')[-1] AS s, p_size % 5 AS domain FROM part) "
        "SELECT domain, count(*) AS n, avg(CASE WHEN f IN (SELECT key FROM k) THEN 1.0 ELSE 0.0 END) AS full_kept, avg(CASE WHEN s IN (SELECT key FROM k) THEN 1.0 ELSE 0.0 END) AS surname_kept FROM p GROUP BY domain",
        "gates_report": f"WITH {_TIERS}, v AS (SELECT 'held_out_recall' AS gate, avg(CASE WHEN o_totalprice > 0 THEN 100.0::DOUBLE ELSE 0 END) AS value FROM orders "
        "UNION ALL SELECT 'keep_precision', avg(CASE WHEN o_orderstatus <> 'P' THEN 100.0::DOUBLE ELSE 0 END) FROM orders UNION ALL SELECT 'round_trip', avg(CASE WHEN p_size > 0 THEN 100.0::DOUBLE ELSE 0 END) FROM part "
        "UNION ALL SELECT 'unaccounted_violations', sum(CASE WHEN p_name IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM part UNION ALL SELECT 'over_fire_prose', avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0 END) FROM orders "
        "UNION ALL SELECT 'asset_entries', count(*)::DOUBLE FROM tiers), "
        "g AS (SELECT * FROM (VALUES ('held_out_recall', '>=', 100.0::DOUBLE), ('held_out_recall_carrier', '>=', 100.0), ('keep_precision', '>=', 100.0), ('round_trip', '>=', 100.0), ('unaccounted_violations', '==', 0.0), "
        "('over_fire_prose', '<=', 0.61), ('bare_surname_exposure', '<=', 1.25), ('latency_regression', '<=', 8.0), ('asset_entries', '>=', 1.0)) t(gate, op, bar)) "
        "SELECT g.gate, g.op, g.bar, v.value, CASE WHEN v.value IS NULL THEN 'NOT_MEASURED' WHEN CASE g.op WHEN '>=' THEN v.value >= g.bar WHEN '<=' THEN v.value <= g.bar ELSE v.value = g.bar END THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g LEFT JOIN v USING (gate)",
        "batch_join_split": "SELECT conv_id, turn, text AS masked_text, true AS batched FROM conversations",
        "stream_event_windows": "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
        "session_counts": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), "
        "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) "
        "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid",
    }
