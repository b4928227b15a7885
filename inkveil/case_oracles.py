"""What becomes of the sentences of :mod:`inkveil.sources.cases`, as DuckDB SQL: the rules written out by tier.

``f`` and ``l`` are the names, ``m`` the key modulo eight: 0 unlisted, 1 full name, 2 short form of the last name, 3 place,
4 title, 5 demonym (the last name), 6 settlement, 7 given (the first name).
"""

from __future__ import annotations

_P = "WITH p AS (SELECT c_custkey, 'Zor' || {d} AS f, 'Quin' || {d} AS l, c_custkey % 8 AS m FROM customer) ".format(d="translate(CAST(c_custkey AS VARCHAR), '0123456789', 'aeioubcdfg')")

#: A person in no tier is masked; full names, places and titles stay; a settlement is a location.
_WHO = "CASE WHEN m IN (1, 3, 4) THEN f || ' ' || l WHEN m = 6 THEN '{LOCATION_1}' ELSE '{NAME_1}' END"
#: The writer's own people: full names and titles are masked too, places aren't.
_OWN = "CASE WHEN m = 3 THEN f || ' ' || l WHEN m = 6 THEN '{LOCATION_1}' ELSE '{NAME_1}' END"


def _again(before: str, established: str) -> str:
    """A full name and then its surname; numbers are given from the right. ``established``: tiers whose surname stays."""
    last = f"CASE WHEN m IN ({established}) THEN l ELSE '{{NAME_1}}' END"
    number = f"CASE WHEN m IN ({established}) THEN 1 ELSE 2 END"
    first = f"CASE WHEN m IN (1, 3, 4) THEN f || ' ' || l WHEN m = 6 THEN '{{LOCATION_1}}' ELSE '{{NAME_' || {number} || '}}' END"
    return f"'We read ' || {first} || ' today. {before}' || {last} || ' spoke.'"


MASKED = {
    "plain": f"'Then we met ' || {_WHO} || ' at noon.'",
    "relation_before": f"'Then my cousin ' || {_OWN} || ' came by.'",
    "relation_after": f"'Then ' || {_OWN} || ', who is my uncle, came by.'",
    "surname_again": _again("Then ", "1, 2, 5"),
    "surname_in_own_life": _again("Then my neighbor ", "2"),
    "opening": "CASE WHEN m = 7 THEN '{NAME_1}' ELSE f END || ' left early.'",
    "opening_with_evidence": "replace('# left early. Nobody saw # again.', '#', CASE WHEN m IN (2, 5) THEN l ELSE '{NAME_1}' END)",
    "organisation": "'We sued ' || CASE WHEN m = 4 THEN f || ' ' || l || ' Bank' ELSE '{ORGANIZATION_1}' END || ' again.'",
    "landmark": "'We saw ' || f || ' ' || l || ' Museum again.'",
    "possessive": "'We took ' || CASE WHEN m IN (1, 3, 4) THEN f || ' ' || l || '''s' WHEN m = 6 THEN '{LOCATION_1}' ELSE '{NAME_1}' END || ' car.'",
    "in_braces": "'We met {' || l || '} and @PERSON1 there.'",
    "heading": "chr(10) || chr(10) || CASE WHEN m = 7 THEN '{NAME_1}' ELSE f || ' ' || l END || chr(10) || chr(10) || 'Then it rained all day.'",
    "honorific": "'We met {NAME_1} there.'",
    "over_lines": "'We met ' || f || chr(10) || l || ' there.'",
    "lower_case": "'then i met ' || CASE WHEN m = 7 THEN '{NAME_1}' ELSE lower(f) || ' ' || lower(l) END || ' again'",
    "stop_words": "'We asked The ' || CASE m WHEN 2 THEN l || ' And {NAME_1}' WHEN 5 THEN l || ' And {NAME_1}' WHEN 1 THEN l || ' And ' || f || ' ' || l WHEN 3 THEN '{NAME_1} And ' || f || ' ' || l "
    "WHEN 4 THEN l || ' And ' || f || ' ' || l WHEN 6 THEN '{NAME_1} And {LOCATION_1}' ELSE '{NAME_2} And {NAME_1}' END || ' about it.'",
}


#: Two digits of the key, and four.
_D2, _D4 = "lpad(CAST(c_custkey * 7 % 100 AS VARCHAR), 2, '0')", "lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR), 4, '0')"
_D3 = "lpad(CAST(c_custkey * 13 % 1000 AS VARCHAR), 3, '0')"
#: Identifiers of each kind, made of the key's digits, with what becomes of them.
STRUCTURED = {
    "ssn": f"CASE WHEN {_D3} IN ('000', '666') OR {_D3} >= '900' OR {_D2} = '00' OR {_D4} = '0000' THEN 'no ' || {_D3} || '-' || {_D2} || '-' || {_D4} || ' here' ELSE 'no {{US_SOCIAL_SECURITY_NUMBER_1}} here' END",
    "phone": f"'call {{PHONE_1}} or {{PHONE_2}}, not 1' || {_D3} || '555' || {_D4} || '.'",
    "address": "'at {ADDRESS_1}, then ' || c_custkey || ' Elm trees'",
    "birth": f"'{{DATE_OF_BIRTH_1}}; born in 1' || {_D3}",
    "username": "'ask {USERNAME_1}, not @PERSON1 or ab@' || l",
    "zip": f"'in OH {{ZIP_CODE_1}}. But 1' || {_D4} || ' apples'",
    "age": f"'I am {{AGE_1}}, and {{AGE_2}} years old is ' || {_D2} || ' more'".replace("{AGE_2}", f"' || CASE WHEN {_D2} = '33' THEN '{{AGE_1}}' ELSE '{{AGE_2}}' END || '"),
}


def oracle_sql() -> dict[str, str]:
    more = {
        "case_identity": f"{_P}SELECT c_custkey, 'By {{NAME_1}}, also {{NAME_2}} and {{NAME_3}}. ' || CASE WHEN c_custkey % 3 = 0 THEN 'Grace' ELSE '{{NAME_4}}' END || ' went to {{SCHOOL_1}}, {{SCHOOL_2}}, lqh.' AS masked_text FROM p",
        "case_carried": f"{_P}SELECT c_custkey, 'You said that ' || CASE WHEN m IN (1, 2, 5) THEN l ELSE '{{NAME_1}}' END || ' won.' AS masked_text FROM p",
        "case_uncorroborated": f"{_P}SELECT c_custkey, {_again('Then ', '2, 5')} AS masked_text FROM p",
        "case_unrelated": f"{_P}SELECT c_custkey, {MASKED['relation_before'].replace('m = 3', 'm IN (1, 3, 4)')} AS masked_text FROM p",
        "case_topical": f"{_P}SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'Then we met ' || f || ' ' || l || ' at noon.' ELSE {MASKED['plain']} END AS masked_text FROM p",
        "case_capitals_only": f"{_P}SELECT c_custkey, {MASKED['lower_case'].split('CASE')[0]} lower(f) || ' ' || lower(l) || ' again' AS masked_text FROM p",
    }
    whole = "f || ' ' || l"
    # By identity alone no name is masked; by the default level all but full names, places and titles. Base texts of every fifth
    # customer mention a surname, masked unless a tier keeps it, and a mark that an anonymiser left.
    seen = (
        "r AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'held' ELSE 'visible' END AS part, m IN (1, 3, 4) AS keep FROM p), "
        "s AS (SELECT 'local' AS mode, *, keep AS ok, 0 AS fp, CASE WHEN keep THEN 0 ELSE 1 END AS bad FROM r UNION ALL "
        "SELECT 'local-gazetteer-lowercase', *, true, CASE WHEN c_custkey % 5 = 0 AND m NOT IN (2, 5) THEN 1 ELSE 0 END, 0 FROM r) "
    )
    rate = lambda keep, part: f"avg(CASE WHEN keep = {keep}{f' AND part = {chr(39)}{part}{chr(39)}' if part else ''} THEN CASE WHEN ok THEN 100.0::DOUBLE ELSE 0 END END)"
    rates = ", ".join(f"{rate(keep, part)} AS {name}_{split}" for name, keep in (("recall", "false"), ("precision", "true")) for split, part in (("all", ""), ("visible", "visible"), ("held_out", "held")))
    more |= {
        "evaluation_summary": f"{_P}, {seen}SELECT mode, count(*) AS cases, count(*) FILTER (NOT keep) AS recall_spans, count(*) FILTER (keep) AS precision_spans, CAST(sum(bad) AS BIGINT) AS violations, 100.0::DOUBLE AS round_trip_rate, "
        f"1.0::DOUBLE AS units_mean, avg(fp) AS over_fire_spans, avg(CASE WHEN fp = 1 THEN length(l) ELSE 0 END) AS over_fire_chars, 0.0::DOUBLE AS rewrites, {rates} FROM s GROUP BY mode",
        # Candidates without an oracle lose what is to stay; with one, all is as it should be.
        "evaluation_frames": f"{_P} SELECT mode, 'plain [' || v || ']' AS frame, CAST(sum(CASE WHEN mode = 'path-gazetteer' OR v = 'redact' THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total "
        "FROM (SELECT CASE WHEN m IN (1, 3, 4) THEN 'keep' ELSE 'redact' END AS v FROM p), (VALUES ('local-candidates'), ('path-gazetteer')) t(mode) GROUP BY mode, v",
        "frame_violations": f"{_P}, k AS (SELECT *, c_custkey % 5 AS d, c_custkey % 7 = 0 AS keep FROM p) SELECT c_custkey, 'leak' AS kind, {whole} AS detail FROM k WHERE d = 1 AND NOT keep UNION ALL SELECT c_custkey, 'partial-leak', {whole} FROM k WHERE d = 2 AND NOT keep "
        f"UNION ALL SELECT c_custkey, 'keep-destroyed', {whole} FROM k WHERE d <> 1 AND keep UNION ALL SELECT c_custkey, 'unknown-placeholder', 'ODD' FROM k WHERE d = 3 UNION ALL SELECT c_custkey, 'chunk-alignment', '' FROM k WHERE d = 4 "
        "UNION ALL SELECT c_custkey, 'not-restorable', '' FROM k WHERE d IN (2, 3, 4)",
        "wrong_types": f"{_P} SELECT c_custkey AS frame_id, 'LOCATION' AS token_kind, {whole} AS region FROM p WHERE m = 6 AND c_custkey % 3 <> 0",
        "overfire_levels": f"{_P}, o AS (SELECT *, CASE WHEN m IN (1, 2, 5) THEN 0 ELSE 1 END AS first, CASE WHEN m = 1 THEN 0 ELSE 1 END AS second FROM p), "
        "t AS (SELECT 2 * count(*) AS d, count(*) AS g, CAST(sum(length('You said that ' || l || ' won.') + length('Then say who ' || f || ' is.')) AS BIGINT) AS c, CAST(sum(first + second) AS BIGINT) AS s FROM o) "
        "SELECT 'identity' AS level, d AS documents, g AS groups, c AS characters, 0 AS spans, 0 AS documents_touched, 0.0::DOUBLE AS per_document, 0.0::DOUBLE AS per_group, 0.0::DOUBLE AS per_1k FROM t "
        "UNION ALL SELECT 'gazetteer-lowercase', d, g, c, s, s, s / d, s / g, s / c * 1000 FROM t",
        "overfire_spans": f"{_P} SELECT 'gazetteer-lowercase' AS level, l AS original, 1 AS n FROM p WHERE m NOT IN (1, 2, 5) UNION ALL SELECT 'gazetteer-lowercase', f, 1 FROM p WHERE m <> 1",
        "label_predicates": "SELECT p_name AS label, count(*) AS n, max(p_partkey % 200) AS links FROM part WHERE p_partkey % 200 >= 30 AND substr(p_brand, 7, 1) IN ('1', '2') AND p_size <= 40 AND p_name IS NOT NULL GROUP BY p_name",
    }
    structured = {f"structured_{k}": f"{_P}SELECT c_custkey, {v.replace('{{', '{').replace('}}', '}')} AS masked_text FROM p JOIN customer USING (c_custkey)" for k, v in STRUCTURED.items()}
    return more | structured | {f"case_{k}": f"{_P}SELECT c_custkey, {v} AS masked_text FROM p" for k, v in MASKED.items()}
