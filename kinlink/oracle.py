"""SQL that must give the rows of the core queries, for an engine that shares nothing with Spark.

Strings are prepared without a full Unicode normalizer: the compatibility characters that occur are translated, then
accents are stripped. Tests compare that with Python's unicodedata on every value.
"""

from __future__ import annotations

from kinlink.functions.wordlists import ADDRESS_NOISE, ADDRESS_STOP, ADDRESS_WORDS, LEGAL_SUFFIXES, LEGAL_TERMS
from kinlink.operators.retrieval import budgets

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_BLANKS = "".join(map(chr, [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
_VOWEL_SIGNS = "".join(map(chr, [0x901, 0x902, 0x903, *range(0x93E, 0x94D), 0x34F]))
_DROPPED = "".join(map(chr, [0x93C, 0x94D]))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _compat(c: str) -> str:
    """Full-width forms, blanks and ligatures in their ordinary form. Vowel signs part words, as they are no word characters;
    other Devanagari marks vanish."""
    c = f"translate(coalesce({c}, ''), {_q(_FULL + _BLANKS)}, {_q(_PLAIN + ' ' * len(_BLANKS))})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("‑", "‐")):
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


def clean_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({_compat(c)}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_]+', ' ', 'g'))"


def fold_sql(c: str) -> str:
    c = f"translate({_compat(c)}, {_q(_VOWEL_SIGNS + _DROPPED)}, {_q(' ' * len(_VOWEL_SIGNS))})"
    return f"replace(replace(lower(strip_accents({c})), 'ß', 'ss'), 'ς', 'σ')"


def words_sql(c: str) -> str:
    return f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"


def normal_name_sql(c: str) -> str:
    t = words_sql(fold_sql(c))
    return f"(SELECT array_to_string(list_slice(t, 1, coalesce(list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_contains({_list(LEGAL_SUFFIXES)}, t[i]) THEN 0 ELSE i END)), 0)), ' ') FROM (SELECT {t} AS t))"


def normal_address_sql(c: str) -> str:
    cases = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in ADDRESS_WORDS.items())
    return f"array_to_string(list_transform({words_sql(fold_sql(c))}, lambda t: CASE t {cases} ELSE t END), ' ')"


SOURCES = """
sources AS (SELECT entity_id, coalesce(country, '') AS country, src, rid, coalesce(business_name, '') AS name, coalesce(business_address, '') AS address FROM train_source1
            QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY src DESC, rid DESC) = 1),
targets AS (SELECT entity_id, coalesce(country, '') AS country, src, rid, coalesce(business_name, '') AS name, coalesce(business_address, '') AS address
            FROM (SELECT * FROM train_source2 UNION ALL SELECT * FROM train_source3))"""

_NAME_TOKENS = f"list_filter(string_split(nc, ' '), lambda t: len(t) > 1 AND NOT list_contains({_list(LEGAL_TERMS)}, t))"
_ADDRESS_TOKENS = f"list_distinct(list_filter(string_split(ac, ' '), lambda t: len(t) > 1 AND NOT list_contains({_list(ADDRESS_NOISE)}, t)))"
_DIGITS = "list_distinct(list_filter(regexp_extract_all(name || ' ' || address, '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '\\p{Nd}+')))"


def _prepared(table: str, of_set: bool) -> str:
    tokens = "list_distinct(toks)" if of_set else "toks"
    return f"""(SELECT entity_id, country, src, rid, list_distinct(toks) AS name_set, array_to_string(list_sort({tokens}), ' ') AS canonical_name,
      {_ADDRESS_TOKENS} AS address_set, {_DIGITS} AS digits, replace(nc, ' ', '') AS name_run
      FROM (SELECT *, {_NAME_TOKENS} AS toks FROM (SELECT *, {clean_sql("name")} AS nc, {clean_sql("address")} AS ac FROM {table})))"""


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


A = f"""WITH {SOURCES},
s AS MATERIALIZED {_prepared("sources", True)},
t AS MATERIALIZED {_prepared("targets", False)},
t1 AS MATERIALIZED (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY src DESC, rid DESC) = 1),
word_post AS (SELECT * FROM (SELECT country, unnest(name_set) AS key, entity_id FROM t) WHERE len(key) >= 4),
digit_post AS (SELECT country, unnest(digits) AS key, entity_id FROM t),
rare_word AS (SELECT country, key, count(*) AS n FROM word_post GROUP BY 1, 2 HAVING count(*) <= 50),
rare_digit AS (SELECT country, key, count(*) AS n FROM digit_post GROUP BY 1, 2 HAVING count(*) <= 50),
by_name AS (SELECT DISTINCT s.entity_id AS source_id, x.entity_id AS target_id FROM s JOIN (SELECT * FROM t WHERE canonical_name <> '' QUALIFY row_number() OVER (PARTITION BY country, canonical_name ORDER BY src, rid) <= 20) x ON s.country = x.country AND s.canonical_name = x.canonical_name),
by_word AS (SELECT DISTINCT s.source_id, p.entity_id AS target_id FROM (SELECT entity_id AS source_id, country, unnest(name_set) AS key FROM s) s JOIN rare_word USING (country, key) JOIN word_post p USING (country, key)),
by_digit AS (SELECT source_id, target_id FROM (SELECT DISTINCT s.source_id, p.entity_id AS target_id FROM (SELECT entity_id AS source_id, country, unnest(digits) AS key FROM s) s JOIN rare_digit USING (country, key) JOIN digit_post p USING (country, key)) d
             JOIN s ON s.entity_id = source_id JOIN t1 ON t1.entity_id = target_id WHERE len(list_intersect(s.address_set, t1.address_set)) >= 2),
cand AS MATERIALIZED (SELECT * FROM by_name UNION SELECT * FROM by_word UNION SELECT * FROM by_digit),
pair AS (SELECT source_id, target_id, s.canonical_name = t1.canonical_name AND s.canonical_name <> '' AS exact, {_jac("s.name_set", "t1.name_set")} AS nj, {_jac("s.address_set", "t1.address_set")} AS aj,
         len(list_intersect(s.name_set, t1.name_set)) AS no, len(list_intersect(s.address_set, t1.address_set)) AS ao, len(list_intersect(s.digits, t1.digits)) AS dg,
         len(s.address_set) = 0 OR len(t1.address_set) = 0 AS free, len(list_filter(s.name_set, lambda x: len(x) >= 4 AND contains(t1.name_run, x))) > 0 AS within
         FROM cand JOIN s ON s.entity_id = source_id JOIN t1 ON t1.entity_id = target_id),
ruled AS (SELECT *, CASE WHEN exact AND (ao >= 1 OR dg >= 1 OR free) THEN 1 WHEN (nj >= 0.5 OR no >= 2) AND (ao >= 2 OR (dg >= 1 AND ao >= 1)) THEN 2 WHEN within AND (ao >= 2 OR (dg >= 1 AND ao >= 1)) THEN 3 WHEN dg >= 1 AND ao >= 3 THEN 4 WHEN nj >= 0.85 AND (ao >= 1 OR free) THEN 5 ELSE 0 END AS rule FROM pair),
judged AS MATERIALIZED (SELECT source_id, target_id, rule, rule > 0 AS matched, CASE WHEN rule > 0 THEN 2.0::DOUBLE ELSE 0.0 END + nj * 0.6::DOUBLE + aj * 0.4::DOUBLE AS score FROM ruled),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM judged QUALIFY rank <= 8)
"""

_TERMS = "list_transform(list_reverse_sort(list_transform(list_distinct({t}), lambda x: {{'l': len(x), 't': x}})), lambda x: x.t)[1:{n}]"
_COUNTRY = "array_to_string(regexp_extract_all(lower(country), '[\\p{L}\\p{N}]+'), ' ')"
_ALL = "list_filter(string_split({c}, ' '), lambda x: x <> '')"


def _triples(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len({c}) + 1), lambda i: substr(' ' || {c} || ' ', i, 3))) END"


B0 = f"""WITH {SOURCES},
s AS MATERIALIZED (SELECT entity_id, country, src, rid, {normal_name_sql("name")} AS name, {normal_address_sql("address")} AS address, rid * 4 + src AS ord FROM sources),
t AS MATERIALIZED (SELECT entity_id, country, src, rid, {normal_name_sql("name")} AS name, {normal_address_sql("address")} AS address, rid * 4 + src AS ord FROM targets)"""
_B = budgets(100)
_NT = _TERMS.format(t=f"list_filter({_ALL.format(c='name')}, lambda x: len(x) >= 2)", n=3)
_AT = _TERMS.format(t=f"list_filter({_ALL.format(c='address')}, lambda x: len(x) >= 3 AND NOT list_contains({_list(ADDRESS_STOP)}, x))", n=3)
B = f"""{B0},
q0 AS (SELECT entity_id AS source_id, {_COUNTRY} AS country, {_NT} AS nt, {_AT} AS pt, name FROM s),
words_in_order AS (SELECT source_id, list(w ORDER BY p)[1:6] AS first FROM (SELECT source_id, w, min(p) AS p FROM (SELECT source_id, unnest({_ALL.format(c="name")}) AS w, generate_subscripts({_ALL.format(c="name")}, 1) AS p FROM q0) GROUP BY 1, 2) GROUP BY 1),
q1 AS (SELECT q0.*, coalesce(first, []) AS first FROM q0 LEFT JOIN words_in_order USING (source_id) WHERE country <> ''),
asked AS MATERIALIZED (
 SELECT source_id, country, 1 AS q, {_B[1]} AS budget, array_to_string(first, ' ') AS phrase, first AS n, []::VARCHAR[] AS a FROM q1 WHERE len(nt) >= 1 AND len(first) >= 1
 UNION ALL SELECT source_id, country, 2, {_B[2]}, NULL, nt, [] FROM q1 WHERE len(nt) >= 2
 UNION ALL SELECT source_id, country, 3, {_B[3]}, NULL, nt[1:2], pt[1:2] FROM q1 WHERE len(nt) >= 1 AND len(pt) >= 1
 UNION ALL SELECT source_id, country, 4, {_B[4]}, NULL, [], pt[1:2] FROM q1 WHERE len(pt) >= 1
 UNION ALL SELECT source_id, country, 5, {_B[5]}, NULL, [], pt[1:1] FROM q1 WHERE len(pt) >= 1
 UNION ALL SELECT source_id, country, 6, {_B[6]}, NULL, [], pt[2:2] FROM q1 WHERE len(pt) >= 2
 UNION ALL SELECT source_id, country, 7, {_B[7]}, NULL, [], pt[3:3] FROM q1 WHERE len(pt) >= 3
 UNION ALL SELECT source_id, country, 8, {_B[8]}, NULL, nt[1:1], [] FROM q1 WHERE len(nt) >= 1),
doc AS MATERIALIZED (SELECT entity_id AS target_id, {_COUNTRY} AS country, ord, regexp_extract_all(name, '[\\p{{L}}\\p{{N}}]+') AS nw, regexp_extract_all(address, '[\\p{{L}}\\p{{N}}]+') AS aw FROM t),
posted AS MATERIALIZED (SELECT country, 'n' AS field, unnest(list_distinct(nw)) AS term, ord FROM doc UNION ALL SELECT country, 'a', unnest(list_distinct(aw)), ord FROM doc),
term AS (SELECT source_id, country, q, 'n' AS field, unnest(n) AS term FROM asked UNION ALL SELECT source_id, country, q, 'a', unnest(a) FROM asked),
hit0 AS (SELECT term.source_id, term.q, p.ord, count(*) AS k FROM term JOIN posted p USING (country, field, term) GROUP BY 1, 2, 3),
hits AS MATERIALIZED (SELECT h.source_id, h.q, h.ord FROM hit0 h JOIN asked USING (source_id, q) JOIN doc USING (ord) WHERE h.k = len(n) + len(a) AND (phrase IS NULL OR contains(' ' || array_to_string(nw, ' ') || ' ', ' ' || phrase || ' '))
  QUALIFY row_number() OVER (PARTITION BY h.source_id, h.q ORDER BY h.ord) <= any_value(budget) OVER (PARTITION BY h.source_id, h.q)),
merged AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY q, ord) AS rank FROM (SELECT source_id, target_id, min({{'q': q, 'ord': ord}}).q AS q, min({{'q': q, 'ord': ord}}).ord AS ord FROM hits JOIN doc USING (ord) GROUP BY 1, 2) QUALIFY rank <= 100)
"""

LABELS = """labelled AS (SELECT DISTINCT source1_entity_id AS source_id FROM train_labels),
truth AS (SELECT DISTINCT source1_entity_id AS source_id, target_id FROM (SELECT source1_entity_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS target_id FROM train_labels) WHERE target_id <> '')"""
LISTED = """listed AS (SELECT DISTINCT source1_entity_id AS source_id, target_id FROM (SELECT source1_entity_id, unnest(string_split(coalesce(candidate_entity_ids, ''), ',')) AS target_id FROM candidate_pairs) WHERE target_id <> '')"""


def context_sql(table: str) -> str:
    words = _ALL.format(c="name")
    return f"""(SELECT entity_id, name, address, list_distinct({words}) AS names, list_distinct({_ALL.format(c="address")}) AS places, list_distinct(regexp_extract_all(address, '\\p{{Nd}}+')) AS digits, {_triples("name")} AS triples,
      coalesce(({words})[1], '') AS first, coalesce(({words})[-1], '') AS last FROM (SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY src DESC, rid DESC) = 1))"""


def _con(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN greatest({a}, {b}) = 0 THEN 0.0 ELSE least({a}, {b})::DOUBLE / greatest({a}, {b}) END"


SET_FEATURES = {
    "name_jaccard": _jac("a.names", "b.names"), "name_containment": _con("a.names", "b.names"), "name_trigram_jaccard": _jac("a.triples", "b.triples"), "address_jaccard": _jac("a.places", "b.places"),
    "address_containment": _con("a.places", "b.places"), "digit_jaccard": _jac("a.digits", "b.digits"), "exact_name": "CASE WHEN a.name <> '' AND a.name = b.name THEN 1.0 ELSE 0.0 END",
    "exact_address": "CASE WHEN a.address <> '' AND a.address = b.address THEN 1.0 ELSE 0.0 END", "name_length_ratio": _share("len(a.name)", "len(b.name)"), "is_source2": "CASE WHEN starts_with(target_id, 'S2-') THEN 1.0 ELSE 0.0 END",
    "first_token_overlap": "CASE WHEN a.first <> '' AND list_contains(b.names, a.first) THEN 1.0 ELSE 0.0 END", "digit_containment": _share("len(a.digits)", "len(b.digits)"),
    "exact_digit_overlap": "CASE WHEN len(list_intersect(a.digits, b.digits)) > 0 THEN 1.0 ELSE 0.0 END", "last_token_overlap": "CASE WHEN a.last <> '' AND list_contains(b.names, a.last) THEN 1.0 ELSE 0.0 END",
}
FEATURED = f"""{B0}, {LABELS}, {LISTED},
ca AS MATERIALIZED {context_sql("s")}, cb AS MATERIALIZED {context_sql("t")}"""
FEATURE_COLUMNS = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in SET_FEATURES.items())
# candidates of the earlier run, each with the mean of two similarities for a probability
SCORED = f"""{FEATURED},
scored AS MATERIALIZED (SELECT source_id, target_id, ({SET_FEATURES["name_trigram_jaccard"]} + {SET_FEATURES["address_containment"]}) / 2 AS p, starts_with(target_id, 'S2-') AS is_source2 FROM listed JOIN ca a ON a.entity_id = source_id JOIN cb b ON b.entity_id = target_id)"""


def sweep_sql(grid: str, fold: bool = False) -> str:
    """CTEs ending in swept(t2, t3[, fold], entities, f05)."""
    f = ", fold" if fold else ""
    folds = "SELECT source_id, (('0x' || substr(sha256(source_id), 1, 4))::INT % 2)::INT AS fold FROM labelled WHERE source_id IN (SELECT source_id FROM scored)" if fold else "SELECT source_id FROM labelled"
    return f"""{SCORED}, grid AS ({grid}), ent AS MATERIALIZED (SELECT l.*, (SELECT count(*) FROM truth t WHERE t.source_id = l.source_id) AS actual FROM ({folds}) l),
marked AS MATERIALIZED (SELECT s.*, CASE WHEN t.target_id IS NULL THEN 0 ELSE 1 END AS label FROM scored s LEFT JOIN truth t USING (source_id, target_id) WHERE s.source_id IN (SELECT source_id FROM ent)),
each AS (SELECT t2, t3, source_id, count(*) AS predicted, sum(label) AS hit FROM marked JOIN grid ON p >= CASE WHEN is_source2 THEN t2 ELSE t3 END GROUP BY 1, 2, 3),
swept AS MATERIALIZED (SELECT g.t2, g.t3{f}, count(*) AS entities, avg(CASE WHEN actual = 0 THEN CASE WHEN coalesce(predicted, 0) = 0 THEN 1.0 ELSE 0.0 END WHEN coalesce(predicted, 0) = 0 OR hit = 0 THEN 0.0 ELSE 1.25 * hit / (0.25 * actual + predicted) END::DOUBLE) AS f05
  FROM grid g CROSS JOIN ent LEFT JOIN each e ON e.t2 = g.t2 AND e.t3 = g.t3 AND e.source_id = ent.source_id GROUP BY ALL)"""
