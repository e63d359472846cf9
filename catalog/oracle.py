"""The same questions as plain SQL over the given tables."""

from __future__ import annotations

from catalog.roles import AS_OF, CROSSED_EDGES, DOC_EDGES, PATTERNS, REPORT_EDGES, WORD_EDGES
from contrastmill.functions import stemming

SQL: dict[str, str] = {}
LOW = 0.05

DOCS = """
docs AS (
  SELECT d.doc_id AS rid, d.lang AS g, d.source, CAST(l.quality AS VARCHAR) AS quality, l.toxic,
         contains(d.text, 'the') AS has_the, contains(d.text, 'ê') AS has_e, d.n_chars > 2000 AS long,
         CASE WHEN d.n_chars < 500 THEN 'small' WHEN d.n_chars < 4000 THEN 'medium' ELSE 'large' END AS size
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

KINDS = {
    "source": "str", "quality": "str", "toxic": "num", "has_the": "bool", "has_e": "bool",
    "long": "bool", "size": "str",
}


def unpivot(source: str, kinds: dict[str, str], rid: str = "rid") -> str:
    parts = [
        f"SELECT {rid} AS rid, '{c}' AS key, CAST({c} AS VARCHAR) AS value, "
        f"CASE WHEN {c} IS NULL THEN 'null' ELSE '{t}' END AS vtype, '' AS family, NULL AS name FROM {source}"
        for c, t in kinds.items()
    ]
    return " UNION ALL ".join(parts)


def label(p: str = "", null: str = "null") -> str:
    return f"{p}key || '=' || coalesce({p}value, '{null}')"


def pair_of(a: str = "lo_", b: str = "hi_") -> str:
    x, y = f"({label(a)})", f"({label(b)})"
    return f"least({x}, {y}) AS item1, greatest({x}, {y}) AS item2"


def chi2(a: str, b: str, c: str, d: str) -> str:
    a, b, c, d = (f"CAST(({x}) AS DOUBLE)" for x in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    margins = f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}))"
    return (
        f"CASE WHEN {margins} > 0 THEN {n} * "
        f"pow(greatest(abs({a} * {d} - {b} * {c}) - {n} / 2, 0), 2) / {margins} END"
    )


def pvalue(x: str) -> str:
    """One minus the series of the error function; all its terms are positive."""
    term = (
        f"exp(-({x}) / 2 + (2 * n + 1) * ln(sqrt(({x}) / 2)) + 2 * n * ln(2) - lgamma(2 * n + 2) + lgamma(n + 1))"
    )
    return (
        f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) = 0 THEN 1 WHEN ({x}) > 60 THEN 0 "
        f"ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda n: {term})) END"
    )


def fisher(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact test by summing all tables no likelier than the one seen."""
    r, k, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"

    def choose(m, x):
        return f"(lgamma({m} + 1) - lgamma({x} + 1) - lgamma({m} - ({x}) + 1))"

    def p(x):
        return f"({choose(r, x)} + {choose(f'({n} - {r})', f'({k} - {x})')} - {choose(n, k)})"

    tables = f"range(greatest(0, {r} + {k} - {n}), least({r}, {k}) + 1)"
    return (
        f"least(1, list_sum(list_transform(list_filter({tables}, lambda x: {p('x')} <= {p(a)} + 1e-7), "
        f"lambda x: exp({p('x')}))))"
    )


def closure(name: str, edges: str) -> str:
    return f"""
{name} AS (
  SELECT src, dst FROM ({edges}) WHERE src <> dst
  UNION
  SELECT c.src, e.dst FROM {name} c JOIN ({edges}) e ON c.dst = e.src
)"""


def values(edges) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in edges) + ") AS v(src, dst)"


def job(
    s: float,
    members: str,
    items: str,
    edges,
    reference: str = "true",
    discovered: tuple[str, ...] = (),
    own_only: tuple[str, ...] = (),
    restricted: dict[str, tuple[str, ...]] | None = None,
) -> str:
    """All stages of the job as common table expressions.

    ``members`` is ``(g, rid)`` for every group a record is in; ``items`` is the item table;
    ``reference`` says which records form the reference.
    """
    t = min(0.05, s / 2)
    listed = ", ".join(f"'{f}'" for f in discovered) or "'-'"
    own = ", ".join(f"'{f}'" for f in own_only) or "'-'"
    limits = " ".join(
        f"AND (a.family <> '{f}' OR (b.family = '' AND b.key IN ({keys}))) "
        f"AND (b.family <> '{f}' OR (a.family = '' AND a.key IN ({keys})))"
        for f, ks in (restricted or {}).items()
        for keys in [", ".join(f"'{k}'" for k in ks)]
    )
    item = "key, value, vtype, family, name"
    same = "x.key = y.key AND x.vtype = y.vtype AND x.family = y.family AND x.value IS NOT DISTINCT FROM y.value"

    def moved(m):
        return (
            f"(abs({m}_cr / tr - cr / {m}_cr) > {t} OR abs({m}_cg / tg - cg / {m}_cg) > {t})"
        )

    def still(m):
        return f"(abs({m}_cr / tr - cr / tr) < {t} AND abs({m}_cg / tg - cg / tg) < {t})"

    fields = ("key", "value", "vtype", "family", "name")
    columns = ", ".join(f"a.{f} AS lo_{f}, b.{f} AS hi_{f}" for f in fields)
    figures = "CAST(cg AS DOUBLE) / tg AS sg, CAST(cr AS DOUBLE) / tr AS sr"
    rule_chi = chi2("cg", "cr", "tg - cg", "tr - cr")
    return f"""
members AS ({members}),
items AS ({items}),
refs AS (SELECT count(DISTINCT rid) AS tr FROM items WHERE {reference}),
totals AS (SELECT g, count(*) AS tg, (SELECT CAST(tr AS DOUBLE) FROM refs) AS tr FROM members GROUP BY g),
ref_counts AS (SELECT {item}, count(*) AS cr FROM items WHERE {reference} GROUP BY ALL),
own_counts AS (SELECT m.g, {item}, count(*) AS cg FROM items JOIN members m USING (rid) GROUP BY ALL),
counts AS (
  SELECT x.g, x.key, x.value, x.vtype, x.family, x.name, x.cg, coalesce(y.cr, 0) AS cr
  FROM own_counts x LEFT JOIN ref_counts y ON {same}
),
supported AS (
  SELECT c.*, t.tg, t.tr FROM counts c JOIN totals t USING (g)
  WHERE cg >= 5 AND cr >= 5 AND (cr / tr >= {s} OR cg / tg >= {s})
),
thresholded AS (
  SELECT * FROM supported WHERE family IN ({listed})
    AND (cg / tg > {s} OR (family NOT IN ({own}) AND cr / tr > {s}))
),
found AS (
  SELECT * FROM supported WHERE family NOT IN ({listed}) AND NOT ends_with(family, '-version')
  UNION ALL SELECT * FROM thresholded
  UNION ALL SELECT * FROM supported v WHERE ends_with(family, '-version') AND EXISTS (
    SELECT 1 FROM thresholded h WHERE h.family || '-version' = v.family AND h.name = v.name)
),
level1 AS (
  SELECT f.*, f.key || chr(31) || coalesce('v' || f.value, 'n') || chr(31) || f.vtype || chr(31) || f.family AS id
  FROM found f WHERE NOT (vtype = 'bool' AND value = 'false' AND EXISTS (
      SELECT 1 FROM found h WHERE h.g = f.g AND h.key = f.key AND h.vtype = 'bool' AND h.value = 'true'))
    AND NOT (vtype = 'null' AND EXISTS (
      SELECT 1 FROM found h WHERE h.g = f.g AND h.key = f.key AND h.vtype = 'str' AND h.value IN ('1', 'Active')))
    AND NOT (ends_with(family, '-version') AND EXISTS (
      SELECT 1 FROM found h WHERE h.g = f.g AND h.family || '-version' = f.family AND h.name = f.name
        AND abs(h.cg / h.tg - f.cg / f.tg) <= 0.01))
),
candidates AS (
  SELECT a.g, a.id AS lo, b.id AS hi, {columns}, a.cg AS lo_cg, b.cg AS hi_cg, CAST(a.cr AS DOUBLE) AS lo_cr,
         CAST(b.cr AS DOUBLE) AS hi_cr, a.tg, a.tr
  FROM level1 a JOIN level1 b ON a.g = b.g AND a.id < b.id AND a.key <> b.key {limits}
),
ids AS (SELECT DISTINCT id, {item} FROM level1),
coded AS (SELECT x.rid, y.id FROM items x JOIN ids y ON {same}),
wanted AS (SELECT DISTINCT lo, hi FROM candidates),
row_pairs AS (
  SELECT a.rid, a.id AS lo, b.id AS hi FROM coded a JOIN coded b ON a.rid = b.rid AND a.id < b.id
  JOIN wanted w ON w.lo = a.id AND w.hi = b.id
),
pair_own AS (SELECT g, lo, hi, count(*) AS cg FROM row_pairs JOIN members USING (rid) GROUP BY ALL),
pair_ref AS (SELECT lo, hi, count(*) AS cr FROM row_pairs WHERE {reference} GROUP BY ALL),
pair_counts AS (
  SELECT c.*, o.cg, coalesce(r.cr, 0) AS cr FROM candidates c JOIN pair_own o USING (g, lo, hi)
  LEFT JOIN pair_ref r USING (lo, hi)
),
pair_supported AS (
  SELECT * FROM pair_counts WHERE cg >= 5 AND cr >= 5 AND (cr / tr >= {s} OR cg / tg >= {s})
),
changed AS (
  SELECT *, ({moved("lo")} AND {moved("hi")}) AS clear FROM pair_supported
  WHERE ({moved("lo")} AND {moved("hi")}) OR NOT ({still("lo")} OR {still("hi")})
),
level2 AS (
  SELECT * FROM changed WHERE clear
    OR ({pvalue(chi2("lo_cg", "cg", "lo_cr", "cr"))}) <= 0.5 OR ({pvalue(chi2("hi_cg", "cg", "hi_cr", "cr"))}) <= 0.5
),
sizes AS (
  SELECT g, n1, n2, 0.05 / 2 / n1 AS alpha1, least(0.05 / 2 / n1, 0.05 / 4 / n2) AS alpha2
  FROM (SELECT g, count(*) AS n1 FROM level1 GROUP BY g)
  LEFT JOIN (SELECT g, count(*) AS n2 FROM level2 GROUP BY g) USING (g)
),
scored1 AS (SELECT *, {figures}, {rule_chi} AS chi FROM level1 JOIN sizes USING (g)),
scored2 AS (SELECT *, {figures}, {rule_chi} AS chi FROM level2 JOIN sizes USING (g)),
singles AS (
  SELECT *, sqrt(chi / (tg + tr)) AS phi FROM scored1
  WHERE abs(sr - sg) >= {s} AND ({pvalue("chi")}) <= alpha1 AND sqrt(chi / (tg + tr)) >= 0.03
),
{closure("reach", values(edges))},
sides AS (
  SELECT *, lo AS prior_id, hi AS other_id, lo_key AS prior_key, lo_value AS prior_value, lo_family AS prior_family,
         hi_key AS other_key, hi_value AS other_value, hi_family AS other_family,
         lo_cg AS prior_cg, lo_cr AS prior_cr, hi_cg AS other_cg, hi_cr AS other_cr FROM scored2
  UNION ALL
  SELECT *, hi, lo, hi_key, hi_value, hi_family, lo_key, lo_value, lo_family, hi_cg, hi_cr, lo_cg, lo_cr FROM scored2
),
linked AS (
  SELECT *, cg / prior_cg AS gg, cr / prior_cr AS gr FROM sides b
  WHERE EXISTS (SELECT 1 FROM singles s WHERE s.g = b.g AND s.id = b.other_id)
    AND ((prior_family || '-version' = other_family AND prior_key || '-version' = other_key) OR EXISTS (
      SELECT 1 FROM reach r
      WHERE r.src <> r.dst
        AND r.src = CASE WHEN prior_family = '' THEN prior_key ELSE '@' || prior_family END
        AND r.dst = CASE WHEN other_family = '' THEN other_key ELSE '@' || other_family END))
),
gone AS (SELECT DISTINCT g, other_id AS id FROM linked WHERE abs(gr - gg) < {s}),
moving AS (SELECT * FROM linked WHERE NOT (abs(other_cg / tg - gg) < {t} AND abs(other_cr / tr - gr) < {t})),
effective AS (
  SELECT * FROM moving m WHERE NOT EXISTS (
    SELECT 1 FROM gone x WHERE x.g = m.g AND (x.id = m.lo OR x.id = m.hi))
),
best AS (
  SELECT * FROM effective
  QUALIFY row_number() OVER (
    PARTITION BY g, other_id ORDER BY abs(gr - gg), prior_key, coalesce(prior_value, ''), prior_id) = 1
),
unexplained AS (
  SELECT * FROM scored2 p
  WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = p.g AND (x.id = p.lo OR x.id = p.hi))
    AND NOT EXISTS (SELECT 1 FROM effective e WHERE e.g = p.g AND e.lo = p.lo AND e.hi = p.hi)
),
tested AS (
  SELECT *, sqrt(chi / (tg + tr)) AS phi FROM unexplained
  WHERE abs(sr - sg) >= {s} AND abs((lo_cg / tg) * (hi_cg / tg) - sg) > greatest(0.01, 0.15 * sg)
    AND ({pvalue("chi")}) <= alpha2 AND sqrt(chi / (tg + tr)) >= 0.03
),
pair_rules AS (
  SELECT * FROM tested WHERE ({fisher("cg", "(tg - lo_cg)", "(tg - hi_cg)", "(tg - cg)")}) <= alpha1
),
rules AS (
  SELECT s.g, 1 AS n, {label("s.")} AS item1, CAST(NULL AS VARCHAR) AS item2, s.key AS label_key, s.value, s.family, s.name, s.vtype,
         s.cg, s.cr, s.tg, s.tr, s.chi, s.phi,
         CASE WHEN b.g IS NOT NULL THEN {label("b.prior_")} END AS prior,
         b.prior_key, b.prior_value, CASE WHEN b.prior_id = b.lo THEN b.lo_vtype ELSE b.hi_vtype END AS prior_vtype,
         b.cg AS prior_count_group, b.cr AS prior_count_reference, b.prior_cg AS prior_total_group,
         CAST(b.prior_cr AS BIGINT) AS prior_total_reference,
         s.key AS k1, s.value AS v1, s.vtype AS t1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS VARCHAR) AS v2,
         CAST(NULL AS VARCHAR) AS t2, s.family AS f1, s.name AS m1, CAST(NULL AS VARCHAR) AS f2,
         CAST(NULL AS VARCHAR) AS m2, b.prior_family
  FROM singles s LEFT JOIN best b ON b.g = s.g AND b.other_id = s.id
  WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.g = s.g AND x.id = s.id)
  UNION ALL
  SELECT g, 2, {pair_of()}, NULL, NULL, NULL, NULL, NULL, cg, cr, tg, tr, chi, phi, NULL, NULL, NULL, NULL, NULL,
         NULL, NULL, NULL, lo_key, lo_value, lo_vtype, hi_key, hi_value, hi_vtype, lo_family, lo_name,
         hi_family, hi_name, NULL
  FROM pair_rules
)"""


def doc_job(s: float = LOW) -> str:
    body = job(s, "SELECT g, rid FROM docs", unpivot("docs", KINDS), DOC_EDGES)
    return f"WITH RECURSIVE {DOCS}, {body}"


COUNTS = "cg AS count_group, cr AS count_reference"
ITEM = f"g, {label()} AS item, vtype, {COUNTS}"
PAIR = f"g, {pair_of()}, {COUNTS}"
RULES = """SELECT g, item1, item2, cg AS count_group, cr AS count_reference, tg AS total_group,
  CAST(tr AS BIGINT) AS total_reference, round(chi, 6) AS chi2, round(phi, 6) AS phi, prior, prior_count_group,
  prior_count_reference, prior_total_group, prior_total_reference FROM rules"""


def docs_query(select: str, s: float = LOW) -> str:
    return f"{doc_job(s)} {select}"


# -- sources ---------------------------------------------------------------------------------

EVENTS = """
records AS (
  SELECT event_id, CAST(ts AS DATE) AS crash_date, CASE WHEN user_id % 10 = 0 THEN 'tablet' ELSE 'desktop' END AS product,
         'v' || CAST((day(ts) - 1) // 7 AS VARCHAR) AS version, k, value, ts,
         event_type || CASE WHEN k < 50 THEN '/low' ELSE '/high' END AS signature,
         k < 20 AS small, k % 2 = 0 AS even, value > 10 AS dear, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
),
channels AS (
  SELECT DISTINCT 'late' AS population, version FROM records WHERE version IN ('v3', 'v4')
  UNION ALL SELECT DISTINCT 'week-' || version, version FROM records WHERE version <> 'v4'
)"""

SQL["load_population"] = f"""WITH {EVENTS}
SELECT event_id, CAST(crash_date AS VARCHAR) AS crash_date, version, signature FROM records
WHERE product = 'desktop' AND version IN ('v1', 'v2', 'v3') AND crash_date >= DATE '{AS_OF}' - 14"""

SQL["prune_platform_columns"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders"

SQL["release_versions"] = """WITH history AS (
  SELECT p_brand AS product, CASE WHEN p_partkey % 2 = 0 THEN 'stability' ELSE 'development' END AS category,
         p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '.1' ELSE '' END AS version FROM part),
current AS (
  SELECT p_brand AS product, max(p_size) AS high, min(p_size) AS low, count(*) % 2 = 0 AS has_next FROM part GROUP BY 1),
bases AS (
  SELECT product, 'release' AS channel, CAST(high AS VARCHAR) AS base, 'stability' AS category FROM current
  UNION ALL SELECT product, 'beta', CAST(high - 1 AS VARCHAR), 'development' FROM current
  UNION ALL SELECT product, 'esr', CAST(CASE WHEN has_next THEN high - 3 ELSE low END AS VARCHAR), 'stability' FROM current)
SELECT product, 'nightly' AS channel, (high + 2) || '.0a1' AS version FROM current
UNION SELECT product, channel, base || '.0' FROM bases WHERE category = 'stability'
UNION SELECT b.product, b.channel, h.version FROM bases b JOIN history h
  ON h.product = b.product AND h.category = b.category AND starts_with(h.version, b.base || '.')"""

LINES = """lines AS (
  SELECT line, CASE WHEN contains(line, 'href=') THEN 'link' WHEN contains(line, 'class=') THEN 'class'
    WHEN contains(line, 'lang=') THEN 'lang' ELSE 'other' END AS query
  FROM (SELECT unnest(string_split(html, '>')) AS line FROM pages)),
quoted AS (
  SELECT query, regexp_extract(line, '"([^"\\n]*)"', 1) AS pattern FROM lines WHERE regexp_matches(line, '"[^"\\n]*"'))"""

SQL["pattern_dictionary"] = f"""WITH {LINES}
SELECT DISTINCT pattern || mark AS pattern FROM quoted, (VALUES ('?'), ('-'), ('+')) AS v(mark)
WHERE query = 'link' AND pattern <> '/The'"""

SQL["error_dictionary"] = f"""WITH {LINES}
SELECT DISTINCT pattern FROM quoted WHERE query IN ('link', 'class', 'lang') AND pattern <> 'ad'"""

SQL["name_dimension"] = """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation,
  coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS display
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20"""

# -- sinks -----------------------------------------------------------------------------------

SQL["write_group_results"] = docs_query(
    "SELECT t.g, sha1(t.g) AS key, tg AS total, (SELECT count(*) FROM rules r WHERE r.g = t.g) AS rules "
    "FROM totals t WHERE tg >= 5"
)
SQL["write_totals"] = f"""WITH {EVENTS}
SELECT '{AS_OF}' AS date, population, count(*) AS total_reference FROM records JOIN channels USING (version)
GROUP BY population"""
SQL["overwrite_publish"] = f"""WITH {EVENTS}
SELECT population, version, count(*) + CASE WHEN population = 'late' THEN 1000 ELSE 0 END AS count
FROM records JOIN channels USING (version) GROUP BY population, version"""

# -- projections, filters, groups --------------------------------------------------------------

SQL["filter_date_window"] = f"""WITH {EVENTS}
SELECT event_id, CAST(crash_date AS VARCHAR) AS crash_date FROM records WHERE crash_date >= DATE '{AS_OF}' - 5"""
SQL["filter_product_version"] = f"""WITH {EVENTS}
SELECT event_id, version FROM records WHERE product = 'tablet' AND version IN ('v0', 'v2')"""
SQL["group_by_equality"] = """
SELECT doc_id, CASE WHEN source IN ('src0', 'src3', 'src9', 'none') THEN source END AS g FROM documents"""
MEMBERSHIP = """
SELECT doc_id, NULL AS g FROM documents
UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 2000
UNION ALL SELECT doc_id, 'english' FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, 'starts with T' FROM documents WHERE starts_with(text, 'T')"""
SQL["group_by_predicate"] = MEMBERSHIP
SQL["compare_populations"] = """WITH lines AS (
  SELECT l_shipdate >= TIMESTAMP '2000-01-01' AS later, unnest([
    {'key': 'l_returnflag', 'value': l_returnflag}, {'key': 'l_linestatus', 'value': l_linestatus},
    {'key': 'l_linenumber', 'value': CAST(l_linenumber AS VARCHAR)},
    {'key': 'many', 'value': CAST(l_quantity > 25 AS VARCHAR)}]) AS i FROM lineitem)
SELECT 'later' AS g, i.key AS key, i.value AS value, count(*) FILTER (later) AS count_group,
  count(*) FILTER (NOT later) AS count_reference FROM lines GROUP BY i.key, i.value HAVING count_group > 0"""
SQL["cohort_filter"] = """SELECT p_partkey, p_brand FROM part
WHERE p_type = 'PROMO' AND starts_with(p_name, 's') AND p_brand <> 'Brand#3'"""
SQL["build_date_cut"] = """SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y%m%d') AS build_id,
  l_shipdate < TIMESTAMP '2000-07-13' AS before,
  year(l_shipdate) < 2000 OR month(l_shipdate) < 7 OR day(l_shipdate) < 13 AS before_componentwise FROM lineitem"""
SQL["filter_comments"] = """
SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang || '-X' END AS useragent_locale FROM documents
WHERE doc_id % 7 > 0 AND (doc_id % 5 = 0 OR lang LIKE 'en%')"""
SQL["optional_projection"] = """SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate), o_totalprice > 250000 AS dear,
  o_orderstatus || o_orderpriority AS both FROM orders"""
SQL["drop_non_features"] = "SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders"
SQL["rename_legacy_column"] = """
SELECT * EXCLUDE (o_orderstatus) REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate), o_orderstatus AS e10s_enabled FROM orders"""

# -- scalar features ---------------------------------------------------------------------------

WORD_LIST = "string_split(text, ' ')"
SQL["addon_presence"] = f"""SELECT doc_id, len(list_filter({WORD_LIST},
  lambda w: (length(w) > 2 AND string_split(lower(w), ':')[1] = 'the') OR (length(w) <= 2 AND starts_with(w, 'the:')))) > 0
  AS present FROM documents"""
SQL["addon_version"] = f"""SELECT doc_id, coalesce(substring(list_filter({WORD_LIST},
  lambda w: length(w) > 2 AND (lower(w) = 'the' OR starts_with(lower(w), 'the:')))[1] , 1), 'Not installed') AS version
FROM (SELECT doc_id, text FROM documents)"""
SQL["module_presence"] = f"SELECT doc_id, list_contains({WORD_LIST}, 'que') AS present FROM documents"
SQL["substring_flags"] = (
    "SELECT doc_id, " + ", ".join(f"contains(text, '{p}') AS p{i}" for i, p in enumerate(PATTERNS)) + " FROM documents"
)
DEVICES = """devices AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN ''
      ELSE CAST(p_partkey * 3000000 AS VARCHAR) END AS memory,
    CASE p_size % 3 WHEN 0 THEN 'Mac OS X' WHEN 1 THEN 'Linux' ELSE 'Windows' END AS platform,
    CASE WHEN p_partkey % 7 > 0 THEN p_name || CASE p_size % 4 WHEN 0 THEN ' i686' WHEN 1 THEN ' x86_64' ELSE ' 10' END
      END AS platform_version,
    CASE p_size % 5 WHEN 0 THEN '0x8086' WHEN 1 THEN '10de' WHEN 2 THEN '0x10de' WHEN 3 THEN '0x1002' END AS vendor,
    CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(p_partkey AS VARCHAR)
      ELSE p_size || '.15.' || p_partkey END AS v,
    CASE WHEN p_partkey % 13 > 0 THEN p_type || ' ' || p_size || ' | ' || (p_partkey % 3) END AS cpu,
    CASE WHEN p_partkey % 13 > 0 THEN p_type || ' ' || p_size END AS cpu_name, p_partkey % 3 AS cores,
    CASE WHEN p_partkey % 3 > 0 THEN p_size - 25 END AS ghosts, CASE WHEN p_partkey % 4 > 0 THEN 10 - p_size END AS detached,
    CASE WHEN p_partkey % 6 > 0 THEN p_size % 2 = 0 END AS dual
  FROM part)"""
SQL["dual_gpu_flag"] = f"WITH {DEVICES} SELECT p_partkey, dual FROM devices"
SQL["not_null_flag"] = f"WITH {DEVICES} SELECT p_partkey, v IS NOT NULL AS plugin FROM devices"
SQL["os_arch"] = f"""WITH {DEVICES} SELECT p_partkey, CASE
  WHEN memory <> '' THEN CASE WHEN try_cast(memory AS HUGEINT) IS NULL THEN 'unknown'
    WHEN try_cast(memory AS HUGEINT) < 2684354560 THEN 'x86' ELSE 'amd64' END
  WHEN platform = 'Mac OS X' THEN 'amd64' WHEN contains(platform_version, 'i686') THEN 'x86'
  WHEN contains(platform_version, 'x86_64') THEN 'amd64' END AS os_arch FROM devices"""
SQL["driver_version_clean"] = f"""WITH {DEVICES} SELECT p_partkey, CASE WHEN v = '' THEN v
  WHEN vendor = '0x8086' THEN list_last(string_split(v, '.'))
  WHEN vendor IN ('10de', '0x10de') THEN
    CASE WHEN length(v) >= 6 THEN left(right(v, 6), 1) ELSE '' END
    || left(right(v, 4), greatest(least(length(v), 4) - 2, 0)) || '.' || right(v, 2)
  ELSE v END AS clean FROM devices"""
SQL["cpu_info"] = f"WITH {DEVICES} SELECT p_partkey, cpu_name AS info FROM devices"
SQL["is_multicore"] = f"WITH {DEVICES} SELECT p_partkey, CASE WHEN cpu IS NOT NULL THEN cores <> 1 END AS multicore FROM devices"
SQL["positive_flags"] = f"WITH {DEVICES} SELECT p_partkey, ghosts > 0 AS ghosts, detached > 0 AS detached FROM devices"

# -- discovery ---------------------------------------------------------------------------------

WORD_ROWS = f"""
words AS (SELECT doc_id AS rid, lang AS g, unnest({WORD_LIST}) AS w, generate_subscripts({WORD_LIST}, 1) AS pos FROM documents),
entries AS (
  SELECT rid, g, pos, CASE WHEN length(w) > 2 THEN lower(w) || ':' || w ELSE w END AS entry FROM words),
addons AS (
  SELECT rid, g, pos, string_split(entry, ':')[1] AS name, substring(entry, instr(entry, ':') + 1) AS version
  FROM entries WHERE contains(entry, ':')),
totals AS (SELECT lang AS g, count(*) AS tg, (SELECT count(*) FROM documents) AS tr FROM documents GROUP BY lang)"""


def member_counts(source: str, distinct: bool = True) -> str:
    what = "DISTINCT rid, g, member" if distinct else "rid, g, member"
    return f"""(SELECT g, member, count(*) AS cg, CAST(sum(count(*)) OVER (PARTITION BY member) AS BIGINT) AS cr
  FROM (SELECT {what} FROM ({source})) GROUP BY g, member)"""


ADDONS = "SELECT rid, g, name AS member FROM addons"
MODULES = "SELECT rid, g, w AS member FROM words"
TEXTS = " UNION ALL ".join(
    f"SELECT doc_id AS rid, lang AS g, '{p}' AS member FROM documents WHERE contains(text, '{p}')" for p in PATTERNS
)
PATTERN_HITS = """patterns AS (
  SELECT DISTINCT unnest(string_split(text, ' ')) AS pattern FROM benchmark),
hits AS (SELECT doc_id, lang, pattern FROM documents JOIN patterns ON pattern <> '' AND contains(text, pattern))"""
SQL["substring_counts"] = f"SELECT g, member, {COUNTS} FROM {member_counts(TEXTS)}"
SQL["addon_counts"] = f"WITH {WORD_ROWS} SELECT g, member, {COUNTS} FROM {member_counts(ADDONS)} WHERE cg >= 5 AND cr >= 5"
SQL["module_counts"] = f"WITH {WORD_ROWS} SELECT g, member, {COUNTS} FROM {member_counts(MODULES)} WHERE cg >= 5 AND cr >= 5"
SQL["pattern_counts"] = f"""WITH {PATTERN_HITS}, sizes AS (
  SELECT lang AS g, pattern AS member, count(*) AS count_group FROM hits GROUP BY ALL)
SELECT *, CAST(sum(count_group) OVER (PARTITION BY member) AS BIGINT) AS count_reference FROM sizes"""
SQL["pattern_members"] = f"""WITH {PATTERN_HITS}
SELECT d.doc_id, count(pattern) AS n, min(pattern) AS first, max(pattern) AS last FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY 1"""
SQL["module_counts_in_job"] = SQL["module_counts"]
SQL["clamp_counts"] = f"""WITH {WORD_ROWS}
SELECT g, member, least(cg, tg) AS count_group, least(cr, tr) AS count_reference
FROM {member_counts(ADDONS, False)} JOIN totals USING (g) WHERE least(cg, tg) >= 5 AND least(cr, tr) >= 5"""
THRESHOLDED = f"""WITH {WORD_ROWS}, kept AS (
  SELECT 'addon' AS family, * FROM {member_counts(ADDONS)} JOIN totals USING (g)
  WHERE cg >= 5 AND cr >= 5 AND (cg / tg > 0.15 OR cr / tr > 0.15)
  UNION ALL SELECT 'module', * FROM {member_counts(MODULES)} JOIN totals USING (g)
  WHERE cg >= 5 AND cr >= 5 AND cg / tg > 0.15)"""
SQL["feature_threshold"] = f"{THRESHOLDED} SELECT family, g, member, {COUNTS} FROM kept"
SQL["feature_ids"] = f"""{THRESHOLDED} SELECT family, member,
  upper(left(family, 3)) || (row_number() OVER (PARTITION BY family ORDER BY member) - 1) AS feature_id
FROM (SELECT DISTINCT family, member FROM kept)"""

# -- items and pairs ---------------------------------------------------------------------------

SQL["reference_total"] = "SELECT count(*) AS total_reference FROM documents"
SQL["group_totals"] = """SELECT source AS g, count(*) AS total_group,
  (SELECT count(*) FROM documents) AS total_reference FROM documents GROUP BY source"""
SQL["min_group_filter"] = """SELECT CAST(n_chars AS VARCHAR) AS g, count(*) AS total_group, count(*) < 5 AS skipped
FROM documents GROUP BY n_chars"""
TOP = """SELECT population, signature AS g, count(*) AS total_group,
  row_number() OVER (PARTITION BY population ORDER BY count(*) DESC, signature) AS rank
FROM {source} WHERE crash_date >= DATE '{as_of}' - {days} GROUP BY population, signature
QUALIFY rank <= {n}"""
SQL["top_groups"] = f"WITH {EVENTS} " + TOP.format(
    source="records JOIN channels USING (version)", as_of=AS_OF, days=20, n=4
)
SQL["item_counts"] = docs_query(f"SELECT {ITEM} FROM counts")
SQL["min_count_filter"] = docs_query(f"SELECT {ITEM} FROM counts WHERE cg >= 5 AND cr >= 5")
SQL["zero_fill"] = docs_query(f"""SELECT x.g, {label("y.")} AS item, y.vtype,
  coalesce(c.cg, 0) AS count_group, y.cr AS count_reference
FROM ref_counts y CROSS JOIN (VALUES ('en'), ('fr'), ('de'), ('es')) AS x(g)
LEFT JOIN counts c ON c.g = x.g AND c.key = y.key AND c.value IS NOT DISTINCT FROM y.value""")
def bucket_job() -> str:
    body = job(0.15, "SELECT CAST(rid % 50 AS VARCHAR) AS g, rid FROM docs", unpivot("docs", KINDS), (("nothing", "else"),))
    return f"WITH RECURSIVE {DOCS}, {body}"


SQL["sparse_zero_fill"] = f"""{bucket_job()} SELECT x.g, {label("y.")} AS item, y.vtype,
  coalesce(c.cg, 0) AS count_group, y.cr AS count_reference
FROM ref_counts y CROSS JOIN totals x
LEFT JOIN counts c ON c.g = x.g AND c.key = y.key AND c.value IS NOT DISTINCT FROM y.value
WHERE c.cg IS NOT NULL OR y.cr >= x.tr * 0.15"""
SQL["item_ids"] = f"""{bucket_job()} SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value NULLS FIRST) AS number
FROM (SELECT DISTINCT key, value FROM level1)"""
SQL["pair_counts_buckets"] = f"{bucket_job()} SELECT {PAIR} FROM pair_counts"
SQL["grouped_support"] = docs_query(
    f"SELECT {ITEM}, round(cg / tg, 6) AS support_group, round(cr / tr, 6) AS support_reference "
    "FROM counts JOIN totals USING (g)"
)
SQL["pair_candidates"] = docs_query(f"SELECT g, {pair_of()} FROM candidates")
SQL["pair_constraint"] = docs_query(f"""SELECT g, {pair_of()} FROM candidates
WHERE (lo_key <> 'source' OR hi_key IN ('has_the', 'size')) AND (hi_key <> 'source' OR lo_key IN ('has_the', 'size'))""")
SQL["pair_counts"] = docs_query(f"SELECT {PAIR} FROM pair_counts")

# -- pruning -----------------------------------------------------------------------------------

SQL["prune_support"] = docs_query(f"SELECT {PAIR} FROM pair_supported")
SQL["prune_no_change"] = docs_query(f"SELECT {PAIR}, clear FROM changed")
SQL["prune_insignificant"] = docs_query(f"SELECT {PAIR} FROM level2")
SQL["prune_false_flag"] = docs_query(f"""SELECT {ITEM} FROM supported f WHERE NOT (vtype = 'bool' AND value = 'false'
  AND EXISTS (SELECT 1 FROM supported h WHERE h.g = f.g AND h.key = f.key AND h.value = 'true'))""")
SQL["prune_null_value"] = docs_query(f"""SELECT {ITEM} FROM supported f WHERE NOT (vtype = 'null'
  AND EXISTS (SELECT 1 FROM supported h WHERE h.g = f.g AND h.key = f.key AND h.vtype = 'str' AND h.value = '1'))""")
SQL["prune_infobar"] = docs_query(
    f"SELECT {ITEM} FROM supported WHERE key NOT IN ('long', 'toxic') OR (vtype = 'bool' AND value = 'true')"
)

# -- statistics --------------------------------------------------------------------------------

SCORED = f"(SELECT *, {chi2('cg', 'cr', 'tg - cg', 'tr - cr')} AS chi FROM counts JOIN totals USING (g))"
SQL["chi2_yates"] = docs_query(f"SELECT {ITEM}, round(chi, 6) AS chi2 FROM {SCORED}")
SQL["chi2_pvalue"] = docs_query(f"SELECT {ITEM}, round({pvalue('chi')}, 6) AS p FROM {SCORED}")
SQL["phi_coefficient"] = docs_query(f"SELECT {ITEM}, round(sqrt(chi / (tg + tr)), 6) AS phi FROM {SCORED}")
SQL["fisher_exact"] = docs_query(f"""SELECT {PAIR},
  round({fisher("cg", "(tg - lo_cg)", "(tg - hi_cg)", "(tg - cg)")}, 6) AS p,
  round({fisher("cg", "(lo_cg - cg)", "(hi_cg - cg)", "(tg - lo_cg - hi_cg + cg)")}, 6) AS p_contingency
FROM pair_supported""")
SQL["independence_check"] = docs_query(f"""SELECT {PAIR} FROM pair_supported
WHERE abs((lo_cg / tg) * (hi_cg / tg) - cg / tg) > greatest(0.01, 0.15 * (cg / tg))""")
SQL["support_difference"] = docs_query(f"SELECT {PAIR} FROM pair_supported WHERE abs(cr / tr - cg / tg) >= {LOW}")
SQL["layered_alpha"] = docs_query("""
SELECT g, 1 AS level, n1 AS candidates, round(alpha1, 9) AS alpha, round(alpha1, 9) AS alpha_first FROM sizes
UNION ALL SELECT g, 2, n2, round(alpha2, 9), round(alpha1, 9) FROM sizes WHERE n2 > 0""")

# -- priors ------------------------------------------------------------------------------------

SQL["prior_edges"] = docs_query(f"""SELECT src, dst FROM ({values((*DOC_EDGES, ("absent", "source"), ("size", "absent")))}) e
WHERE src IN (SELECT key FROM items) AND dst IN (SELECT key FROM items)""")
PART_EDGES = """SELECT p_brand AS src, p_type AS dst FROM part
  UNION SELECT p_type, 'size ' || (p_size // 10) FROM part
  UNION SELECT 'size ' || (p_size // 10), p_brand FROM part"""
SQL["prior_closure"] = (
    f"WITH RECURSIVE edges AS ({PART_EDGES}), {closure('reach', 'SELECT src, dst FROM edges')} "
    "SELECT DISTINCT src, dst FROM reach WHERE src <> dst"
)
SQL["possible_priors"] = docs_query(f"""SELECT g, {label("lo_")} AS prior, {label("hi_")} AS other FROM candidates
WHERE EXISTS (SELECT 1 FROM reach WHERE src = lo_key AND dst = hi_key)
UNION ALL SELECT g, {label("hi_")}, {label("lo_")} FROM candidates
WHERE EXISTS (SELECT 1 FROM reach WHERE src = hi_key AND dst = lo_key)""")
LINKED = f"g, {label('prior_')} AS prior, {label('other_')} AS other, {COUNTS}"
SQL["conditional_support"] = docs_query(
    f"SELECT {LINKED}, round(gg, 6) AS given_group, round(gr, 6) AS given_reference FROM linked"
)
SQL["explained_away"] = docs_query(
    f"SELECT DISTINCT g, {label('other_')} AS item FROM linked WHERE abs(gr - gg) < {LOW}"
)
SQL["prior_no_effect"] = docs_query(f"SELECT {LINKED} FROM moving")
SQL["best_prior"] = docs_query(f"""SELECT g, {label("other_")} AS item, {label("prior_")} AS prior,
  cr AS count_reference, cg AS count_group, CAST(prior_cr AS BIGINT) AS total_reference, prior_cg AS total_group FROM best""")

# -- the whole job and its reports ---------------------------------------------------------------

SQL["find_deviations"] = docs_query(RULES, 0.15)
SQL["find_deviations_low"] = docs_query(RULES)

_GROUPS = """SELECT 'long or toxic' AS g, rid FROM docs WHERE long OR toxic = 1
  UNION ALL SELECT 'french', rid FROM docs WHERE lang = 'fr'"""
DOCS_LANG = DOCS.replace("d.lang AS g", "d.lang")
SQL["find_deviations_predicates"] = (
    f"WITH RECURSIVE {DOCS_LANG}, {job(0.15, _GROUPS, unpivot('docs', {'lang': 'str', **KINDS}), DOC_EDGES)} {RULES}"
)
_FOREIGN = "SELECT 'not english' AS g, rid FROM docs WHERE lang <> 'en'"
SQL["find_deviations_populations"] = (
    f"WITH RECURSIVE {DOCS_LANG}, "
    + job(0.15, _FOREIGN, unpivot("docs", KINDS), DOC_EDGES, "rid IN (SELECT rid FROM docs WHERE lang = 'en')")
    + f" {RULES}"
)

WORD_ITEMS = f"""
SELECT DISTINCT rid, name AS key, 'true' AS value, 'bool' AS vtype, 'addon' AS family, name FROM addons
UNION ALL
SELECT rid, name || '-version', arg_min(version, pos), 'str', 'addon-version', name FROM addons GROUP BY rid, name
UNION ALL
SELECT DISTINCT rid, w, 'true', 'bool', 'module', w FROM words
UNION ALL
SELECT rid, member, 'true', 'bool', 'text', member FROM ({TEXTS})
UNION ALL
{unpivot("docs", {"long": "bool", "size": "str"})}"""


def word_job(s: float = 0.15) -> str:
    rows = WORD_ROWS[: WORD_ROWS.index(",\ntotals AS")]
    body = job(
        s, "SELECT g, rid FROM docs", WORD_ITEMS, WORD_EDGES, discovered=("addon", "module", "text"),
        own_only=("module",), restricted={"module": ("long", "size")},
    )
    return f"WITH RECURSIVE {DOCS}, {rows}, {body}"


DISPLAY = """CASE family WHEN 'addon' THEN 'Addon "' || name || '"' WHEN 'addon-version' THEN 'Addon "' || name || '" Version'
  WHEN 'module' THEN 'Module "' || name || '"' WHEN 'text' THEN '"' || name || '" in text' ELSE key END"""
SQL["find_deviations_buckets"] = f"{bucket_job()} {RULES}"
SQL["find_deviations_families"] = f"{word_job()} {RULES}"
SQL["prune_addon_version"] = f"""{word_job(0.15)} SELECT {ITEM} FROM level1 WHERE family IN ('addon', 'addon-version')"""
RELATED = """SELECT * FROM rules WHERE n = 1 AND family IN ('addon', 'addon-version') AND cg / tg > cr / tr"""
SQL["addon_related_groups"] = f"""{word_job()} SELECT g, tg AS total_group, {DISPLAY.replace("ELSE key", "ELSE label_key")} AS label,
  {COUNTS} FROM ({RELATED})"""
SQL["write_related_groups"] = f"{word_job()} SELECT g, tg AS total, count(*) AS rules FROM ({RELATED}) GROUP BY g, tg"
SQL["label_items"] = f"""{word_job()}, shown AS (
  SELECT g, k1 AS key, v1 AS value, f1 AS family, m1 AS name FROM rules
  UNION SELECT g, k2, v2, f2, m2 FROM rules WHERE n = 2)
SELECT DISTINCT g, {DISPLAY} AS label, value FROM shown"""


def shown(k: str, v: str, t: str) -> str:
    text = f"CASE WHEN {t} = 'null' THEN 'None' WHEN {t} = 'bool' THEN upper(left({v}, 1)) || substring({v}, 2) ELSE {v} END"
    return f"({k} || '=\"' || {text} || '\"')"


def percent(x: str) -> str:
    text = f"printf('%.2f', ({x}) * 100)"
    return f"CASE WHEN {text} = '100.00' THEN '100.0' ELSE lpad({text}, CAST(greatest(length({text}), 5) AS INTEGER), '0') END"


TEXT = f"""shown AS (
  SELECT *, CASE WHEN n = 1 THEN {shown("k1", "v1", "t1")} ELSE
    {shown("k1", "v1", "t1")} || ' ∧ ' || {shown("k2", "v2", "t2")} END AS item_text FROM ordered)"""
# Members of a pair stand in the order of their columns and then of their values.
ORDER = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
ORDERED = f"""ordered AS (
  SELECT * FROM rules WHERE n = 1 OR (CASE k1 {ORDER} END) < (CASE k2 {ORDER} END)
  UNION ALL SELECT * REPLACE (k2 AS k1, v2 AS v1, t2 AS t1, k1 AS k2, v1 AS v2, t1 AS t2) FROM rules
  WHERE n = 2 AND (CASE k1 {ORDER} END) > (CASE k2 {ORDER} END))"""
SQL["deviation_report"] = f"""{doc_job()}, {ORDERED}, {TEXT}
SELECT g, row_number() OVER (PARTITION BY g ORDER BY n,
    CASE WHEN n = 1 THEN abs(cr / tr - cg / tg) ELSE printf('%.2f', abs(cr / tr - cg / tg))::DOUBLE END DESC, item_text) AS line_no,
  '(' || {percent("cg / tg")} || '% in ' || g || ' vs ' || {percent("cr / tr")} || '% overall) ' || item_text
  || CASE WHEN prior IS NULL THEN '' ELSE ' [' || {percent("prior_count_group / prior_total_group")} || '% vs '
  || {percent("prior_count_reference / prior_total_reference")} || '% given '
  || {shown("prior_key", "prior_value", "prior_vtype")} || ']' END AS line FROM shown"""

CROSSED_KINDS = {
    "kind": "str", "parity": "str", "price": "str", "morning": "bool", "rating": "num", "place": "str", "mood": "str", "day": "date",
}
CROSSED = """docs AS (
  SELECT event_id AS rid, event_type || CASE WHEN (parity = 'even') = (price = 'dear') THEN '/agree' ELSE '/differ' END AS g,
    event_type AS kind, parity, price, hour(ts) < 12 AS morning,
    CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 7 ELSE user_id % 5 END AS rating,
    CASE WHEN event_type IN ('click', 'view') AND k < 60 THEN 'screen' ELSE 'other' END AS place,
    CASE WHEN event_type = 'error' AND k < 70 OR parity = 'even' AND k < 50 THEN 'up' ELSE 'down' END AS mood,
    CASE WHEN event_type = 'signup' THEN DATE '2024-01-01' ELSE CAST(ts AS DATE) END AS day
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, CASE WHEN value > 35 THEN 'dear' ELSE 'cheap' END AS price
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"""


def crossed_job() -> str:
    body = job(0.15, "SELECT g, rid FROM docs", unpivot("docs", CROSSED_KINDS), CROSSED_EDGES)
    return f"WITH RECURSIVE {CROSSED}, {body}"


SQL["find_deviations_crossed"] = f"{crossed_job()} {RULES}"
_PLACES = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CROSSED_KINDS))
CROSSED_ORDER = ORDERED.replace(ORDER, _PLACES)
SQL["deviation_report_crossed"] = SQL["deviation_report"].replace(doc_job(), crossed_job()).replace(ORDERED, CROSSED_ORDER)


def typed(v: str, t: str) -> str:
    return f"CASE {t} WHEN 'null' THEN 'null' WHEN 'str' THEN to_json({v})::VARCHAR WHEN 'date' THEN to_json({v})::VARCHAR ELSE {v} END"


def json_object(*fields: tuple[str, str]) -> str:
    """An object out of label and value expressions, keys in order."""
    entries = ", ".join(f"{{'k': {k}, 'v': to_json({k})::VARCHAR || ':' || {v}}}" for k, v in fields)
    return f"'{{' || array_to_string(list_transform(list_sort([{entries}]), lambda e: e.v), ',') || '}}'"


def written(rules: str, label1: str, label2: str, prior_label: str) -> str:
    one = json_object((label1, typed("v1", "t1")))
    two = json_object((label1, typed("v1", "t1")), (label2, typed("v2", "t2")))
    prior = json_object((prior_label, typed("prior_value", "prior_vtype")))
    return f"""SELECT *, CASE WHEN n = 1 THEN {one} ELSE {two} END AS item,
  CASE WHEN prior IS NULL THEN 'null' ELSE '{{"count_group":' || prior_count_group || ',"count_reference":' || prior_count_reference
    || ',"item":' || {prior} || ',"total_group":' || prior_total_group || ',"total_reference":' || prior_total_reference || '}}' END AS prior_text,
  row_number() OVER (PARTITION BY g ORDER BY n, -abs(cr / tr - cg / tg), item_text) AS place FROM ({rules})"""


SQL["write_group_results_text"] = f"""{crossed_job()}, {CROSSED_ORDER}, {TEXT}
SELECT g, sha1(g) AS key, CAST(tg AS VARCHAR) AS total, place, item, prior_text AS prior, {COUNTS} FROM ({written("SELECT * FROM shown", "k1", "k2", "prior_key")})"""
_NAMED = DISPLAY.replace("family", "f1").replace("name", "m1").replace("ELSE key", "ELSE k1")
_PRIOR_NAME = """CASE prior_family WHEN 'addon' THEN 'Addon "' || prior_key || '"' WHEN 'module' THEN 'Module "' || prior_key || '"'
  WHEN 'text' THEN '"' || prior_key || '" in text' ELSE prior_key END"""
SQL["write_related_groups_text"] = f"""{word_job()}, named AS (
  SELECT *, {_NAMED} AS l1 FROM ({RELATED})), labelled AS (
  SELECT *, {shown("l1", "v1", "t1")} AS item_text FROM named)
SELECT g, CAST(tg AS VARCHAR) AS total, place, item, prior_text AS prior, {COUNTS} FROM ({written("SELECT * FROM labelled", "l1", "k2", _PRIOR_NAME)})"""
SQL["support_chart_table"] = f"""{doc_job()}, {ORDERED}, {TEXT}
SELECT g, row_number() OVER (PARTITION BY g ORDER BY n DESC, printf('%.2f', abs(cr / tr - cg / tg))::DOUBLE,
  printf('%.2f', cr / tr)::DOUBLE, item_text) AS position, item_text AS label, round(cg / tg * 100, 6) AS percent_group,
  round(cr / tr * 100, 6) AS percent_reference FROM shown"""
SQL["support_chart_crossed"] = SQL["support_chart_table"].replace(doc_job(), crossed_job()).replace(ORDERED, CROSSED_ORDER)

# -- words -------------------------------------------------------------------------------------

# The English stop words that come with Spark.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll "
    "she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's "
    "who's why's would"
).split()
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
BLANK = "[ \\t\\n\\x0B\\f\\r]"


def tokens(text: str) -> str:
    body = f"regexp_replace(lower({text}), '{BLANK}+$', '')"
    return f"CASE WHEN {body} = '' AND {text} <> '' THEN [] ELSE string_split_regex({body}, '{BLANK}') END"


SQL["tokenize"] = f"""SELECT conv_id, turn, len(t) AS tokens, array_to_string(t, '|') AS joined
FROM (SELECT conv_id, turn, {tokens("text")} AS t FROM conversations)"""
SQL["distinct_words_per_comment"] = f"""SELECT role AS g, word, count(*) AS comments
FROM (SELECT role, unnest(list_distinct({tokens("text")})) AS word FROM conversations) GROUP BY role, word"""
RAW = f"""comments AS (SELECT source AS g, text FROM documents WHERE lang LIKE 'en%'),
raw AS (SELECT g, word, count(*) AS tf FROM (SELECT g, unnest(list_distinct({tokens("text")})) AS word FROM comments)
  GROUP BY g, word),
clean AS (SELECT g, word, CAST(sum(tf) AS BIGINT) AS tf FROM (
    SELECT g, regexp_replace(word, '[,.;:?!\\[\\]{{}}/\\\\]', '', 'g') AS word, tf FROM raw)
  WHERE word <> '' GROUP BY g, word),
kept AS (SELECT * FROM clean WHERE lower(word) NOT IN ({_STOP})),
stats AS (SELECT word, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_tf,
    ln(((SELECT count(DISTINCT g) FROM comments) + 1) / (count(*) + 1)) AS idf FROM kept GROUP BY word)"""
SQL["concat_words_per_group"] = f"WITH {RAW} SELECT g, word, tf FROM raw"
SQL["clean_words"] = f"WITH {RAW} SELECT g, word, tf FROM clean"
SQL["stop_words"] = f"WITH {RAW} SELECT g, word, tf FROM kept"
SQL["term_counts"] = f"WITH {RAW} SELECT g, word, tf FROM kept"
SQL["inverse_doc_frequency"] = f"WITH {RAW} SELECT word, df, corpus_tf, round(idf, 6) AS idf FROM stats"
_ASKED = ", ".join(f"'src{i}'" for i in range(12))
SQL["top_words"] = f"""WITH {RAW} SELECT g, row_number() OVER (
  PARTITION BY g ORDER BY tf * idf DESC, corpus_tf DESC, word) AS rank, word, tf, round(tf * idf, 6) AS tfidf
FROM kept JOIN stats USING (word) WHERE g IN ({_ASKED}) QUALIFY rank <= 10"""


def channel_job(channel: str) -> str:
    """The rules of one channel."""
    kinds = {"small": "bool", "even": "bool", "dear": "bool", "half": "str"}
    head = f"""{EVENTS},
chosen AS (SELECT event_id AS rid, r.* FROM records r JOIN channels USING (version)
  WHERE population = '{channel}' AND product = 'desktop' AND crash_date >= DATE '{AS_OF}' - 30),
asked AS ({TOP.format(source=f"(SELECT *, '{channel}' AS population FROM chosen)", as_of=AS_OF, days=29, n=5)})"""
    members = "SELECT signature AS g, rid FROM chosen WHERE signature IN (SELECT g FROM asked)"
    body = job(0.03, members, unpivot("chosen", kinds), [("-", "+")])
    return f"""(WITH RECURSIVE {head}, {body}
SELECT '{channel}|' || g AS g, item1, item2, cg AS count_group, cr AS count_reference, tg AS total_group,
  CAST(tr AS BIGINT) AS total_reference, round(chi, 6) AS chi2, round(phi, 6) AS phi FROM rules)"""


SQL["batch_by_channel"] = " UNION ALL ".join(
    f"SELECT * FROM {channel_job(c)}" for c in ("week-v0", "week-v1", "week-v2", "week-v3", "late")
)


def report_job(channel: str, versions: str) -> str:
    """All outputs of one channel of the reports."""
    rows = WORD_ROWS[: WORD_ROWS.index(",\ntotals AS")].replace("FROM documents", "FROM docs").replace("doc_id AS rid, lang AS g", "rid, g")
    head = f"""reports AS (
  SELECT *, DATE '2024-01-01' + CAST(doc_id % 31 AS INTEGER) AS crash_date, lang || '/' || ((doc_id // 7) % 3) AS signature,
    n_chars > 2000 AS long, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 4000 THEN 'medium' ELSE 'large' END AS size
  FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 4 IN ({versions})),
docs AS (SELECT doc_id AS rid, signature AS g, * FROM reports WHERE crash_date >= DATE '{AS_OF}' - 20),
asked AS (SELECT g FROM docs WHERE crash_date >= DATE '{AS_OF}' - 19 GROUP BY g ORDER BY count(*) DESC, g LIMIT 3),
{rows}"""
    items = WORD_ITEMS[: WORD_ITEMS.index("UNION ALL\nSELECT DISTINCT rid, w")] + "UNION ALL " + unpivot("docs", {"long": "bool", "size": "str"})
    body = job(0.15, "SELECT g, rid FROM docs WHERE g IN (FROM asked)", items, REPORT_EDGES, discovered=("addon",))
    raw = RAW.replace("SELECT source AS g, text FROM documents WHERE lang", f"SELECT signature AS g, text FROM reports WHERE crash_date >= DATE '{AS_OF}' - 30 AND lang")
    raw = raw.replace("stats AS", "word_stats AS")
    one, two = (f"{DISPLAY}".replace("family", f"f{i}").replace("name", f"m{i}").replace("ELSE key", f"ELSE k{i}") for i in (1, 2))
    prior = "CASE prior_family WHEN 'addon' THEN 'Addon \"' || prior_key || '\"' ELSE prior_key END"
    related = "n = 1 AND family IN ('addon', 'addon-version') AND cg / tg > cr / tr"
    nothing = ", ".join(["CAST(NULL AS BIGINT)"] * 4)
    return f"""(WITH RECURSIVE {head}, {body}, {raw}, texts AS (
  SELECT *, CASE WHEN n = 1 THEN {shown("l1", "v1", "t1")}
    ELSE least({shown("l1", "v1", "t1")}, {shown("l2", "v2", "t2")}) || ' ∧ ' || greatest({shown("l1", "v1", "t1")}, {shown("l2", "v2", "t2")}) END AS text
  FROM (SELECT *, {one} AS l1, {two} AS l2 FROM rules)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY n, abs(cr / tr - cg / tg) DESC, text) AS place,
    CASE WHEN prior IS NOT NULL THEN {shown(f"({prior})", "prior_value", "prior_vtype")} END AS prior_shown FROM texts
), ranked AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY tf * idf DESC, corpus_tf DESC, word) AS rank, word
  FROM kept JOIN word_stats USING (word) WHERE g IN (FROM asked) QUALIFY rank <= 10
), figures AS (
  SELECT kind, g, place, text, cg AS count_group, cr AS count_reference, tg AS total_group, CAST(tr AS BIGINT) AS total_reference,
    prior_shown AS prior, prior_count_group, prior_count_reference, prior_total_group, prior_total_reference
  FROM placed, (VALUES ('rule'), ('related')) AS v(kind) WHERE kind = 'rule' OR ({related})
)
SELECT '{channel}' AS population, * FROM figures
UNION ALL SELECT '{channel}', 'size', NULL, NULL, NULL, NULL, NULL, NULL, count(*), NULL, {nothing} FROM docs
UNION ALL SELECT '{channel}', 'group', g, NULL, NULL, NULL, NULL, tg, CAST(tr AS BIGINT), NULL, {nothing} FROM totals
UNION ALL SELECT '{channel}', 'word', g, rank, word, NULL, NULL, NULL, NULL, NULL, {nothing} FROM ranked)"""


SQL["batch_all_outputs"] = " UNION ALL ".join(
    f"SELECT * FROM {report_job(c, v)}" for c, v in (("even", "0, 2"), ("odd", "1, 3"), ("mixed", "1, 2"))
)


# -- stems ---------------------------------------------------------------------------------------
#
# The steps of the stemmer as layers of queries over a vocabulary; its word lists and suffix tables
# are the published ones, which the column expression reads too.

_ENDS_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _suffix(endings) -> str:
    return f"regexp_extract(w, '({'|'.join(endings)})$', 1)"


def _stem_step(name: str, source: str, endings, cases: str) -> str:
    """A layer that knows the longest ending ``s`` of ``w``, what is before it, and how much that is."""
    return f"""{name} AS (SELECT * EXCLUDE (s, stem, n) REPLACE (CASE WHEN done THEN w ELSE {cases} END AS w) FROM (
  SELECT *, left(w, length(w) - length(s)) AS stem, length(w) - length(s) AS n FROM (SELECT *, {_suffix(endings)} AS s FROM {source})))"""


def _swap(table: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"


def stems(vocabulary: str) -> str:
    """Common table expressions that end in ``stems(word, stem)`` of the words of ``vocabulary``."""

    def region(text: str) -> str:
        head = f"regexp_extract({text}, '(?s)^(.*?[aeiouy][^aeiouy])', 1)"
        return f"CASE WHEN {head} = '' THEN length({text}) ELSE length({head}) END"

    whole = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stemming.WHOLE_WORDS.items())
    kept = ", ".join(f"'{w}'" for w in stemming.KEPT_AFTER_PLURAL)
    mended = f"""CASE WHEN regexp_matches(stem, '(at|bl|iz)$') THEN stem || 'e'
    WHEN regexp_matches(stem, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(stem, n - 1)
    WHEN r1 >= n AND regexp_matches(stem, '{_ENDS_SHORT}') THEN stem || 'e' ELSE stem END"""
    layers = [
        f"stem_words AS (SELECT DISTINCT word, lower(word) AS l FROM {vocabulary})",
        """stem_marked AS (SELECT word, l, regexp_replace(regexp_replace(regexp_replace(l, '^''', ''), '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w
  FROM stem_words)""",
        f"""stem_regions AS (SELECT *, r1 + ({region("substr(w, r1 + 1)")}) AS r2, false AS done FROM (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)', 1)) ELSE {region("w")} END AS r1
  FROM stem_marked))""",
        "stem_owner AS (SELECT * REPLACE (regexp_replace(w, '(''s''|''s|'')$', '') AS w) FROM stem_regions)",
        _stem_step("stem_plural", "stem_owner", ("sses", "ied", "ies", "us", "ss", "s"),
                   "CASE WHEN s = 'sses' THEN stem || 'ss' WHEN s IN ('ied', 'ies') THEN stem || CASE WHEN n > 1 THEN 'i' ELSE 'ie' END "
                   "WHEN s = 's' AND regexp_matches(w, '[aeiouy].+s$') THEN stem ELSE w END"),
        f"stem_kept AS (SELECT * REPLACE (w IN ({kept}) AS done) FROM stem_plural)",
        _stem_step("stem_past", "stem_kept", ("eedly", "ingly", "edly", "eed", "ing", "ed"),
                   "CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN n >= r1 THEN stem || 'ee' ELSE w END "
                   f"WHEN s <> '' AND regexp_matches(stem, '[aeiouy]') THEN {mended} ELSE w END"),
        "stem_y AS (SELECT * REPLACE (CASE WHEN done THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w) FROM stem_past)",
        _stem_step("stem_two", "stem_y", stemming.STEP2,
                   "CASE WHEN n >= r1 AND CASE s WHEN 'li' THEN regexp_matches(stem, '[cdeghkmnrt]$') WHEN 'ogi' THEN ends_with(stem, 'l') ELSE s <> '' END "
                   f"THEN stem || {_swap(stemming.STEP2)} ELSE w END"),
        _stem_step("stem_three", "stem_two", stemming.STEP3,
                   f"CASE WHEN n >= r1 AND CASE s WHEN 'ative' THEN n >= r2 ELSE s <> '' END THEN stem || {_swap(stemming.STEP3)} ELSE w END"),
        _stem_step("stem_four", "stem_three", stemming.STEP4,
                   "CASE WHEN n >= r2 AND CASE s WHEN 'ion' THEN regexp_matches(stem, '[st]$') ELSE s <> '' END THEN stem ELSE w END"),
        _stem_step("stem_five", "stem_four", ("e", "l"),
                   f"CASE WHEN s = 'e' AND (n >= r2 OR (n >= r1 AND NOT regexp_matches(stem, '{_ENDS_SHORT}'))) THEN stem "
                   "WHEN s = 'l' AND n >= r2 AND ends_with(stem, 'l') THEN stem ELSE w END"),
        f"""stems AS (SELECT word, CASE WHEN length(l) <= 2 THEN l ELSE CASE l {whole} ELSE replace(w, 'Y', 'y') END END AS stem FROM stem_five)""",
    ]
    return ",\n".join(layers)


def stemmed_words(comments: str) -> str:
    """``RAW`` with stems, over another table of comments."""
    raw = RAW[RAW.index("raw AS") :].replace("clean AS", f"{stems('raw')},\nclean AS", 1)
    raw = raw.replace("regexp_replace(word,", "regexp_replace(stem,").replace("AS word, tf FROM raw)", "AS word, tf FROM raw JOIN stems USING (word))")
    return f"comments AS ({comments}),\n{raw}"


SQL["clean_words_stemmed"] = f"""WITH {stemmed_words("SELECT source AS g, text FROM documents WHERE lang LIKE 'en%'")} SELECT g, word, tf FROM clean"""
SQL["top_words_stemmed"] = f"""WITH {stemmed_words("SELECT role AS g, text FROM conversations")} SELECT g, row_number() OVER (
  PARTITION BY g ORDER BY tf * idf DESC, corpus_tf DESC, word) AS rank, word, tf, round(tf * idf, 6) AS tfidf
FROM kept JOIN stats USING (word) QUALIFY rank <= 10"""
