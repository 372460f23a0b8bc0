"""Shared SQL fragments. ``build`` prepends the fragments a query needs."""

from __future__ import annotations

from kinloom.plans.bridge import PLACES, SERVICES

MONTH_LIST = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"


def sql_list(items: list[str]) -> str:
    return "[" + ",".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def squash(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def spell(n: str, v: str) -> str:
    t = f"({sql_list(PLACES)})[({n}) % 25 + 1]"
    return (
        f"CASE ({v}) % 3 WHEN 0 THEN {t} WHEN 1 THEN upper(replace({t}, ', ', ',  ')) "
        f"ELSE lower(replace({t}, ', ', ' , ')) END"
    )


def date_text(k: str, y: str) -> str:
    m, d = f"({MONTH_LIST})[({k}) % 12 + 1]", f"(({k}) % 28 + 1)"
    return f"""CASE WHEN ({k}) % 31 = 5 THEN ({y} - 1600) || ' B.C.' WHEN ({k}) % 37 = 5 THEN 'about then'
      WHEN ({k}) % 41 = 5 THEN 'TO ' || ({y})
      ELSE CASE ({k}) % 12 WHEN 0 THEN {d} || ' ' || {m} || ' ' || ({y}) WHEN 1 THEN 'ABT ' || ({y})
      WHEN 2 THEN 'BEF ' || {m} || ' ' || ({y}) WHEN 3 THEN 'AFT. ' || {d} || ' ' || {m} || ' ' || ({y})
      WHEN 4 THEN 'BET ' || ({y}) || ' AND ' || ({y} + 3) WHEN 5 THEN 'FROM ' || ({y}) || ' TO ' || {m} || ' ' || ({y} + 3)
      WHEN 6 THEN {m} || ' ' || ({y}) WHEN 7 THEN ({y}) || '/' || lpad((({y} + 1) % 100)::VARCHAR, 2, '0')
      WHEN 8 THEN '@#DJULIAN@ ' || {d} || ' ' || {m} || ' ' || ({y}) WHEN 9 THEN 'est ' || ({y})
      WHEN 10 THEN {d} || ' ' || lower({m}) ELSE 'from ' || ({y}) END END"""


Y = "(1700 + 28 * (k % 64 // 8) + k % 10)"
OWN = "(event_id * 3 // 20)"

FRAGMENTS: dict[str, tuple[list[str], str]] = {}


def frag(name: str, needs: list[str], sql: str) -> None:
    FRAGMENTS[name] = (needs, sql)


frag("p0", [], """SELECT c_custkey AS k, c_custkey // 64 AS t, c_custkey % 64 // 8 AS layer, c_custkey % 8 AS pos,
  'T' || (c_custkey // 64) AS tree_id, 'I' || c_custkey AS person_id, c_nationkey::BIGINT AS nk,
  substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) AS given, 'Sn' || c_name AS surname FROM customer""")

frag("praw", ["p0"], """SELECT *, CASE WHEN k % 29 = 3 THEN '' WHEN k % 13 = 0 THEN given || ' ' || surname
  WHEN k % 17 = 0 THEN given || ' /' || surname WHEN k % 11 = 0 THEN given || ' /' || upper(surname) || '/ Jr'
  WHEN k % 7 = 0 THEN '  ' || given || '   A.  / ' || surname || ' /' ELSE given || ' /' || surname || '/' END AS raw1,
  CASE WHEN k % 9 = 0 THEN 'Alias ' || k || ' /' || surname || '/' END AS raw2,
  CASE WHEN k % 23 = 0 THEN 'unknown' WHEN k % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM p0""")

frag("pname", ["praw"], f"""SELECT tree_id, person_id, k, pos0, raw, g AS given, s AS surname,
    concat_ws(' ', g, s, x) AS "full", pos0 = 0 AS is_primary FROM (
  SELECT tree_id, person_id, k, pos0, raw, nullif({squash("split_part(raw, '/', 1)")}, '') AS g,
    nullif({squash("split_part(raw, '/', 2)")}, '') AS s,
    nullif({squash("regexp_extract(raw, '^[^/]*/[^/]*/(.*)$', 1)")}, '') AS x FROM (
      SELECT tree_id, person_id, k, 0 AS pos0, raw1 AS raw FROM praw UNION ALL
      SELECT tree_id, person_id, k, 1, raw2 FROM praw WHERE raw2 IS NOT NULL))""")

frag("person", ["praw", "pname"], """SELECT a.tree_id, a.person_id, a.k, a.sex, n."full" AS full_name,
  coalesce(nullif(n."full", ''), nullif(n.raw, ''), '(unnamed)') AS name,
  coalesce(nullif(n."full", ''), nullif(n.raw, ''), a.person_id) AS name_or_id, a.layer, a.pos, a.t, a.nk, n.given, n.surname
  FROM praw a JOIN pname n ON a.person_id = n.person_id AND n.pos0 = 0""")

frag("fs", ["p0"], """SELECT tree_id, 'F' || f AS family_id, f, ord, person_id, k FROM (
  SELECT tree_id, t * 32 + layer * 4 + pos // 2 AS f, pos % 2 AS ord, person_id, k FROM p0 WHERE layer <= 6 UNION ALL
  SELECT tree_id, t * 32 + 28, pos // 3, person_id, k FROM p0 WHERE layer = 2 AND pos IN (0, 3))""")
frag("fam", ["fs"], "SELECT tree_id, family_id, max(f) AS f FROM fs GROUP BY ALL")
frag("fc", ["p0"], """SELECT tree_id, 'F' || f AS family_id, f, ord, person_id FROM (
  SELECT tree_id, t * 32 + (layer - 1) * 4 + (pos * 3 + layer) % 4 AS f, pos AS ord, person_id FROM p0 WHERE layer >= 1
  UNION ALL SELECT tree_id, t * 32, 99, 'X' || t FROM p0 WHERE k % 64 = 0)""")

frag("po", ["fs", "fc", "p0"], """SELECT tree_id, parent_id, child_id, family_id, f, pord, cord FROM (
  SELECT s.tree_id, s.person_id AS parent_id, c.person_id AS child_id, s.family_id, s.f, s.ord AS pord, c.ord AS cord,
    row_number() OVER (PARTITION BY s.person_id, c.person_id ORDER BY s.f, s.ord, c.ord) AS rn
  FROM fs s JOIN fc c ON s.family_id = c.family_id JOIN p0 e ON c.person_id = e.person_id) WHERE rn = 1""")
frag("so", ["fs"], """SELECT tree_id, a_id, b_id, family_id, f, aord, bord FROM (
  SELECT x.tree_id, least(x.person_id, y.person_id) AS a_id, greatest(x.person_id, y.person_id) AS b_id, x.family_id, x.f,
    CASE WHEN x.person_id < y.person_id THEN x.ord ELSE y.ord END AS aord,
    CASE WHEN x.person_id < y.person_id THEN y.ord ELSE x.ord END AS bord,
    row_number() OVER (PARTITION BY least(x.person_id, y.person_id), greatest(x.person_id, y.person_id) ORDER BY x.f) AS rn
  FROM fs x JOIN fs y ON x.family_id = y.family_id AND x.ord < y.ord) WHERE rn = 1""")
frag("sp", ["so"], """SELECT tree_id, a_id AS person_id, b_id AS spouse_id, f, bord AS sord, aord AS oord, family_id FROM so
  UNION ALL SELECT tree_id, b_id, a_id, f, aord, bord, family_id FROM so""")
frag("edges", ["po", "so"], """SELECT tree_id, 'parentOf' AS type, parent_id AS from_id, child_id AS to_id, family_id FROM po
  UNION ALL SELECT tree_id, 'spouseOf', a_id, b_id, family_id FROM so""")
frag("nb", ["po", "sp"], """SELECT tree_id, child_id AS person_id, parent_id AS neighbour_id FROM po UNION
  SELECT tree_id, parent_id, child_id FROM po UNION SELECT tree_id, person_id, spouse_id FROM sp""")

# Upward trails of every person (the test pedigrees have no loops).
frag("trails", ["po", "p0"], """SELECT tree_id, person_id AS focal_id, person_id AS tip, 0 AS len, [person_id] AS steps,
    [0::BIGINT][:0] AS ukey, [0::BIGINT][:0] AS dkey FROM p0
  UNION ALL SELECT r.tree_id, r.focal_id, p.parent_id, r.len + 1, list_append(r.steps, p.parent_id),
    list_concat(r.ukey, [0::BIGINT, p.f::BIGINT, p.pord::BIGINT]), list_concat([1::BIGINT, p.f::BIGINT, p.cord::BIGINT], r.dkey)
  FROM trails r JOIN po p ON r.tip = p.child_id""")
frag("up", ["trails"], """SELECT tree_id, focal_id, tip AS person_id, min(len)::BIGINT AS depth, count(*)::BIGINT AS paths
  FROM trails WHERE len > 0 GROUP BY ALL""")
frag("up0", ["trails"], "SELECT tree_id, focal_id, tip AS person_id, min(len)::BIGINT AS depth FROM trails GROUP BY ALL")
frag("walk", ["trails"], """SELECT tree_id, focal_id, tip AS person_id, len AS depth, min(ukey) AS wkey FROM (
  SELECT *, min(len) OVER (PARTITION BY focal_id, tip) AS ml FROM trails WHERE len > 0) WHERE len = ml GROUP BY ALL""")
frag("coll", ["up", "trails"], """SELECT tree_id, focal_id, person_id AS ancestor_id, paths, depth FROM up WHERE paths > 1""")

frag("pairs", [], """SELECT DISTINCT 'T' || (a // 64) AS tree_id, 'I' || a AS from_id, 'I' || b AS to_id FROM (
  SELECT p_partkey * 3 // 4 AS a, (p_partkey * 3 // 4) // 64 * 64 + (p_partkey * 37 + p_size) % 64 AS b FROM part)""")
frag("lines", [], """SELECT DISTINCT 'T' || t AS tree_id, 'I' || (t * 64 + 56 + q % 8) AS focal_id,
  'I' || (t * 64 + q // 8 % 16) AS ancestor_id FROM (SELECT p_partkey AS q, p_partkey * 3 // 4 // 64 AS t FROM part)""")
frag("lam", ["trails", "pairs"], """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY pkey) AS path_no,
    count(*) OVER (PARTITION BY from_id, to_id) AS n FROM (
  SELECT q.tree_id, q.from_id, q.to_id, a.len + b.len AS length, list_concat(a.steps, list_reverse(b.steps)[2:]) AS steps,
    list_concat(a.ukey, b.dkey) AS pkey
  FROM pairs q JOIN trails a ON a.focal_id = q.from_id JOIN trails b ON b.focal_id = q.to_id AND b.tip = a.tip
  WHERE q.from_id <> q.to_id AND len(list_intersect(a.steps, b.steps)) = 1))""")
frag("anc", ["trails", "lines"], """SELECT * FROM (SELECT l.tree_id, l.focal_id, l.ancestor_id, r.len AS length, r.steps,
    row_number() OVER (PARTITION BY l.focal_id, l.ancestor_id ORDER BY r.ukey) AS path_no,
    count(*) OVER (PARTITION BY l.focal_id, l.ancestor_id) AS n
  FROM lines l JOIN trails r ON r.focal_id = l.focal_id AND r.tip = l.ancestor_id AND r.len > 0)""")

frag("eraw", ["p0", "fam"], f"""SELECT tree_id, person_id || '-BIRT-0' AS event_id, k AS seq, person_id AS owner_id,
    NULL::VARCHAR AS family_id, 0::BIGINT AS ord, 'birth' AS type, 'BIRT' AS raw_tag, {date_text('k', Y)} AS date_raw,
    CASE WHEN k % 19 <> 1 THEN {spell('nk', 'k')} END AS place_raw, NULL::VARCHAR AS description, k % 4 = 0 AS cited FROM p0
  UNION ALL SELECT tree_id, person_id || '-DEAT-0', 1000000000000 + k, person_id, NULL, 1, 'death', 'DEAT',
    {date_text('k + 7', f'({Y} + 20 + k % 60)')}, CASE WHEN k % 5 <> 1 THEN {spell('nk + 1', 'k + 1')} END, NULL, k % 6 = 2
    FROM p0 WHERE k % 3 <> 0
  UNION ALL SELECT tree_id, family_id || '-MARR-0', 2000000000000 + f, NULL, family_id, 0, 'marriage', 'MARR',
    {date_text('f + 3', '(1722 + 28 * (f % 32 // 4) + f % 5)')}, CASE WHEN f % 7 <> 2 THEN {spell('f', 'f')} END, NULL, f % 3 = 0 FROM fam
  UNION ALL SELECT 'T' || (o_custkey // 64), 'I' || o_custkey || '-RESI-' || o_orderkey, 3000000000000 + o_orderkey,
    'I' || o_custkey, NULL, 10 + o_orderkey, 'residence', 'RESI',
    day(o_orderdate) || ' ' || ({MONTH_LIST})[month(o_orderdate)] || ' ' || (year(o_orderdate) - 240 + 28 * (o_custkey % 64 // 8)),
    {spell('o_orderkey', 'o_custkey')}, NULL, o_orderkey % 3 = 0 FROM orders
  UNION ALL SELECT 'T' || ({OWN} // 64), 'I' || {OWN} || '-MILI-' || event_id, 4000000000000 + event_id, 'I' || {OWN}, NULL,
    1000000000000 + event_id, 'military', 'MILI', CASE WHEN event_id % 10 <> 0 THEN 'ABT ' || (1770 + event_id * 7 % 215) END,
    CASE WHEN event_id % 4 = 1 THEN {spell('event_id', 'event_id')} END,
    CASE WHEN event_id % 12 <> 11 THEN ({sql_list(SERVICES)})[event_id % 12 + 1] END, event_id % 2 = 0
    FROM events WHERE event_type = 'error'""")

_W = r"regexp_replace(trim(date_raw), '^@#D[^@]*@\s*', '')"
frag("d1", ["eraw"], rf"""SELECT event_id, date_raw, w, CASE upper(regexp_extract(trim(date_raw), '^@#D([^@]*)@', 1))
    WHEN 'JULIAN' THEN 'julian' WHEN 'HEBREW' THEN 'hebrew' WHEN 'ROMAN' THEN 'roman' END AS calendar,
    CASE WHEN regexp_matches(w, '(?i)^BET\b\.?\s+.*?\s+AND\s+') THEN 'bet' WHEN regexp_matches(w, '(?i)^FROM\s+.*?\s+TO\s+') THEN 'span'
      WHEN regexp_matches(w, '(?i)^FROM\s+') THEN 'from' WHEN regexp_matches(w, '(?i)^TO\s+') THEN 'to'
      WHEN regexp_matches(w, '(?i)^ABT\b\.?\s+') THEN 'about' WHEN regexp_matches(w, '(?i)^BEF\b\.?\s+') THEN 'before'
      WHEN regexp_matches(w, '(?i)^AFT\b\.?\s+') THEN 'after' WHEN regexp_matches(w, '(?i)^EST\b\.?\s+') THEN 'estimated'
      WHEN regexp_matches(w, '(?i)^CAL\b\.?\s+') THEN 'calculated' ELSE 'exact' END AS kind
  FROM (SELECT event_id, date_raw, {_W} AS w FROM eraw WHERE date_raw IS NOT NULL)""")
frag("d2", ["d1"], r"""SELECT event_id, 'a' AS side, CASE kind WHEN 'exact' THEN w WHEN 'bet' THEN regexp_extract(w, '(?i)^BET\b\.?\s+(.*?)\s+AND\s+', 1)
    WHEN 'span' THEN regexp_extract(w, '(?i)^FROM\s+(.*?)\s+TO\s+', 1) WHEN 'to' THEN '' ELSE regexp_replace(w, '(?i)^[A-Z]+\.?\s+', '') END AS x FROM d1
  UNION ALL SELECT event_id, 'b', CASE kind WHEN 'bet' THEN regexp_extract(w, '(?i)\s+AND\s+(.*)$', 1)
    WHEN 'span' THEN regexp_extract(w, '(?i)\s+TO\s+(.*)$', 1) WHEN 'to' THEN regexp_replace(w, '(?i)^TO\s+', '') ELSE '' END FROM d1""")
_DBL = r"'^[0-9]{3,}/[0-9]{1,4}$'"
frag("d3", ["d2"], rf"""SELECT event_id, side, bc, toks, di, yt, mt, CASE WHEN di IS NOT NULL THEN toks[di]::BIGINT END AS day0,
    CASE WHEN mt IS NOT NULL THEN list_position({MONTH_LIST}, mt) END::BIGINT AS month,
    CASE WHEN yt IS NULL THEN NULL WHEN contains(yt, '/') THEN
      CASE WHEN len(split_part(yt, '/', 2)) > 2 THEN split_part(yt, '/', 2)::BIGINT
      WHEN split_part(yt, '/', 1)::BIGINT // 100 * 100 + split_part(yt, '/', 2)::BIGINT > split_part(yt, '/', 1)::BIGINT
      THEN split_part(yt, '/', 1)::BIGINT // 100 * 100 + split_part(yt, '/', 2)::BIGINT
      ELSE split_part(yt, '/', 1)::BIGINT // 100 * 100 + split_part(yt, '/', 2)::BIGINT + 100 END
    ELSE yt::BIGINT END * CASE WHEN bc THEN -1 ELSE 1 END AS year FROM (
  SELECT *, toks[list_filter(range(1, len(toks) + 1), lambda i: (regexp_matches(toks[i], '^[0-9]+$') OR regexp_matches(toks[i], {_DBL}))
      AND i IS DISTINCT FROM di)[-1]] AS yt,
    upper(list_filter(toks, lambda m: list_contains({MONTH_LIST}, upper(m)))[-1]) AS mt FROM (
  SELECT *, list_filter(range(1, len(toks) + 1), lambda i: regexp_matches(toks[i], '^(0?[1-9]|[12][0-9]|3[01])$'))[1] AS di FROM (
  SELECT event_id, side, regexp_matches(x, '(?i)\bB\.?\s*C\.?$') AS bc,
    list_filter(regexp_split_to_array(trim(regexp_replace(x, '(?i)\s*\bB\.?\s*C\.?$', '')), '\s+'), lambda s: s <> '') AS toks FROM d2)))""")
frag("d4", ["d3"], """SELECT event_id, side, year, month, CASE WHEN year IS NOT NULL OR month IS NOT NULL THEN day0 END AS day FROM d3""")
frag("dates", ["d1", "d4"], """SELECT event_id, raw, CASE WHEN NOT good THEN 'unknown' WHEN rng THEN 'range' ELSE kind END AS qualifier,
    CASE WHEN good THEN ay END AS year, CASE WHEN good THEN am END AS month, CASE WHEN good THEN ad END AS day,
    CASE WHEN good AND kind = 'exact' AND calendar IS NULL AND ay > 0 AND am IS NOT NULL AND ad IS NOT NULL
      THEN lpad(ay::VARCHAR, 4, '0') || '-' || lpad(am::VARCHAR, 2, '0') || '-' || lpad(ad::VARCHAR, 2, '0') END AS iso,
    CASE WHEN rng THEN bby END AS end_year, CASE WHEN rng THEN bm END AS end_month, CASE WHEN rng THEN bd END AS end_day, calendar FROM (
  SELECT d.event_id, d.date_raw AS raw, d.kind, d.calendar, kind IN ('bet', 'span', 'from', 'to') AS rng,
    a.year AS ay, a.month AS am, a.day AS ad, b.year AS bby, b.month AS bm, b.day AS bd,
    coalesce(a.year, a.month, a.day, b.year, b.month, b.day) IS NOT NULL AS good
  FROM d1 d JOIN d4 a ON a.event_id = d.event_id AND a.side = 'a' JOIN d4 b ON b.event_id = d.event_id AND b.side = 'b')""")

_PARTS = "list_filter(list_transform(string_split(place_raw, ','), lambda c: " + squash("c") + "), lambda c: c <> '')"
frag("places", ["eraw"], f"""SELECT tree_id, event_id, seq, raw, parts, lower(array_to_string(parts, ', ')) AS normalized FROM (
  SELECT tree_id, event_id, seq, place_raw AS raw, {_PARTS} AS parts FROM eraw WHERE place_raw IS NOT NULL)""")
frag("pdim", ["places"], """SELECT tree_id, normalized, min_by(raw, seq) AS raw, min_by(parts, seq) AS parts, count(*) AS uses FROM places GROUP BY ALL""")
frag("ev", ["eraw", "dates", "places", "pdim"], """SELECT e.tree_id, e.event_id, e.seq, e.owner_id, e.family_id, e.ord, e.type, e.description, e.cited,
    d.raw AS date_raw, d.year, d.month, d.day, d.end_year, q.normalized AS place_key, q.raw AS place_raw, q.parts,
    coalesce(d.year * 10000 + coalesce(d.month, 0) * 100 + coalesce(d.day, 0), 9007199254740991) AS sort_key
  FROM eraw e LEFT JOIN dates d USING (event_id) LEFT JOIN places p USING (event_id)
  LEFT JOIN pdim q ON q.tree_id = p.tree_id AND q.normalized = p.normalized""")
frag("touch", ["ev", "fs"], """SELECT tree_id, owner_id AS person_id, event_id FROM ev WHERE owner_id IS NOT NULL UNION
  SELECT e.tree_id, s.person_id, e.event_id FROM ev e JOIN fs s ON e.family_id = s.family_id""")
frag("located", ["touch", "ev"], """SELECT t.tree_id, t.person_id, t.event_id, e.type, e.year, e.sort_key, e.place_key, e.place_raw
  FROM touch t JOIN ev e USING (event_id) WHERE e.place_key IS NOT NULL""")
frag("firsts", ["ev"], """SELECT owner_id AS person_id, type, event_id, date_raw, year, month, day, place_raw, parts, place_key FROM (
  SELECT *, row_number() OVER (PARTITION BY owner_id, type ORDER BY ord) AS rn FROM ev WHERE owner_id IS NOT NULL) WHERE rn = 1""")
frag("vit", ["person", "firsts"], """SELECT p.tree_id, p.person_id, b.year AS byr, b.month AS bmo, b.day AS bda, b.date_raw AS bd, b.place_raw AS bp, b.parts AS bparts,
    d.year AS dyr, d.date_raw AS dd, d.place_raw AS dp, d.parts AS dparts
  FROM person p LEFT JOIN firsts b ON b.person_id = p.person_id AND b.type = 'birth'
  LEFT JOIN firsts d ON d.person_id = p.person_id AND d.type = 'death'""")


def war_case(y: str) -> str:
    from kinloom.functions.military import WARS

    return "CASE " + " ".join(f"WHEN {y} BETWEEN {a} AND {b} THEN '{n}'" for _, n, a, b in WARS) + " END"


def war_rank(w: str) -> str:
    from kinloom.functions.military import WARS

    return f"list_position({sql_list([x[1] for x in WARS])}, {w})"


frag("serv", ["touch", "ev"], f"""SELECT person_id, count(*) AS n,
    coalesce(list_sort(list(DISTINCT {war_rank(war_case('e.year'))}) FILTER ({war_case('e.year')} IS NOT NULL)), []) AS wr
  FROM touch t JOIN ev e USING (event_id) WHERE e.type = 'military' GROUP BY ALL""")


def wars_text(wr: str) -> str:
    from kinloom.functions.military import WARS

    return f"array_to_string(list_transform({wr}, lambda i: ({sql_list([x[1] for x in WARS])})[i]), '|')"


def build(final: str, *needs: str) -> str:
    """``WITH RECURSIVE`` text of all needed fragments followed by the query."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in FRAGMENTS[name][0]:
            if dep != name:
                visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final
    heavy = {"trails", "ev", "eraw", "po", "dates", "lam", "d3", "up"}
    ctes = ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in heavy and n != 'trails' else ''}({FRAGMENTS[n][1]})" for n in order
    )
    return f"WITH RECURSIVE {ctes}\n{final}"
