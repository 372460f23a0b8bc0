"""SQL twins of ``queries_text``."""

from __future__ import annotations

from kinloom.functions.military import BRANCH_RULES, RANK_RULES, UNIT_PATTERN, WAR_RULES
from kinloom.functions.places import COUNTRY_ALIASES, COUNTRY_WORDS, STATES, WORD_EXPANSIONS
from kinloom.functions.kinship_terms import COUNT_WORDS, ORDINAL_WORDS
from kinloom.plans.queries_text import SEARCHES
from oracles.fragments import build, squash, sql_list, war_case, wars_text

MON = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def rules(text: str, table: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{v}'" for p, v in table)
    return f"CASE {whens} END"


def society_date(y: str, m: str, d: str) -> str:
    label = f"CASE WHEN {y} < 0 THEN abs({y}) || ' BC' ELSE {y}::VARCHAR END"
    return (
        f"CASE WHEN {y} IS NULL THEN '' WHEN {m} BETWEEN 1 AND 12 THEN concat_ws(' ', "
        f"CASE WHEN {d} BETWEEN 1 AND 31 THEN lpad({d}::VARCHAR, 2, '0') END, ({MON})[{m}], {label}) ELSE {label} END"
    )


def state(x: str) -> str:
    names = "MAP {" + ", ".join(f"'{n.lower()}': '{c}'" for c, n in STATES.items()) + "}"
    codes = sql_list(list(STATES))
    return (
        f"coalesce({names}[lower(trim({x}))], "
        f"CASE WHEN list_contains({codes}, upper(trim({x}))) THEN upper(trim({x})) END)"
    )


def ordinal(n: str) -> str:
    return (
        f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' "
        f"WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"
    )


def great(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN '' WHEN {n} = 1 THEN 'great-' ELSE {ordinal(n)} || ' great-' END"


def lineal(g: str, root: str) -> str:
    return (
        f"CASE WHEN {g} <= 1 THEN {root} WHEN {g} = 2 THEN 'grand' || {root} "
        f"ELSE {great(f'({g} - 2)')} || 'grand' || {root} END"
    )


def by_sex(s: str, m: str, f: str, u: str) -> str:
    return f"CASE {s} WHEN 'male' THEN '{m}' WHEN 'female' THEN '{f}' ELSE '{u}' END"


FATHER = by_sex("sex", "father", "mother", "parent")
SON = by_sex("sex", "son", "daughter", "child")


def word(n: str) -> str:
    return f"coalesce(({sql_list(ORDINAL_WORDS)})[{n} + 1], {ordinal(n)})"


def times(n: str) -> str:
    many = f"coalesce(({sql_list(COUNT_WORDS)})[{n} + 1], {n}::VARCHAR) || ' times'"
    return f"CASE WHEN {n} = 1 THEN 'once' WHEN {n} = 2 THEN 'twice' ELSE {many} END"


_COUNTY = r"(?i)\s*\bcounty\b\s*$"
_CO = r"(?i)\s*\bco\.?\s*$"


def strip_county(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{_COUNTY}', ''), '{_CO}', ''))"


SOCIETY_PLACE = rf"""
SELECT event_id, CASE WHEN raw IS NULL OR (len(segs) = 1 AND segs[1] = '') THEN '' ELSE
  CASE WHEN loc = 1 THEN '' WHEN loc = 2 THEN CASE WHEN cty THEN '' ELSE segs[1] END
    ELSE trim(array_to_string(segs[1:loc - 2], ', ')) END || '/' ||
  CASE WHEN loc = 1 THEN '' WHEN loc = 2 THEN CASE WHEN cty THEN {strip_county('segs[1]')} ELSE '' END
    ELSE {strip_county('segs[loc - 1]')} END || '/' || coalesce({state('segs[loc]')}, segs[loc]) END AS label
FROM (SELECT *, regexp_matches(segs[1], '(?i)\bcounty\b\s*$') OR regexp_matches(segs[1], '{_CO}') AS cty FROM (
  SELECT event_id, raw, segs, coalesce(list_position(list_transform(segs, lambda s: {state('s')} IS NOT NULL), true), least(3, len(segs))) AS loc
  FROM (SELECT event_id, place_raw AS raw, list_transform(string_split(place_raw, ','), lambda s: trim(s)) AS segs FROM SRC)))"""

_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in COUNTRY_ALIASES.items()) + "}"
_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in STATES.items()) + "}"
_WORDS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in WORD_EXPANSIONS.items()) + "}"

# The ladder over SRC(id, raw, parts): clean parts, drop echoes of expansions, then suffixes.
LADDER = rf"""
 lp AS (SELECT id, i, x, coalesce({_ALIAS}[lower(x)], CASE WHEN regexp_matches(x, '^[A-Za-z]{{2}}$') THEN {_CODE}[upper(x)] END,
    array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce({_WORDS}[lower(regexp_replace(w, '\.+$', ''))], w)), ' ')) AS c,
    {_ALIAS}[lower(x)] IS NOT NULL OR (regexp_matches(x, '^[A-Za-z]{{2}}$') AND {_CODE}[upper(x)] IS NOT NULL) AS whole
  FROM (SELECT id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM src)),
 lq AS (SELECT id, i, c, whole OR c <> x AS e FROM lp),
 lk AS (SELECT id, i, c FROM (SELECT *, lag(c) OVER w AS pc, lag(e) OVER w AS pe FROM lq WINDOW w AS (PARTITION BY id ORDER BY i))
   WHERE NOT coalesce(lower(pc) = lower(c) AND (pe OR e), false)),
 ll AS (SELECT id, list(c ORDER BY i) AS t FROM lk GROUP BY id),
 lc AS (SELECT id, unnest(range(1, len(t) + 1)) AS n, unnest(list_transform(range(1, len(t) + 1), lambda j: array_to_string(t[j:], ', '))) AS q FROM ll
   UNION ALL SELECT id, 1000, trim(raw) FROM src),
 ladder AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS rung, q AS query FROM (
   SELECT *, row_number() OVER (PARTITION BY id, lower(q) ORDER BY n) AS dup FROM lc WHERE q <> '') WHERE dup = 1)"""

_UNIT = UNIT_PATTERN.replace("(?:[A-Za-z.][\\w.]*\\s+)*?", "(?:[A-Za-z.][\\w.]*\\s+)*?")

_FIRST_PLACE = """(SELECT owner_id AS person_id, min_by(coalesce(parts[1], place_raw), ord) AS fp FROM ev
  WHERE owner_id IS NOT NULL AND place_key IS NOT NULL GROUP BY ALL)"""

_SEARCH = " UNION ALL ".join(
    f"""SELECT '{q}' AS query, tree_id, person_id, k FROM pname WHERE trim('{q}') <> '' AND (
  contains(lower("full"), lower(trim('{q}'))) OR contains(lower(coalesce(given, '')), lower(trim('{q}')))
  OR contains(lower(coalesce(surname, '')), lower(trim('{q}'))) OR contains(lower(raw), lower(trim('{q}'))))"""
    for q in SEARCHES
)

_FACTS = """
nm AS (SELECT tree_id, person_id, sex, coalesce(given, '') AS g, coalesce(surname, '') AS s, trim(full_name) AS f FROM person),
par AS (SELECT p.child_id, n.*, row_number() OVER (PARTITION BY p.child_id ORDER BY p.f, p.pord) AS rn
  FROM po p JOIN nm n ON n.person_id = p.parent_id),
folks AS (SELECT a.child_id, CASE WHEN a.sex = 'female' THEN b.g END AS fg, CASE WHEN a.sex = 'female' THEN b.s ELSE a.s END AS fs,
    CASE WHEN a.sex = 'female' THEN b.f ELSE a.f END AS father, CASE WHEN a.sex = 'female' THEN b.g ELSE a.g END AS fag,
    CASE WHEN a.sex = 'female' THEN a.f ELSE b.f END AS mother, CASE WHEN a.sex = 'female' THEN a.g ELSE b.g END AS mag,
    CASE WHEN a.sex = 'female' THEN a.s ELSE b.s END AS mas
  FROM par a LEFT JOIN par b ON a.child_id = b.child_id AND b.rn = 2 WHERE a.rn = 1),
wed AS (SELECT q.person_id, list(n.f ORDER BY q.f, q.sord) AS sf, first(n.g ORDER BY q.f, q.sord) AS sg, first(n.s ORDER BY q.f, q.sord) AS ss
  FROM sp q JOIN nm n ON n.person_id = q.spouse_id GROUP BY ALL),
kid AS (SELECT p.parent_id AS person_id, list(n.f ORDER BY p.f, p.cord) AS kf, list(n.g ORDER BY p.f, p.cord) AS kg,
  list(n.s ORDER BY p.f, p.cord) AS ks FROM po p JOIN nm n ON n.person_id = p.child_id GROUP BY ALL)"""


def enc(x: str) -> str:
    return f"replace(url_encode(trim({x})), '%20', '+')"


def packed(g: str, s: str, f: str) -> str:
    return f"coalesce(nullif(concat_ws('_', nullif({enc(g)}, ''), nullif({enc(s)}, '')), ''), {enc(f)})"


def packed_event(y: str, parts: str) -> str:
    place = f"nullif(array_to_string(list_transform({parts}, lambda z: {enc('z')}), '-'), '')"
    return f"nullif(concat_ws('_', {y}::VARCHAR, {place}), '')"


def form(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


_KIDS = (
    "array_to_string(list_transform(range(1, least(8, len(kf)) + 1), lambda i: 'child' || CASE WHEN i = 1 THEN '' ELSE i::VARCHAR END "
    f"|| '=' || {packed('kg[i]', 'ks[i]', 'kf[i]')}), '&')"
)

ORACLES = {
    "dates_normalised": build("SELECT * FROM dates", "dates"),
    "society_dates": build(f"SELECT event_id, {society_date('year', 'month', 'day')} AS label FROM dates", "dates"),
    "event_sort_keys": build("SELECT event_id, sort_key FROM ev", "ev"),
    "life_lines": build(
        f"""SELECT v.tree_id, v.person_id, CASE WHEN byr IS NOT NULL AND dyr IS NOT NULL THEN byr || '–' || dyr WHEN byr IS NOT NULL THEN 'b. ' || byr
  WHEN dyr IS NOT NULL THEN 'd. ' || dyr ELSE '' END AS life_span, coalesce(bparts[1], bp, fp, '') AS primary_place
  FROM vit v LEFT JOIN {_FIRST_PLACE} x USING (person_id)""", "vit", "ev"),
    "names_parsed": build('SELECT person_id, pos0::BIGINT AS pos, raw, given, surname, "full", is_primary FROM pname', "pname"),
    "sexes_parsed": build("SELECT person_id, sex FROM praw", "praw"),
    "display_names": build(
        "SELECT person_id, name AS shown, trim(name) AS sketch, trim(name_or_id) AS locality FROM person", "person"),
    "name_search": build(
        f"""SELECT tree_id, query, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, query ORDER BY k) AS rank
  FROM (SELECT DISTINCT * FROM ({_SEARCH})))""", "pname"),
    "name_search_texts": build(
        """SELECT tree_id, query, person_id, row_number() OVER (PARTITION BY tree_id, query ORDER BY k) AS rank FROM (
  SELECT DISTINCT n.tree_id, q.query, n.person_id, n.k FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'aliaS ' || p_partkey
      ELSE ' #' || lpad((p_partkey * 3 // 4)::VARCHAR, 6, '0') END AS query FROM part) q
  JOIN pname n ON contains(lower(n."full"), lower(trim(q.query))) OR contains(lower(coalesce(n.given, '')), lower(trim(q.query)))
    OR contains(lower(coalesce(n.surname, '')), lower(trim(q.query))) OR contains(lower(n.raw), lower(trim(q.query))))""", "pname"),
    "people_list": build(
        """SELECT tree_id, person_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY k) AS rank FROM p0)""", "p0"),
    "places_parsed": build("SELECT event_id, raw, normalized, array_to_string(parts, '|') AS parts FROM places", "places"),
    "place_dimension": build("SELECT tree_id, normalized, raw, array_to_string(parts, '|') AS parts, uses FROM pdim", "pdim"),
    "interned_places": build("SELECT event_id, place_raw FROM ev", "ev"),
    "place_regions": build(
        f"""SELECT event_id, CASE WHEN lower(parts[-1]) IN ({", ".join(repr(w) for w in COUNTRY_WORDS)}) AND len(parts) >= 2
  THEN parts[-2] ELSE parts[-1] END AS region FROM ev WHERE place_key IS NOT NULL""", "ev"),
    "state_codes": build(
        f"""SELECT event_id, pos, {state('segment')} AS code FROM (SELECT event_id, unnest(range(0, len(s))) AS pos, unnest(s) AS segment
  FROM (SELECT event_id, string_split(place_raw, ',') AS s FROM eraw WHERE place_raw IS NOT NULL))""", "eraw"),
    "society_places": build(SOCIETY_PLACE.replace("SRC", "eraw"), "eraw"),
    "place_query_ladder": build("SELECT event_id, place_raw AS raw, parts FROM ev WHERE false", "ev").split("\nSELECT event_id, place_raw")[0]
    + ",\n src AS (SELECT event_id AS id, place_raw AS raw, parts FROM ev WHERE place_key IS NOT NULL),"
    + LADDER + "\nSELECT id AS event_id, rung, query FROM ladder",
    "war_classes": build(f"SELECT event_id, year, {war_case('year')} AS war FROM ev WHERE year IS NOT NULL", "ev"),
    "service_records": build(
        f"""SELECT t.person_id, event_id, nullif(description, '') AS raw,
  coalesce({war_case('e.year')}, {rules("coalesce(description, '')", WAR_RULES)}) AS war,
  {rules("coalesce(description, '')", BRANCH_RULES)} AS branch, {rules("coalesce(description, '')", RANK_RULES)} AS rank,
  nullif({squash(f"regexp_extract(coalesce(description, ''), '{_UNIT}', 1)")}, '') AS unit, date_raw AS service_raw,
  year AS start_year, end_year FROM touch t JOIN ev e USING (event_id) WHERE e.type = 'military'""", "touch", "ev"),
    "military_service": build(f"SELECT person_id, n AS events, {wars_text('wr')} AS wars FROM serv", "serv"),
    "ordinal_terms": f"""SELECT p_partkey, {ordinal('n')} AS ordinal, {word('n')} AS word, {times('n')} AS times, {great('n')} AS great
  FROM (SELECT p_partkey, p_partkey % 130 AS n FROM part)""",
    "lineal_terms": build(
        f"SELECT person_id, {lineal('g', FATHER)} AS up, {lineal('g', SON)} AS down FROM (SELECT *, k % 24 + 1 AS g FROM person)",
        "person"),
    "research_facts": build("SELECT 1", "person", "po", "sp", "vit").rsplit("\nSELECT 1", 1)[0] + "," + _FACTS + """
SELECT n.person_id, n.f AS full_name, n.sex, v.byr AS birth_year, v.bp AS birth_raw, v.dyr AS death_year, v.dp AS death_raw, father, mother,
  sf[1] AS spouse, coalesce(array_to_string(sf, '|'), '') AS spouses, coalesce(array_to_string(kf, '|'), '') AS children
FROM nm n JOIN vit v USING (person_id) LEFT JOIN folks ON folks.child_id = n.person_id LEFT JOIN wed USING (person_id) LEFT JOIN kid USING (person_id)""",
    "search_links": build("SELECT 1", "person", "po", "sp", "vit").rsplit("\nSELECT 1", 1)[0] + "," + _FACTS + f"""
SELECT n.person_id, 'https://www.ancestry.com/search/?' || concat_ws('&', 'name=' || nullif({packed('n.g', 'n.s', 'n.f')}, ''),
    'birth=' || {packed_event('v.byr', 'v.bparts')}, 'death=' || {packed_event('v.dyr', 'v.dparts')},
    'father=' || {packed('fag', 'folks.fs', 'father')}, 'mother=' || {packed('mag', 'mas', 'mother')},
    'spouse=' || {packed('sg', 'ss', 'sf[1]')}, nullif({_KIDS}, ''),
    CASE n.sex WHEN 'male' THEN 'gender=m' WHEN 'female' THEN 'gender=f' END, 'searchMode=advanced') AS ancestry,
  'https://www.familysearch.org/en/search/record/results?' || concat_ws('&', 'q.givenName=' || nullif({form('n.g')}, ''),
    'q.surname=' || nullif({form('n.s')}, ''), 'q.birthLikePlace=' || nullif({form('v.bp')}, ''),
    'q.birthLikeDate.from=' || (v.byr - 2) || '&q.birthLikeDate.to=' || (v.byr + 2), 'q.deathLikePlace=' || nullif({form('v.dp')}, ''),
    'q.deathLikeDate.from=' || (v.dyr - 2) || '&q.deathLikeDate.to=' || (v.dyr + 2)) AS familysearch,
  'https://services.dar.org/Public/DAR_Research/search/?Tab_ID=1' AS dar
FROM nm n JOIN vit v USING (person_id) LEFT JOIN folks ON folks.child_id = n.person_id LEFT JOIN wed USING (person_id) LEFT JOIN kid USING (person_id)""",
    "person_sketch": build(
        f"""SELECT p.person_id, trim(p.name) AS name, p.sex, v.bd AS birth_raw, v.byr AS birth_year, v.bp AS birth_place, v.dd AS death_raw,
  v.dyr AS death_year, v.dp AS death_place, v.dyr - v.byr AS age_at_death, coalesce(w.s, 0) AS spouses, coalesce(c.n, 0) AS children,
  s.n IS NOT NULL AS served, coalesce({wars_text('s.wr')}, '') AS wars
FROM person p JOIN vit v USING (person_id)
LEFT JOIN (SELECT person_id, count(*) AS s FROM sp GROUP BY ALL) w USING (person_id)
LEFT JOIN (SELECT parent_id AS person_id, count(*) AS n FROM po GROUP BY ALL) c USING (person_id) LEFT JOIN serv s USING (person_id)""",
        "person", "vit", "sp", "po", "serv"),
    "research_relatives": build("SELECT 1", "person", "po", "sp", "vit").rsplit("\nSELECT 1", 1)[0] + "," + _FACTS + """,
rel AS (SELECT child_id AS person_id, 'parent' AS role, parent_id AS other_id, f AS k1, pord AS k2 FROM po UNION ALL SELECT person_id, 'spouse', spouse_id, f, sord FROM sp
  UNION ALL SELECT parent_id, 'child', child_id, f, cord FROM po)
SELECT r.person_id, r.role, row_number() OVER (PARTITION BY r.person_id, r.role ORDER BY k1, k2, other_id) AS position, r.other_id, n.f AS "full"
FROM rel r JOIN nm n ON n.person_id = r.other_id""",
    "society_vitals": build("SELECT 1", "vit").rsplit("\nSELECT 1", 1)[0]
    + ", lab AS (" + SOCIETY_PLACE.replace("SRC", "(SELECT person_id AS event_id, bp AS place_raw FROM vit)") + f""")
SELECT v.person_id, concat_ws(' · ', nullif({society_date('byr', 'bmo', 'bda')}, ''), nullif(l.label, '')) AS vitals
FROM vit v JOIN lab l ON l.event_id = v.person_id""",
}
