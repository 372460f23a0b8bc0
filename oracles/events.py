"""SQL twins of ``queries_events``."""

from __future__ import annotations

from kinloom.functions.places import COUNTRY_WORDS
from oracles.fragments import build, war_case
from oracles.graph import more


GAZ = """gaz AS (SELECT n, CASE n % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'nominatim' ELSE 'photon' END AS provider,
    lower(array_to_string(keep[n % 3 + 1:], ', ')) AS query, (n * 1.5 - 20)::DOUBLE AS lat, (n * -2.25 + 10)::DOUBLE AS lon,
    CASE WHEN n % 2 = 1 THEN n::DOUBLE / 16 END AS importance, CASE WHEN n % 4 < 3 THEN 'Place ' || n END AS resolved_name
  FROM (SELECT n_nationkey::BIGINT AS n, list_filter(list_transform(string_split(PLACES[n_nationkey + 1], ','), lambda x: trim(x)), lambda x: x <> '') AS keep FROM nation)
  WHERE array_to_string(keep[n % 3 + 1:], ', ') <> '')"""


def gaz() -> str:
    from kinloom.plans.bridge import PLACES
    from oracles.fragments import sql_list

    return GAZ.replace("PLACES", f"({sql_list(PLACES)})")


COORD = """, coord AS (SELECT query AS place_key, min_by(lat, n) AS lat, min_by(lon, n) AS lon FROM gaz GROUP BY ALL),
res AS (SELECT l.*, c.lat, c.lon FROM located l JOIN coord c USING (place_key)),
seqd AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sort_key, event_id) AS position, count(*) OVER (PARTITION BY person_id) AS n FROM res),
rng AS (SELECT person_id, min(year) AS lo, max(year) AS hi, count(*) AS located FROM res GROUP BY ALL),
frames AS (SELECT DISTINCT person_id, unnest(list_append(range(lo, hi + 1, greatest(1, ceil((hi - lo) / 16)::BIGINT)), hi)) AS frame_year FROM rng WHERE hi > lo)"""

R1 = "floor({} * 10 + 0.5) / 10"
PF = f"""pf AS (SELECT v.person_id, CASE WHEN dyr >= byr THEN dyr - byr END AS age,
    nullif(CASE WHEN lower(bparts[-1]) IN ({", ".join(repr(w) for w in COUNTRY_WORDS)}) AND len(bparts) >= 2 THEN bparts[-2] ELSE bparts[-1] END, '') AS region,
    s.n IS NOT NULL AS served FROM vit v LEFT JOIN serv s USING (person_id)),
af AS (SELECT u.tree_id, u.focal_id, u.person_id, u.depth, pf.age, pf.region, pf.served FROM up u JOIN pf USING (person_id)),
fz AS (SELECT focal_id, count(*) AS couples, {R1.format('(sum(coalesce(kids, 0)) / count(*))')} AS average_children FROM (
  SELECT DISTINCT u.focal_id, s.family_id FROM up u JOIN fs s ON s.person_id = u.person_id) LEFT JOIN
  (SELECT family_id, count(*) AS kids FROM fc GROUP BY ALL) USING (family_id) GROUP BY ALL)"""
PF_NEEDS = ("vit", "serv", "up", "fs", "fc", "p0")

ALLEV = """allev AS (SELECT owner_id AS person_id, event_id FROM ev WHERE owner_id IS NOT NULL UNION
  SELECT s.person_id, e.event_id FROM ev e JOIN fs s ON e.family_id = s.family_id),
rf AS (SELECT a.person_id, trim(p.name_or_id) AS person_name, a.event_id, e.type, e.date_raw, e.year, coalesce(e.place_key, '') AS place_key,
    coalesce(e.place_raw, '(place unknown)') AS place_label, CASE WHEN e.cited THEN 'sourced' ELSE 'unsourced' END AS status
  FROM allev a JOIN ev e USING (event_id) JOIN person p ON p.person_id = a.person_id
  UNION ALL SELECT p.person_id, trim(p.name_or_id), NULL, m.type, NULL, NULL, '', '(no record)', 'none' FROM person p
  JOIN (SELECT 'birth' AS type UNION ALL SELECT 'death' UNION ALL SELECT 'marriage') m
    ON m.type <> 'marriage' OR EXISTS (SELECT 1 FROM fs WHERE fs.person_id = p.person_id)
  WHERE NOT EXISTS (SELECT 1 FROM allev a JOIN ev e USING (event_id) WHERE a.person_id = p.person_id AND e.type = m.type)),
ol AS (SELECT DISTINCT tree_id, focal_id, ancestor_id, unnest(steps) AS person_id FROM anc),
lf AS (SELECT ol.tree_id, ol.focal_id, ol.ancestor_id, rf.* FROM ol JOIN rf USING (person_id)),
lr AS (SELECT *, row_number() OVER (PARTITION BY focal_id, ancestor_id ORDER BY place_key = '', place_label, place_key) AS place_no FROM (
  SELECT tree_id, focal_id, ancestor_id, place_key, min_by(place_label, (coalesce(year, 9007199254740991), person_name, type, person_id, coalesce(event_id, ''))) AS place_label,
    count(*) AS facts, count(DISTINCT person_id) AS people, count(*) FILTER (status = 'sourced') = 0 AS is_target FROM lf GROUP BY ALL))"""
ALLEV_NEEDS = ("ev", "fs", "person", "anc", "lines")

LINKS = """hop AS (SELECT tree_id, focal_id, ancestor_id, steps[i] AS child_id, steps[i + 1] AS parent_id, min(i) AS generation FROM (
  SELECT *, unnest(range(1, len(steps))) AS i FROM anc) GROUP BY ALL),
lk AS (SELECT *, child_id || '->' || parent_id AS link_key, row_number() OVER (PARTITION BY focal_id, ancestor_id ORDER BY generation, child_id || '->' || parent_id) AS link_no FROM hop),
prf AS (SELECT *, CASE WHEN doc THEN [link] WHEN q % 5 = 0 THEN [link, 'service'] ELSE [link] END AS keys FROM (
  SELECT o_orderkey AS q, 'I' || (o_custkey // 64 * 64 + 56 + o_orderkey % 8) AS focal_id, 'I' || (o_custkey // 64 * 64 + o_orderkey // 8 % 16) AS ancestor_id,
    o_orderstatus = 'F' AS doc, CASE WHEN o_custkey % 64 // 8 = 0 THEN 'service' ELSE 'I' || o_custkey || '->I' ||
      (o_custkey // 64 * 64 + (o_custkey % 64 // 8 - 1) * 8 + (o_custkey % 8 * 3 + o_custkey % 64 // 8) % 4 * 2 + o_orderkey % 2) END AS link,
    1975 + o_orderkey % 25 AS yr FROM orders)),
item AS (SELECT tree_id, focal_id, ancestor_id, link_key FROM lk UNION ALL SELECT DISTINCT tree_id, focal_id, ancestor_id, 'service' FROM lines),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focal_id, ancestor_id, link_key ORDER BY CASE WHEN doc THEN 0 WHEN yr >= 1985 THEN 1 ELSE 2 END, q) AS rn
  FROM (SELECT *, unnest(list_distinct(keys)) AS link_key FROM prf)) WHERE rn = 1),
evl AS (SELECT i.tree_id, i.focal_id, i.ancestor_id, i.link_key, CASE WHEN b.doc THEN 'sourced-by-document' WHEN b.yr >= 1985 THEN 'proven-by-record-copy' ELSE 'unproven' END AS status,
    CASE WHEN b.doc THEN 'D' || b.q END AS doc_id, CASE WHEN NOT b.doc THEN (b.q + 1000)::VARCHAR END AS record_copy,
    coalesce(NOT b.doc AND b.yr < 1985, false) AS insufficient,
    CASE WHEN NOT b.doc AND i.link_key = 'service' THEN CASE WHEN b.q % 2 = 0 THEN 'SAR' ELSE 'DAR' END || '# ' || (b.q + 1000) || CASE WHEN b.q % 4 = 1 THEN ' cites pension file' ELSE '' END END AS citation
  FROM item i LEFT JOIN best b ON b.focal_id = i.focal_id AND b.ancestor_id = i.ancestor_id AND b.link_key = i.link_key)"""

TOTALS = """SELECT tree_id, focal_id, ancestor_id, count(*) AS total, count(*) FILTER (status <> 'unproven') AS proven,
  count(*) FILTER (status = 'unproven' AND link_key <> 'service') AS unproven_links, bool_or(status = 'unproven' AND link_key = 'service') AS service_unproven,
  count(*) FILTER (status <> 'unproven') / count(*) AS completeness"""


def by_society(final: str) -> str:
    """The checklists once with each cutoff."""
    each = [f"SELECT *, '{name}' AS society_id FROM ({more(LINKS.replace('1985', year), final, 'anc', 'lines')})" for name, year in (("sar", "1985"), ("later", "1992"))]
    return " UNION ALL ".join(each)


ORACLES = {
    "first_events": build("SELECT person_id, type, event_id, year FROM firsts", "firsts"),
    "all_person_events": build(
        """SELECT owner_id AS person_id, event_id FROM ev WHERE owner_id IS NOT NULL UNION
SELECT s.person_id, e.event_id FROM ev e JOIN fs s ON e.family_id = s.family_id""", "ev", "fs"),
    "event_sequence": build(
        "SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sort_key, event_id) AS position FROM located", "located"),
    "line_stops": more(
        """lp AS (SELECT * FROM (SELECT l.tree_id, l.focal_id, l.ancestor_id, list_concat(a.steps, list_reverse(b.steps)[2:]) AS steps,
    row_number() OVER (PARTITION BY l.focal_id, l.ancestor_id ORDER BY list_concat(a.ukey, b.dkey)) AS rn
  FROM lines l JOIN trails a ON a.focal_id = l.focal_id JOIN trails b ON b.focal_id = l.ancestor_id AND b.tip = a.tip
  WHERE l.focal_id <> l.ancestor_id AND len(list_intersect(a.steps, b.steps)) = 1) WHERE rn = 1),
lm AS (SELECT tree_id, focal_id || '>' || ancestor_id AS set_id, unnest(range(1, len(steps) + 1)) AS pos, unnest(steps) AS person_id FROM lp)""",
        """SELECT tree_id, set_id, event_id, person_id, year, sort_key, place_key FROM (SELECT m.tree_id, m.set_id, l.event_id, l.person_id, l.year, l.sort_key, l.place_key,
  row_number() OVER (PARTITION BY m.set_id, l.event_id ORDER BY m.pos) AS rn FROM lm m JOIN located l ON l.person_id = m.person_id) WHERE rn = 1""",
        "lines", "trails", "located"),
    "ancestor_stops": more(
        """mem AS (SELECT tree_id, focal_id, person_id, depth, wkey FROM walk UNION ALL SELECT tree_id, person_id, person_id, 0, [0::BIGINT][:0] FROM p0),
st AS (SELECT * FROM (SELECT m.tree_id, m.focal_id, l.*, row_number() OVER (PARTITION BY m.focal_id, l.event_id ORDER BY m.depth, m.wkey) AS rn
  FROM mem m JOIN (SELECT person_id, event_id, sort_key, place_key FROM located) l ON l.person_id = m.person_id) WHERE rn = 1)""",
        """SELECT tree_id, focal_id, count(*) AS stops, count(DISTINCT person_id) AS owners, count(DISTINCT place_key) AS places,
  min_by(event_id, (sort_key, event_id)) AS first_event, min_by(person_id, (sort_key, event_id)) AS first_owner,
  max_by(event_id, (sort_key, event_id)) AS last_event FROM st GROUP BY ALL""", "walk", "p0", "located"),
    "ancestor_stop_rows": more(
        """mem AS (SELECT tree_id, focal_id, person_id, depth, wkey FROM walk UNION ALL SELECT tree_id, person_id, person_id, 0, [0::BIGINT][:0] FROM p0),
st AS (SELECT * FROM (SELECT m.tree_id, m.focal_id, l.*, row_number() OVER (PARTITION BY m.focal_id, l.event_id ORDER BY m.depth, m.wkey) AS rn
  FROM mem m JOIN (SELECT person_id, event_id, year, sort_key, place_key FROM located) l ON l.person_id = m.person_id) WHERE rn = 1)""",
        "SELECT tree_id, focal_id, event_id, person_id, year, sort_key, place_key FROM st", "walk", "p0", "located"),
    "unique_stop_places": build(
        "SELECT tree_id, person_id AS set_id, place_key, min_by(place_raw, (sort_key, event_id)) AS place_raw FROM located GROUP BY ALL", "located"),
    "resolved_stops": more(gaz() + COORD, "SELECT person_id, event_id, place_key, lat, lon FROM res", "located"),
    "migration_legs": more(
        gaz() + COORD,
        """SELECT a.person_id, a.position, a.event_id AS from_event, b.event_id AS to_event, a.lat AS from_lat, a.lon AS from_lon, b.lat AS to_lat, b.lon AS to_lon
FROM seqd a JOIN seqd b ON a.person_id = b.person_id AND b.position = a.position + 1""", "located"),
    "stop_time_order": more(
        gaz() + COORD,
        "SELECT person_id, event_id, position, CASE WHEN n <= 1 THEN 0.0 ELSE (position - 1) / (n - 1) END::DOUBLE AS fraction FROM seqd", "located"),
    "stop_year_range": more(gaz() + COORD, "SELECT person_id, lo AS min_year, hi AS max_year, located FROM rng", "located"),
    "time_frames": more(gaz() + COORD, "SELECT * FROM frames", "located"),
    "visible_per_frame": more(
        gaz() + COORD,
        """SELECT f.person_id, f.frame_year, count(*) AS visible FROM frames f JOIN res r ON r.person_id = f.person_id
  AND (r.year IS NULL OR r.year <= f.frame_year) GROUP BY ALL""", "located"),
    "visible_until_1800": more(gaz() + COORD, "SELECT person_id, event_id, year FROM res WHERE year IS NULL OR year <= 1800", "located"),
    "family_stats": more(
        PF,
        f"""SELECT p.tree_id, p.person_id AS focal_id, coalesce(a.n, 0) AS ancestors, coalesce(a.g, 0) AS max_generation, coalesce(a.aged, 0) AS aged, a.av AS average_years,
  a.md AS median_years, coalesce(a.served, 0) AS served, coalesce(fz.couples, 0) AS couples, fz.average_children
FROM p0 p LEFT JOIN (SELECT focal_id, count(*) AS n, max(depth) AS g, count(age) AS aged, {R1.format('avg(age)')} AS av, median(age) AS md,
  count(*) FILTER (served) AS served FROM af GROUP BY ALL) a ON a.focal_id = p.person_id LEFT JOIN fz ON fz.focal_id = p.person_id""", *PF_NEEDS),
    "top_birth_regions": more(
        PF,
        """SELECT * FROM (SELECT focal_id, row_number() OVER (PARTITION BY focal_id ORDER BY people DESC, region) AS rank, region, people FROM (
  SELECT focal_id, region, count(*) AS people FROM af WHERE region IS NOT NULL GROUP BY ALL)) WHERE rank <= 5""", *PF_NEEDS),
    "war_tally": build(
        f"""SELECT u.focal_id, w.war, count(*) AS people FROM up u JOIN (SELECT DISTINCT t.person_id, {war_case('e.year')} AS war FROM touch t JOIN ev e USING (event_id)
  WHERE e.type = 'military') w ON w.person_id = u.person_id WHERE w.war IS NOT NULL GROUP BY ALL""", "up", "touch", "ev"),
    "ancestor_longevity": more(
        PF, f"""SELECT focal_id, count(age) AS aged, {R1.format('avg(age)')} AS average_years, median(age) AS median_years FROM af WHERE age IS NOT NULL GROUP BY ALL""",
        *PF_NEEDS),
    "ancestral_family_sizes": more(PF, "SELECT * FROM fz", *PF_NEEDS),
    "data_richness": build(
        """SELECT person_id, CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END + (SELECT count(*) FROM ev WHERE owner_id = p.person_id) + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END
  + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS richness FROM p0 p""", "p0", "ev"),
    "merge_survivor_choice": more(
        """rich AS (SELECT person_id, CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END + (SELECT count(*) FROM ev WHERE owner_id = p.person_id) + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END
  + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS r FROM p0 p)""",
        """SELECT q.tree_id, from_id, to_id, CASE WHEN coalesce(a.r, 0) >= coalesce(b.r, 0) THEN from_id ELSE to_id END AS keep_id
FROM pairs q LEFT JOIN rich a ON a.person_id = from_id LEFT JOIN rich b ON b.person_id = to_id""", "p0", "ev", "pairs"),
    "people_on_line": more(ALLEV, "SELECT * FROM ol", *ALLEV_NEEDS),
    "research_person_facts": more(ALLEV, "SELECT * FROM rf", *ALLEV_NEEDS),
    "locality_report": more(
        ALLEV, "SELECT tree_id, focal_id, ancestor_id, place_no, place_key, place_label, facts, people, is_target FROM lr", *ALLEV_NEEDS),
    "research_gaps": more(
        ALLEV, "SELECT tree_id, focal_id, ancestor_id, count(*) FILTER (status <> 'sourced') AS gaps, count(*) AS facts FROM lf GROUP BY ALL", *ALLEV_NEEDS),
    "research_plan_lines": more(
        ALLEV + """, tops AS (SELECT o.tree_id, o.focal_id, o.ancestor_id, ['# Locality research report — ' || o.focal_id || ' to ' || o.ancestor_id, '',
    'People on this line: ' || o.n || '. Research gaps: ' || g.gaps || '.', ''] AS ls FROM (SELECT tree_id, focal_id, ancestor_id, count(*) AS n FROM ol GROUP BY ALL) o
  JOIN (SELECT focal_id, ancestor_id, count(*) FILTER (status <> 'sourced') AS gaps FROM lf GROUP BY ALL) g ON g.focal_id = o.focal_id AND g.ancestor_id = o.ancestor_id)""",
        """SELECT tree_id, focal_id, ancestor_id, 0 AS section, unnest(range(0, 4)) AS item, unnest(ls) AS text FROM tops
UNION ALL SELECT tree_id, focal_id, ancestor_id, place_no, 0, '## ' || place_label || CASE WHEN is_target THEN '  ⚠ research target' ELSE '' END FROM lr
UNION ALL SELECT tree_id, focal_id, ancestor_id, place_no, facts + 1, '' FROM lr
UNION ALL SELECT f.tree_id, f.focal_id, f.ancestor_id, r.place_no, row_number() OVER (PARTITION BY f.focal_id, f.ancestor_id, f.place_key
    ORDER BY coalesce(f.year, 9007199254740991), f.person_name, f.type, f.person_id, coalesce(f.event_id, '')),
  '- ' || f.person_name || ' · ' || f.type || ' · ' || coalesce(f.date_raw, f.year::VARCHAR, '—') || ' · **' || f.status || '**'
FROM lf f JOIN lr r ON r.focal_id = f.focal_id AND r.ancestor_id = f.ancestor_id AND r.place_key = f.place_key""", *ALLEV_NEEDS),
    "checklist_links": more(LINKS, "SELECT tree_id, focal_id, ancestor_id, link_key, generation, link_no FROM lk", "anc", "lines"),
    "checklist_reach": build(
        """SELECT l.tree_id, l.focal_id, l.ancestor_id, max(a.n) IS NOT NULL AS reachable FROM lines l
  LEFT JOIN anc a ON a.focal_id = l.focal_id AND a.ancestor_id = l.ancestor_id GROUP BY ALL""", "anc", "lines"),
    "checklist_items": more(LINKS, "SELECT * FROM evl", "anc", "lines"),
    "checklist_summary": more(LINKS, TOTALS + " FROM evl GROUP BY ALL", "anc", "lines"),
    "society_checklists": by_society("SELECT * FROM evl"),
    "society_totals": by_society(TOTALS + " FROM evl GROUP BY ALL"),
    "record_copy_spans": more(
        LINKS,
        """SELECT a.tree_id, a.focal_id, a.ancestor_id, a.link_key AS start_key, a.generation % 3 + 1 AS generations, b.link_key FROM lk a
  JOIN lk b ON b.focal_id = a.focal_id AND b.ancestor_id = a.ancestor_id AND b.link_no >= a.link_no AND b.link_no < a.link_no + a.generation % 3 + 1
UNION ALL SELECT tree_id, focal_id, ancestor_id, 'service', 2, 'service' FROM lines""", "anc", "lines"),
}
