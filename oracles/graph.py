"""SQL twins of ``queries_graph``."""

from __future__ import annotations

import oracles.ops  # noqa: F401
from oracles.fragments import build
from oracles.text import FATHER, SON, by_sex, great, lineal, times, word

TERM = f"""CASE WHEN from_id = to_id THEN 'self' WHEN up IS NOT NULL THEN {lineal('up', FATHER)}
  WHEN down IS NOT NULL THEN {lineal('down', SON)} WHEN a IS NULL OR b IS NULL THEN 'no traceable relationship within this tree'
  WHEN a = 1 AND b = 1 THEN {by_sex('sex', 'brother', 'sister', 'sibling')}
  WHEN least(a, b) = 1 AND b < a THEN {great('(a - 2)')} || {by_sex('sex', 'uncle', 'aunt', 'aunt or uncle')}
  WHEN least(a, b) = 1 THEN {great('(b - 2)')} || {by_sex('sex', 'nephew', 'niece', 'niece or nephew')}
  WHEN a = b THEN {word('(least(a, b) - 1)')} || ' cousin'
  ELSE {word('(least(a, b) - 1)')} || ' cousin ' || {times('abs(a - b)')} || ' removed' END"""

COMMON = """common AS (SELECT q.tree_id, q.from_id, q.to_id, a.person_id AS ancestor_id, a.depth AS from_depth, b.depth AS to_depth
  FROM pairs q JOIN up a ON a.focal_id = q.from_id JOIN up b ON b.focal_id = q.to_id AND b.person_id = a.person_id WHERE q.from_id <> q.to_id)"""
NEAREST = COMMON + """,
near AS (SELECT * FROM common c WHERE NOT EXISTS (SELECT 1 FROM common y JOIN up u ON u.focal_id = y.ancestor_id
  WHERE y.from_id = c.from_id AND y.to_id = c.to_id AND u.person_id = c.ancestor_id)),
legs AS (SELECT DISTINCT f, x FROM (SELECT from_id AS f, ancestor_id AS x FROM near UNION ALL SELECT to_id, ancestor_id FROM near)),
legp AS (SELECT f, x, len, row_number() OVER (PARTITION BY f, x ORDER BY pkey) AS rn FROM (
  SELECT l.f, l.x, a.len + b.len AS len, list_concat(a.ukey, b.dkey) AS pkey FROM legs l JOIN trails a ON a.focal_id = l.f
  JOIN trails b ON b.focal_id = l.x AND b.tip = a.tip WHERE len(list_intersect(a.steps, b.steps)) = 1)),
dist AS (SELECT f, x, min(len)::BIGINT AS d FROM legp GROUP BY ALL),
nca AS (SELECT n.tree_id, n.from_id, n.to_id, n.ancestor_id, p.d AS gen_from, q.d AS gen_to FROM near n
  LEFT JOIN dist p ON p.f = n.from_id AND p.x = n.ancestor_id LEFT JOIN dist q ON q.f = n.to_id AND q.x = n.ancestor_id)"""


def more(ctes: str, final: str, *needs: str) -> str:
    return build("@@", *needs).rsplit("\n@@", 1)[0] + ",\n" + ctes + "\n" + final


def ego(up: int, down: int, budget: int | None, name: str = "ego") -> str:
    """Members of the views of every person."""
    return f"""gb AS (SELECT tree_id, person_id AS focal_id, person_id, 0::BIGINT AS g, 0 AS ph, 0 AS d, [0::BIGINT][:0] AS kk FROM p0
  UNION ALL SELECT tree_id, focal_id, person_id, depth, 1, depth, wkey FROM walk WHERE depth <= {up}
  UNION ALL SELECT tree_id, person_id, focal_id, -depth, 2, depth, dk FROM dwalk WHERE depth <= {down}),
gs AS (SELECT b.tree_id, b.focal_id, s.spouse_id AS person_id, min_by(b.g, (b.ph, b.d, b.kk)) AS g FROM gb b JOIN sp s ON s.person_id = b.person_id
  WHERE NOT EXISTS (SELECT 1 FROM gb o WHERE o.focal_id = b.focal_id AND o.person_id = s.spouse_id) GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY focal_id ORDER BY person_id <> focal_id, so, CASE WHEN so THEN 0 ELSE abs(g) END, person_id) AS rn
  FROM (SELECT tree_id, focal_id, person_id, g, false AS so FROM gb UNION ALL SELECT tree_id, focal_id, person_id, g, true FROM gs)),
{name} AS (SELECT tree_id, focal_id, person_id, g FROM gr WHERE {f'rn <= {budget}' if budget else 'true'})"""


# Breadth-first keys going down: (fseq, cord) per step, smallest among shortest walks.
DWALK = """dwalk AS (SELECT tree_id, focal_id, person_id, depth, min(dk) AS dk FROM (
  SELECT tree_id, focal_id, tip AS person_id, len AS depth, dkey AS dk, min(len) OVER (PARTITION BY focal_id, tip) AS ml FROM trails WHERE len > 0)
  WHERE depth = ml GROUP BY ALL)"""


def flags(nodes: str, around: str) -> str:
    return f"""SELECT n.tree_id, n.focal_id, n.person_id, n.g AS generation, n.person_id = n.focal_id AS is_focal,
  c.ancestor_id IS NOT NULL AS is_collapse, o.person_id IS NOT NULL AS has_unexpanded FROM {nodes} n
  LEFT JOIN coll c ON c.focal_id = n.focal_id AND c.ancestor_id = n.person_id
  LEFT JOIN (SELECT DISTINCT m.focal_id, m.person_id FROM {nodes} m JOIN nb x ON x.person_id = m.person_id
    LEFT JOIN {around} i ON i.focal_id = m.focal_id AND i.person_id = x.neighbour_id WHERE i.person_id IS NULL) o
  ON o.focal_id = n.focal_id AND o.person_id = n.person_id"""


def induced(nodes: str) -> str:
    return f"""SELECT a.tree_id, a.focal_id, e.type, e.from_id, e.to_id, e.family_id FROM {nodes} a JOIN edges e ON e.from_id = a.person_id
  JOIN {nodes} b ON b.focal_id = a.focal_id AND b.person_id = e.to_id"""


EXPAND = """hops AS (SELECT child_id AS a, parent_id AS person_id, 0 AS kind FROM po UNION ALL SELECT parent_id, child_id, 1 FROM po
  UNION ALL SELECT person_id, spouse_id, 2 FROM sp),
added AS (SELECT p.tree_id, p.person_id AS focal_id, h.person_id, min_by(CASE kind WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END, kind)::BIGINT AS g
  FROM p0 p JOIN hops h ON h.a = p.person_id WHERE NOT EXISTS (SELECT 1 FROM ego e WHERE e.focal_id = p.person_id AND e.person_id = h.person_id) GROUP BY ALL),
after AS (SELECT focal_id, person_id, tree_id FROM ego UNION ALL SELECT focal_id, person_id, tree_id FROM added)"""

SIBS = """sibs AS (SELECT a.child_id AS person_id, b.child_id AS sibling_id, min((a.f, a.pord, b.f, b.cord)) AS ok
  FROM po a JOIN po b ON a.parent_id = b.parent_id AND a.child_id <> b.child_id GROUP BY ALL)"""


def sibling_view(budget: int) -> str:
    return SIBS + f""",
ext AS (SELECT e.tree_id, e.focal_id, s.sibling_id, min((e.person_id <> e.focal_id, -e.g, e.person_id, s.ok)) AS o FROM ego e
  JOIN sibs s ON s.person_id = e.person_id WHERE NOT EXISTS (SELECT 1 FROM ego x WHERE x.focal_id = e.focal_id AND x.person_id = s.sibling_id) GROUP BY ALL),
sv AS (SELECT tree_id, focal_id, person_id FROM ego UNION ALL SELECT x.tree_id, x.focal_id, x.sibling_id FROM (
  SELECT *, row_number() OVER (PARTITION BY focal_id ORDER BY o) AS rn FROM ext) x
  JOIN (SELECT focal_id, {budget} - count(*) AS room FROM ego GROUP BY ALL) r ON r.focal_id = x.focal_id AND rn <= room)"""


EGO_NEEDS = ("walk", "trails", "sp", "p0", "po", "nb", "edges", "coll")

ORACLES = {
    "pedigree_collapse": build(
        "SELECT tree_id, focal_id, ancestor_id, paths AS path_count, depth AS min_length FROM coll", "coll"),
    "collapse_paths": build(
        """SELECT tree_id, focal_id, tip AS ancestor_id, rn AS path_no, len AS length, array_to_string(steps, '>') AS steps, n AS path_count FROM (SELECT *, row_number() OVER (PARTITION BY focal_id, tip ORDER BY ukey) AS rn,
  count(*) OVER (PARTITION BY focal_id, tip) AS n FROM trails WHERE len > 0) WHERE n > 1""", "trails"),
    "collapse_report": build(
        f"""SELECT r.tree_id, r.focal_id, tip AS ancestor_id, rn AS path_no, p.name || ' — reached ' || n || ' ways' AS heading,
  'your ' || {lineal('len', FATHER.replace('CASE sex', 'CASE p.sex'))} || ' via ' || v.name || '’s line' AS line
FROM (SELECT *, row_number() OVER (PARTITION BY focal_id, tip ORDER BY ukey) AS rn, count(*) OVER (PARTITION BY focal_id, tip) AS n
  FROM trails WHERE len > 0) r JOIN person p ON p.person_id = r.tip JOIN person v ON v.person_id = r.steps[2] WHERE n > 1""",
        "trails", "person"),
    "graph_edges": build("SELECT * FROM edges", "edges"),
    "adjacency_order": build(
        """SELECT tree_id, 'parent' AS kind, child_id AS person_id, parent_id AS other_id, row_number() OVER (PARTITION BY child_id ORDER BY f, pord, cord) AS position FROM po
UNION ALL SELECT tree_id, 'child', parent_id, child_id, row_number() OVER (PARTITION BY parent_id ORDER BY f, pord, cord) FROM po
UNION ALL SELECT tree_id, 'spouse', person_id, spouse_id, row_number() OVER (PARTITION BY person_id ORDER BY f, least(sord, oord), greatest(sord, oord)) FROM sp""",
        "po", "sp"),
    "ancestor_closure": build("SELECT tree_id, focal_id, person_id, depth AS min_depth FROM up", "up"),
    "ancestors_two_generations": build("SELECT tree_id, focal_id, person_id, depth AS min_depth FROM up WHERE depth <= 2", "up"),
    "descendant_closure": build("SELECT tree_id, person_id AS focal_id, focal_id AS person_id, depth AS min_depth FROM up", "up"),
    "focal_generations": build(
        """SELECT tree_id, focal_id, person_id, depth AS generation FROM up0 UNION ALL SELECT tree_id, person_id, focal_id, -depth FROM up""", "up", "up0"),
    "siblings": build(
        """SELECT DISTINCT a.tree_id, a.child_id AS person_id, b.child_id AS sibling_id FROM po a JOIN po b ON a.parent_id = b.parent_id
  AND a.child_id <> b.child_id""", "po"),
    "neighbours": build("SELECT * FROM nb", "nb"),
    "degrees_and_leaves": build(
        """SELECT p.tree_id, p.person_id, (SELECT count(*) FROM po WHERE child_id = p.person_id) + (SELECT count(*) FROM po WHERE parent_id = p.person_id)
  + (SELECT count(*) FROM sp WHERE sp.person_id = p.person_id) AS degree, NOT EXISTS (SELECT 1 FROM po WHERE parent_id = p.person_id) AS is_leaf FROM p0 p""",
        "po", "sp", "p0"),
    "maintained_closure": more(
        """nl AS MATERIALIZED (SELECT tree_id, parent_id, child_id FROM po WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.kind = 'unlinkRelationship' AND o.relation = 'parent-child'
    AND o.tree_id = po.tree_id AND o.family_id = po.family_id AND o.me = po.child_id)
  UNION SELECT tree_id, me, you FROM ops WHERE kind = 'linkRelationship' AND relation = 'parent-child' AND me <> you
    AND me IN (SELECT person_id FROM p0) AND you IN (SELECT person_id FROM p0)),
dist(tree_id, focal_id, person_id, d) USING KEY (tree_id, focal_id, person_id) AS (SELECT tree_id, person_id, person_id, 0::BIGINT FROM p0 UNION
  SELECT r.tree_id, r.focal_id, n.parent_id, r.d + 1 FROM dist r JOIN nl n ON n.tree_id = r.tree_id AND n.child_id = r.person_id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.dist x WHERE x.tree_id = r.tree_id AND x.focal_id = r.focal_id AND x.person_id = n.parent_id))""",
        "SELECT tree_id, focal_id, person_id, d AS min_depth FROM dist WHERE focal_id <> person_id", "po", "p0", "ops"),
    "looped_path_counts": more(
        """bl AS MATERIALIZED (SELECT tree_id, parent_id, child_id FROM po UNION SELECT 'T' || (a // 64), 'I' || (a // 64 * 64 + (a % 64 + 8 + s % 10) % 64), 'I' || a
    FROM (SELECT s_suppkey AS s, s_suppkey * 15 AS a FROM supplier)),
lt AS (SELECT tree_id, person_id AS focal_id, person_id AS tip, 0::BIGINT AS len, [person_id] AS steps FROM p0 UNION ALL
  SELECT r.tree_id, r.focal_id, n.parent_id, r.len + 1, list_append(r.steps, n.parent_id) FROM lt r JOIN bl n ON n.tree_id = r.tree_id AND n.child_id = r.tip
  WHERE NOT list_contains(r.steps, n.parent_id))""",
        "SELECT tree_id, focal_id, tip AS ancestor_id, len AS depth, count(*) AS paths FROM lt WHERE len > 0 GROUP BY ALL", "po", "p0"),
    "path_counts": build("SELECT tree_id, focal_id, person_id AS ancestor_id, paths FROM up", "up"),
    "ancestral_paths": build(
        """SELECT tree_id, focal_id, ancestor_id, path_no, length, array_to_string(steps, '>') AS steps, n AS path_count FROM anc""", "anc"),
    "relationship_paths": build(
        """SELECT tree_id, from_id, to_id, path_no, length, array_to_string(steps, '>') AS steps, n AS path_count FROM lam""", "lam"),
    "first_relationship_paths": build(
        """SELECT tree_id, from_id, to_id, path_no, length, array_to_string(steps, '>') AS steps, n AS path_count FROM lam WHERE path_no <= 2""", "lam"),
    "path_listing": build(
        """SELECT tree_id, from_id, to_id, path_no, '#' || path_no || ' (' || length || ' step' || CASE WHEN length = 1 THEN '' ELSE 's' END || '): ' || names AS listing
FROM (SELECT l.tree_id, l.from_id, l.to_id, l.path_no, l.length, string_agg(p.name, ' → ' ORDER BY l.i) AS names FROM (
  SELECT *, unnest(range(1, len(steps) + 1)) AS i, unnest(steps) AS x FROM lam) l JOIN person p ON p.person_id = l.x GROUP BY ALL)""", "lam", "person"),
    "highlighted_people": build("SELECT DISTINCT tree_id, from_id, to_id, unnest(steps) AS person_id FROM lam", "lam"),
    "highlighted_edges": build(
        """SELECT DISTINCT tree_id, from_id, to_id, 'parentOf:' || x || '->' || y AS edge_key FROM (
  SELECT tree_id, from_id, to_id, unnest(steps[:-2]) AS x, unnest(steps[2:]) AS y FROM lam UNION ALL
  SELECT tree_id, from_id, to_id, unnest(steps[2:]) AS x, unnest(steps[:-2]) AS y FROM lam)""", "lam"),
    "common_ancestors": more(COMMON, "SELECT * FROM common", "up", "pairs"),
    "nearest_common_ancestors": more(NEAREST, "SELECT * FROM nca", "up", "pairs", "trails"),
    "relationship_terms": more(
        NEAREST,
        f"""SELECT tree_id, from_id, to_id, {TERM} AS term FROM (SELECT q.tree_id, q.from_id, q.to_id, u.depth AS up, d.depth AS down, n.gen_from AS a, n.gen_to AS b,
  coalesce(p.sex, 'unknown') AS sex FROM pairs q LEFT JOIN up u ON u.focal_id = q.from_id AND u.person_id = q.to_id
  LEFT JOIN up d ON d.focal_id = q.to_id AND d.person_id = q.from_id LEFT JOIN person p ON p.person_id = q.to_id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY gen_from + gen_to NULLS LAST, ancestor_id) AS rn FROM nca) n
    ON n.from_id = q.from_id AND n.to_id = q.to_id AND n.rn = 1)""", "up", "pairs", "trails", "person"),
    "loop_closing_links": build(
        """SELECT q.tree_id, from_id AS parent_id, to_id AS child_id FROM pairs q JOIN up u ON u.focal_id = q.from_id AND u.person_id = q.to_id""", "pairs", "up"),
    "parent_child_family": build(
        """SELECT a.tree_id, a.parent_id, a.child_id, p.family_id FROM (SELECT DISTINCT s.tree_id, s.person_id AS parent_id, c.person_id AS child_id
  FROM fs s JOIN fc c ON s.family_id = c.family_id) a LEFT JOIN po p ON p.parent_id = a.parent_id AND p.child_id = a.child_id""", "fs", "fc", "po"),
    "spouse_family": build(
        """SELECT a.tree_id, a.a_id, a.b_id, s.family_id FROM (SELECT tree_id, from_id AS a_id, to_id AS b_id FROM pairs UNION SELECT tree_id, b_id, a_id FROM so) a
  LEFT JOIN so s ON s.a_id = least(a.a_id, a.b_id) AND s.b_id = greatest(a.a_id, a.b_id)""", "pairs", "so"),
    "co_parents": build(
        """SELECT a.tree_id, a.family_id, a.person_id AS parent_id, b.person_id AS co_parent_id FROM fs a JOIN fs b ON a.family_id = b.family_id
  AND a.person_id <> b.person_id""", "fs"),
    "ego_nodes": more(DWALK + "," + ego(4, 0, None), flags("ego", "ego"), *EGO_NEEDS),
    "ego_edges": more(DWALK + "," + ego(4, 0, None), induced("ego"), *EGO_NEEDS),
    "ego_budget": more(DWALK + "," + ego(3, 2, 12), "SELECT tree_id, focal_id, person_id, g AS generation FROM ego", *EGO_NEEDS),
    "blood_edges": more(DWALK + "," + ego(2, 1, None), f"SELECT * FROM ({induced('ego')}) WHERE type <> 'spouseOf'", *EGO_NEEDS),
    "expanded_nodes": more(DWALK + "," + ego(1, 0, None) + "," + EXPAND, flags("added", "after"), *EGO_NEEDS),
    "expanded_edges": more(
        DWALK + "," + ego(1, 0, None) + "," + EXPAND,
        f"""SELECT i.* FROM ({induced('after')}) i WHERE EXISTS (SELECT 1 FROM added d WHERE d.focal_id = i.focal_id AND d.person_id IN (i.from_id, i.to_id))""",
        *EGO_NEEDS),
    "sibling_view": more(DWALK + "," + ego(2, 0, None) + "," + sibling_view(20), "SELECT * FROM sv", *EGO_NEEDS),
    "induced_view": more(
        DWALK + "," + ego(2, 1, None) + "," + sibling_view(2**40)
        + """, gg AS (SELECT focal_id, person_id, depth AS g FROM up0 UNION ALL SELECT person_id, focal_id, -depth FROM up),
vn AS (SELECT sv.tree_id, sv.focal_id, sv.person_id, gg.g FROM sv LEFT JOIN gg ON gg.focal_id = sv.focal_id AND gg.person_id = sv.person_id)""",
        flags("vn", "sv"), *EGO_NEEDS, "up", "up0"),
    "default_focal": build(
        """SELECT tree_id, person_id AS focal_id FROM (SELECT p.tree_id, p.person_id, row_number() OVER (PARTITION BY p.tree_id ORDER BY p.k NOT IN (SELECT s_suppkey * 256 + s_nationkey FROM supplier), NOT leaf,
  CASE WHEN leaf AND ly IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN leaf THEN -coalesce(ly, 0) ELSE 0 END, CASE WHEN leaf THEN 0 ELSE -deg END, p.person_id) AS rn
FROM (SELECT p.*, (SELECT count(*) FROM nb WHERE nb.person_id = p.person_id) AS deg, NOT EXISTS (SELECT 1 FROM po WHERE parent_id = p.person_id) AS leaf,
  (SELECT max(year) FROM ev WHERE owner_id = p.person_id) AS ly FROM p0 p) p) WHERE rn = 1""", "p0", "nb", "po", "ev"),
    "latest_years": build(
        "SELECT tree_id, owner_id AS person_id, max(year) AS latest_year FROM ev WHERE owner_id IS NOT NULL AND year IS NOT NULL GROUP BY ALL", "ev"),
    "next_ids": build("SELECT tree_id, 'I' || (max(k) + 1) AS next_person, 'FU1' AS next_family FROM p0 GROUP BY ALL", "p0"),
    "ancestor_picker": build(
        """SELECT w.tree_id, w.focal_id, q.query, w.person_id, row_number() OVER (PARTITION BY w.focal_id, q.query ORDER BY w.depth, w.wkey) AS rank
FROM walk w JOIN person p ON p.person_id = w.person_id JOIN (SELECT '' AS query UNION ALL SELECT 'mach') q ON contains(lower(p.name), q.query)""", "walk", "person"),
}

