"""SQL twins of ``queries_work``."""

from __future__ import annotations

from oracles.events import gaz
import oracles.ops  # noqa: F401
from oracles.fragments import build
from oracles.graph import more
from oracles.text import LADDER

DATES = """dw AS (SELECT * FROM (
  SELECT tree_id, parent_id, child_id, 2 AS o, 'warn' AS severity, CASE WHEN pb > cb THEN p || ' was born in ' || pb || ', after ' || c || ' in ' || cb || '.' END AS message FROM full0 UNION ALL
  SELECT tree_id, parent_id, child_id, 3, 'warn', CASE WHEN pb <= cb AND cb - pb < 13 THEN p || ' would have been ' || (cb - pb) || ' at ' || c || '''s birth.' END FROM full0 UNION ALL
  SELECT tree_id, parent_id, child_id, 4, 'warn', CASE WHEN cb > pd + 1 THEN c || ' was born in ' || cb || ', after ' || p || ' died in ' || pd || '.' END FROM full0) WHERE message IS NOT NULL)"""


def full(asked: str) -> str:
    return f"""full0 AS (SELECT a.tree_id, a.parent_id, a.child_id, coalesce(x.full_name, a.parent_id) AS p, coalesce(y.full_name, a.child_id) AS c,
  vp.byr AS pb, vp.dyr AS pd, vc.byr AS cb FROM ({asked}) a JOIN person x ON x.person_id = a.parent_id JOIN person y ON y.person_id = a.child_id
  JOIN vit vp ON vp.person_id = a.parent_id JOIN vit vc ON vc.person_id = a.child_id)"""


ASKED = "SELECT tree_id, from_id AS parent_id, to_id AS child_id FROM pairs UNION SELECT tree_id, parent_id, child_id FROM po"
CHECKS = full(ASKED) + "," + DATES + """,
folk AS (SELECT p.child_id, string_agg(x.full_name, ' and ' ORDER BY p.f, p.pord) AS names FROM po p JOIN person x ON x.person_id = p.parent_id GROUP BY ALL),
blk AS (SELECT f.tree_id, f.parent_id, f.child_id, CASE WHEN f.parent_id = f.child_id THEN p || ' cannot be their own parent.'
  WHEN u.person_id IS NOT NULL THEN p || ' is already a descendant of ' || c || ', so this would make ' || c || ' their own ancestor.' END AS message
  FROM full0 f LEFT JOIN up u ON u.focal_id = f.parent_id AND u.person_id = f.child_id),
iss AS (SELECT *, 0 AS o, 'block' AS severity FROM blk WHERE message IS NOT NULL UNION ALL
  SELECT w.tree_id, w.parent_id, w.child_id, w.message, w.o, w.severity FROM (
    SELECT tree_id, parent_id, child_id, o, severity, message FROM dw UNION ALL
    SELECT f.tree_id, f.parent_id, f.child_id, 1, 'warn', CASE WHEN k.parent_id IS NOT NULL THEN p || ' is already recorded as a parent of ' || c || '.'
      WHEN g.names IS NOT NULL THEN c || ' already has recorded parents (' || g.names || '). This family will be the one exported as their parentage.' END
    FROM full0 f LEFT JOIN po k ON k.parent_id = f.parent_id AND k.child_id = f.child_id LEFT JOIN folk g ON g.child_id = f.child_id) w
  JOIN blk b ON b.parent_id = w.parent_id AND b.child_id = w.child_id AND b.message IS NULL WHERE w.message IS NOT NULL)"""

COUNTS = """JOIN fam f USING (family_id) LEFT JOIN (SELECT family_id, count(*) AS n FROM fs GROUP BY ALL) s USING (family_id)
  LEFT JOIN (SELECT family_id, count(*) AS n FROM fc GROUP BY ALL) c USING (family_id)"""

SRC = """src AS (SELECT normalized AS id, min((raw, parts))[1] AS raw, min((raw, parts))[2] AS parts, normalized AS place_key FROM (
  SELECT place_key AS normalized, place_raw AS raw, parts FROM ev WHERE place_key IS NOT NULL AND place_key <> '') GROUP BY ALL)"""


def hit(provider: str, confidence: str) -> str:
    return f"""(SELECT id AS place_key, min_by(lat, rung) AS lat, min_by(lon, rung) AS lon, '{provider}' AS source, min_by({confidence}, rung)::DOUBLE AS confidence,
  arg_min_null(resolved_name, rung) AS resolved_name FROM ladder JOIN gaz ON gaz.query = lower(ladder.query) AND gaz.provider = '{provider}' GROUP BY ALL)"""


CONF = "CASE WHEN importance BETWEEN 0 AND 1 THEN importance ELSE 0.5 END"
GEO = f""" zs AS (SELECT s.place_key, g.lat, g.lon, 'manual' AS source, coalesce(g.importance, 1.0)::DOUBLE AS confidence, coalesce(g.resolved_name, s.raw) AS resolved_name
  FROM src s JOIN gaz g ON g.query = s.place_key AND g.provider = 'manual'),
 zn AS {hit('nominatim', CONF)}, zp AS {hit('photon', '0.45')}"""


def places(final: str) -> str:
    return more(SRC + "," + LADDER + "," + gaz() + "," + GEO, final, "ev")


NEW = """SELECT * FROM zn WHERE place_key NOT IN (SELECT place_key FROM zs) UNION ALL
  SELECT * FROM zp WHERE place_key NOT IN (SELECT place_key FROM zs) AND place_key NOT IN (SELECT place_key FROM zn)"""

ORACLES = {
    "parent_child_checks": more(
        CHECKS,
        """SELECT tree_id, parent_id, child_id, row_number() OVER (PARTITION BY parent_id, child_id ORDER BY o) - 1 AS issue_no, severity, message FROM iss""",
        "pairs", "po", "person", "vit", "up"),
    "spouse_checks": more(
        """asked AS (SELECT tree_id, from_id AS a_id, to_id AS b_id FROM pairs UNION SELECT tree_id, a_id, b_id FROM so UNION SELECT tree_id, parent_id, child_id FROM po),
fl AS (SELECT q.*, coalesce(x.full_name, q.a_id) AS a, coalesce(y.full_name, q.b_id) AS b, EXISTS (SELECT 1 FROM sp WHERE sp.person_id = q.a_id AND sp.spouse_id = q.b_id) AS wed,
  EXISTS (SELECT 1 FROM po WHERE (po.parent_id = q.a_id AND po.child_id = q.b_id) OR (po.parent_id = q.b_id AND po.child_id = q.a_id)) AS blood
  FROM asked q JOIN person x ON x.person_id = q.a_id JOIN person y ON y.person_id = q.b_id)""",
        """SELECT tree_id, a_id, b_id, row_number() OVER (PARTITION BY a_id, b_id ORDER BY o) - 1 AS issue_no, severity, message FROM (
  SELECT tree_id, a_id, b_id, 0 AS o, 'block' AS severity, a || ' cannot be married to themselves.' AS message FROM fl WHERE a_id = b_id
  UNION ALL SELECT tree_id, a_id, b_id, 1, 'warn', a || ' and ' || b || ' are already recorded as spouses.' FROM fl WHERE a_id <> b_id AND wed
  UNION ALL SELECT tree_id, a_id, b_id, 2, 'warn', a || ' and ' || b || ' are already recorded as parent and child.' FROM fl WHERE a_id <> b_id AND blood)""",
        "pairs", "so", "po", "sp", "person"),
    "link_audit": more(
        full("SELECT tree_id, parent_id, child_id FROM po") + "," + DATES,
        "SELECT tree_id, parent_id, child_id, row_number() OVER (PARTITION BY parent_id, child_id ORDER BY o) - 1 AS issue_no, severity, message FROM dw",
        "po", "person", "vit"),
    "families_for_child": build(
        f"SELECT m.tree_id, m.person_id, family_id, s.n AS spouses, coalesce(c.n, 0) AS children FROM fs m {COUNTS}", "fs", "fc", "fam"),
    "families_for_parent": build(
        f"SELECT m.tree_id, m.person_id, family_id, coalesce(s.n, 0) AS spouses, c.n AS children FROM fc m JOIN p0 USING (person_id) {COUNTS}",
        "fs", "fc", "fam", "p0"),
    "families_for_spouse": build(
        f"SELECT m.tree_id, m.person_id, family_id, s.n AS spouses, coalesce(c.n, 0) AS children FROM fs m {COUNTS} WHERE s.n < 2", "fs", "fc", "fam"),
    "families_for_spouse_after_unlinks": more(
        """fs2 AS (SELECT * FROM fs WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.kind = 'unlinkRelationship' AND o.relation = 'spouse' AND o.tree_id = fs.tree_id
  AND o.family_id = fs.family_id AND o.me = fs.person_id))""",
        f"SELECT m.tree_id, m.person_id, family_id, s.n AS spouses, coalesce(c.n, 0) AS children FROM fs2 m {COUNTS.replace('FROM fs ', 'FROM fs2 ')} WHERE s.n < 2",
        "fs", "fc", "fam", "ops"),
    "unlink_parent_impact": build(
        """SELECT p.tree_id, p.parent_id, p.child_id, p.family_id, 'Remove ' || x.name || ' as a parent of ' || y.name || '?' || coalesce(' This also removes ' ||
  (SELECT string_agg(z.name, ' and ' ORDER BY s.ord) FROM fs s JOIN person z ON z.person_id = s.person_id WHERE s.family_id = p.family_id AND s.person_id <> p.parent_id)
  || ', because GEDCOM records them as one couple.', '') AS consequence
FROM po p JOIN person x ON x.person_id = p.parent_id JOIN person y ON y.person_id = p.child_id""", "po", "fs", "person"),
    "unlink_spouse_impact": build(
        """SELECT q.tree_id, q.person_id, q.spouse_id AS row_id, q.family_id, 'Remove ' || y.name || ' as a spouse of ' || x.name || '?' || CASE WHEN c.n IS NULL THEN '' ELSE
  ' They also stop being recorded as a parent of ' || CASE WHEN c.n = 1 THEN 'their child' ELSE 'their ' || c.n || ' children' END ||
  ', because GEDCOM stores the marriage and the children as one family.' END AS consequence
FROM sp q JOIN person x ON x.person_id = q.person_id JOIN person y ON y.person_id = q.spouse_id
LEFT JOIN (SELECT family_id, count(*) AS n FROM fc GROUP BY ALL) c ON c.family_id = q.family_id""", "sp", "fc", "person"),
    "distinct_places": more(SRC, "SELECT place_key, raw FROM src", "ev"),
    "static_place_lookup": places("SELECT * FROM zs"),
    "ladder_place_lookup": places("SELECT * FROM zn"),
    "resolved_places": places("SELECT * FROM zs UNION ALL " + NEW),
    "resolved_without_first_provider": places(
        "SELECT * FROM zs UNION ALL SELECT * FROM zp WHERE place_key NOT IN (SELECT place_key FROM zs)"),
    "place_cache_additions": places(f"SELECT place_key, lat, lon, confidence, resolved_name FROM ({NEW})"),
    "places_to_resolve": places("SELECT place_key FROM src WHERE place_key NOT IN (SELECT query FROM gaz WHERE provider = 'manual')"),
}
