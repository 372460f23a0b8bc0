"""The edit log as an SQL fragment."""

from __future__ import annotations

from oracles.fragments import frag, spell

HOME = "(t * 32 + (layer - 1) * 4 + (pos * 3 + layer) % 4)"
frag("ops", [], f"""SELECT *, CASE kind WHEN 'addPerson' THEN CASE WHEN n % 7 = 0 THEN me ELSE 'N' || n END WHEN 'editPerson' THEN me END AS person_id,
    CASE WHEN kind = 'addPerson' OR (kind = 'editPerson' AND n % 2 = 0) THEN 'Given ' || n || ' /Edit/' END AS name_raw,
    CASE WHEN kind = 'addPerson' THEN CASE WHEN n % 2 = 0 THEN 'male' ELSE 'unknown' END WHEN kind = 'editPerson' AND n % 3 = 0 THEN 'female' END AS sex,
    CASE WHEN kind = 'editPerson' AND n % 10 = 5 THEN '' WHEN kind IN ('addPerson', 'editPerson') AND n % 5 = 0 THEN 'edit ' || n END AS note,
    CASE kind WHEN 'addEvent' THEN 'U' || n WHEN 'editEvent' THEN me || '-BIRT-0' END AS event_id,
    CASE WHEN kind = 'addEvent' THEN CASE WHEN n % 2 = 0 THEN 'residence' ELSE 'census' END WHEN kind = 'editEvent' AND n % 2 = 0 THEN 'baptism' END AS event_type,
    CASE WHEN kind IN ('addEvent', 'editEvent') AND n % 5 <> 0 THEN 'ABT ' || (1800 + n % 100) END AS date_raw,
    CASE WHEN kind IN ('addEvent', 'editEvent') AND n % 7 <> 0 THEN {spell('n', 'n')} END AS place_raw,
    CASE WHEN kind IN ('addEvent', 'editEvent') AND n % 4 <> 0 THEN 'text ' || n END AS description,
    CASE WHEN kind = 'addEvent' AND n % 11 = 0 THEN 'F' || {HOME} WHEN kind = 'linkRelationship' AND relation = 'spouse' THEN 'FU' || n
      WHEN kind = 'linkRelationship' THEN 'F' || {HOME} WHEN kind = 'unlinkRelationship' AND relation = 'spouse' THEN 'F' || (t * 32 + pos // 2)
      WHEN kind = 'unlinkRelationship' THEN 'F' || {HOME} END AS family_id FROM (
  SELECT *, CASE WHEN kind = 'linkRelationship' THEN CASE WHEN n % 2 = 0 THEN 'spouse' ELSE 'parent-child' END
      WHEN kind = 'unlinkRelationship' THEN CASE WHEN layer = 0 THEN 'spouse' ELSE 'parent-child' END END AS relation FROM (
  SELECT event_id AS n, k, t, 'T' || t AS tree_id, 'I' || k AS me, 'I' || (t * 64 + (k * 5 + event_id) % 64) AS you, k % 64 // 8 AS layer, k % 8 AS pos,
    CASE event_type WHEN 'signup' THEN 'addPerson' WHEN 'click' THEN 'editPerson' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'editEvent' ELSE 'addEvent' END
      WHEN 'purchase' THEN 'linkRelationship' ELSE CASE WHEN event_id % 2 = 0 THEN 'unlinkRelationship' ELSE 'merge' END END AS kind
  FROM (SELECT *, event_id * 3 // 20 AS k, event_id * 3 // 20 // 64 AS t FROM events)))""")
