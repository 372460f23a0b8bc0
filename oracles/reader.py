"""SQL twins of ``queries_reader``; the expected words and types are written out here."""

from __future__ import annotations

_P = """WITH p AS (SELECT c_custkey::BIGINT AS k, (c_custkey // 64)::BIGINT AS t, 'T' || (c_custkey // 64) AS tree_id, '@I' || c_custkey || '@' AS me FROM customer),
trees AS (SELECT t, tree_id FROM p GROUP BY ALL)
"""

ORACLES = {
    "reader_notes": _P + """
SELECT tree_id, 'info' AS severity, 'Individual ' || me || ' has no NAME record.' AS message, me AS context FROM p WHERE k % 10 = 1
UNION ALL SELECT tree_id, 'info', 'Individual ' || me || ' has multiple FAMC pointers; using the first.', me FROM p WHERE k % 10 = 2
UNION ALL SELECT tree_id, 'warning', 'Individual ' || me || ' references a missing family @NOT' || k || '@ (FAMS).', '@NOT' || k || '@' FROM p WHERE k % 10 = 3
UNION ALL SELECT tree_id, 'info', 'Vendor-specific tag _VEND on ' || me || ' was not mapped.', me FROM p WHERE k % 10 = 4
UNION ALL SELECT tree_id, 'info', 'Unrecognized tag HOBBY on ' || me || ' was ignored.', me FROM p WHERE k % 10 = 5
UNION ALL SELECT tree_id, 'warning', 'Individual ' || me || ' references a missing family @GONE' || k || '@ (FAMC).', '@GONE' || k || '@' FROM p WHERE k % 10 = 8
UNION ALL SELECT tree_id, 'warning', 'Family @F' || t || '@ references a missing spouse @NOONE' || t || '@.', '@NOONE' || t || '@' FROM trees
UNION ALL SELECT tree_id, 'warning', 'Family @F' || t || '@ references a missing child @LOST' || t || '@.', '@LOST' || t || '@' FROM trees
UNION ALL SELECT tree_id, 'info', 'Unrecognized top-level record WEIRD was ignored.', '@Z' || t || '@' FROM trees
UNION ALL SELECT tree_id, 'info', 'Skipped an INDI record with no xref pointer.', NULL FROM trees
UNION ALL SELECT tree_id, 'info', 'Skipped a FAM record with no xref pointer.', NULL FROM trees""",
    "reader_event_types": _P + """
SELECT tree_id, 'I' || k || '-' || tag || '-0' AS event_id, CASE tag WHEN 'BIRT' THEN 'birth' WHEN 'DEAT' THEN 'death' WHEN 'BURI' THEN 'burial'
  WHEN 'BAPM' THEN 'baptism' WHEN 'CHR' THEN 'baptism' WHEN 'CHRA' THEN 'baptism' WHEN 'BAPL' THEN 'baptism' WHEN 'CENS' THEN 'census'
  WHEN 'RESI' THEN 'residence' WHEN 'IMMI' THEN 'immigration' WHEN 'EMIG' THEN 'emigration' WHEN 'OCCU' THEN 'occupation'
  WHEN 'MILI' THEN 'military' WHEN '_MILT' THEN 'military' ELSE 'other' END AS type, tag AS raw_tag, 1800 + k % 100 AS year,
  CASE WHEN tag = 'EVEN' THEN 'Honor' END AS description
FROM (SELECT *, ['BIRT', 'DEAT', 'BURI', 'BAPM', 'CHR', 'CHRA', 'BAPL', 'CENS', 'RESI', 'IMMI', 'EMIG', 'OCCU', 'MILI', '_MILT', 'GRAD', 'EVEN'][k % 16 + 1] AS tag FROM p)""",
}
