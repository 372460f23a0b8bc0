"""SQL twins of ``queries_edits``; full logs with merges have none, tests replay those one by one."""

from __future__ import annotations

from kinloom.operators.edits import DEFAULT_TAGS
import oracles.ops  # noqa: F401
from oracles.fragments import build, squash
from oracles.graph import more

TAG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEFAULT_TAGS.items()) + " END"
FULL = squash("replace(name_raw, '/', ' ')")
KEY = "lower(array_to_string(list_filter(list_transform(string_split({0}, ','), lambda c: " + squash("c") + "), lambda c: c <> ''), ', '))"

# People as the base has them: joined names and notes.
BASE = """bp AS (SELECT a.tree_id, a.person_id, string_agg(n."full", '|' ORDER BY n.pos0) AS names, any_value(a.sex) AS sex,
  any_value(CASE WHEN a.k % 5 = 0 THEN 'note ' || a.k ELSE '' END) AS notes FROM praw a JOIN pname n ON n.person_id = a.person_id GROUP BY ALL)"""

MEMBERS = """bm AS (SELECT tree_id, family_id, person_id, 'spouse' AS role FROM fs UNION ALL SELECT tree_id, family_id, person_id, 'child' FROM fc
  UNION ALL SELECT tree_id, family_id, person_id, 'record' FROM fs)"""
LINKED = MEMBERS + """,
lx AS (SELECT o.tree_id, o.n, o.family_id, o.me AS person_id, CASE WHEN o.relation = 'spouse' THEN 's' ELSE 'p' END AS r FROM ops o WHERE kind = 'linkRelationship'
  UNION ALL SELECT o.tree_id, o.n, o.family_id, o.you, CASE WHEN o.relation = 'spouse' THEN 's' ELSE 'c' END FROM ops o WHERE kind = 'linkRelationship'),
ly AS (SELECT lx.* FROM lx JOIN p0 USING (person_id)),
ptr AS (SELECT tree_id, person_id, family_id, -1 AS n FROM fc JOIN p0 USING (tree_id, person_id) UNION ALL SELECT tree_id, person_id, family_id, n FROM ly WHERE r = 'c')"""

GED_EV = """gev AS (SELECT tree_id, coalesce(owner_id, family_id) || '-' || tag || '-' || (row_number() OVER (PARTITION BY coalesce(owner_id, family_id), tag ORDER BY ord) - 1) AS event_id,
  type, tag AS raw_tag, date_raw, year, place_raw, nullif(description, '') AS description, cited, owner_id, family_id, ord FROM (
  SELECT *, CASE type WHEN 'birth' THEN 'BIRT' WHEN 'death' THEN 'DEAT' WHEN 'marriage' THEN 'MARR' WHEN 'residence' THEN 'RESI' ELSE 'MILI' END AS tag FROM ev))"""

TEXT = GED_EV + """,
evl AS (SELECT tree_id, owner_id, family_id, unnest(list_filter(['1 ' || raw_tag || coalesce(' ' || description, ''), '2 DATE ' || nullif(date_raw, ''),
    '2 PLAC' || CASE WHEN trim(nullif(place_raw, '')) = '' THEN '' ELSE ' ' || trim(nullif(place_raw, '')) END,
    CASE WHEN cited THEN '2 SOUR @S1@' END, CASE WHEN cited THEN '3 PAGE p. 2' END], lambda x: x IS NOT NULL)) AS text FROM gev),
pl AS (SELECT tree_id, k AS seq, unnest(list_filter(['0 @' || person_id || '@ INDI', '1 NAME' || CASE WHEN trim(raw1) = '' THEN '' ELSE ' ' || trim(raw1) END,
    '1 NAME ' || raw2, CASE sex WHEN 'male' THEN '1 SEX M' WHEN 'female' THEN '1 SEX F' END, CASE WHEN k % 5 = 0 THEN '1 NOTE note ' || k END,
    CASE WHEN k % 4 = 0 THEN '1 SOUR @S1@' END, CASE WHEN k % 4 = 0 THEN '2 PAGE p. 1' END], lambda x: x IS NOT NULL)) AS text FROM praw),
fl AS (SELECT s.tree_id, s.f AS seq, CASE a.sex WHEN 'female' THEN '1 WIFE @' WHEN 'male' THEN '1 HUSB @' ELSE
    CASE WHEN EXISTS (SELECT 1 FROM fs o JOIN praw q ON q.person_id = o.person_id WHERE o.family_id = s.family_id AND o.ord < s.ord AND q.sex <> 'female')
    THEN '1 WIFE @' ELSE '1 HUSB @' END END || s.person_id || '@' AS text FROM fs s JOIN praw a ON a.person_id = s.person_id)"""


def doc(col: str = "doc_id") -> str:
    n = col
    return f"""up AS (SELECT {n} AS seq, 'doc' || {n} || '.' || (['PDF','jpg','jpeg','png','txt'])[{n} % 5 + 1] AS original_name,
  CASE {n} % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE CASE {n} % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg'
    WHEN 3 THEN 'image/png' END END AS mimetype, octet_length(encode(text))::BIGINT AS size, sha256(text) AS hash FROM documents)"""


# Merges of each tree one after the other, with the people that are gone so far as the state.
MERGES = """mg AS (SELECT tree_id, n, me, you, row_number() OVER (PARTITION BY tree_id ORDER BY n) AS i,
  me <> you AND me IN (SELECT person_id FROM p0) AND you IN (SELECT person_id FROM p0) AS known FROM ops WHERE kind = 'merge'),
st AS (SELECT tree_id, 0::BIGINT AS i, NULL::BIGINT AS n, NULL::VARCHAR AS keep_id, NULL::VARCHAR AS id, ['']::VARCHAR[] AS gone FROM p0 GROUP BY tree_id
  UNION ALL SELECT s.tree_id, m.i, CASE WHEN ok THEN m.n END, CASE WHEN ok THEN me END, CASE WHEN ok THEN you END, CASE WHEN ok THEN list_append(gone, you) ELSE gone END
  FROM (SELECT s.*, m.i AS mi, known AND NOT list_contains(gone, me) AND NOT list_contains(gone, you) AS ok FROM st s JOIN mg m ON m.tree_id = s.tree_id AND m.i = s.i + 1) s
  JOIN mg m ON m.tree_id = s.tree_id AND m.i = s.mi),
ok AS (SELECT tree_id, person_id FROM p0 WHERE (tree_id, person_id) NOT IN (SELECT (tree_id, id) FROM st WHERE id IS NOT NULL)),
nx AS (SELECT tree_id, you AS at, max_by(me, n) AS nxt FROM mg GROUP BY ALL),
ch AS (SELECT tree_id, person_id AS id, person_id AS at, [person_id] AS seen FROM p0
  UNION ALL SELECT c.tree_id, c.id, x.nxt, list_append(c.seen, x.nxt) FROM ch c JOIN nx x ON x.tree_id = c.tree_id AND x.at = c.at
  WHERE NOT list_contains(c.seen, x.nxt) AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.tree_id = c.tree_id AND ok.person_id = c.at))"""

ORACLES = {
    "effective_merges": more(MERGES, "SELECT tree_id, id, n AS merge_seq, keep_id FROM st WHERE id IS NOT NULL", "ops", "p0"),
    "merge_survivors": more(
        MERGES,
        """SELECT c.tree_id, c.id, ok.person_id AS survivor_id FROM (SELECT tree_id, id, max_by(ch.at, len(seen)) AS spot FROM ch GROUP BY ALL) c
LEFT JOIN ok ON ok.tree_id = c.tree_id AND ok.person_id = c.spot""", "ops", "p0"),
    "op_descriptions": build(
        """SELECT o.tree_id, o.n AS seq, CASE kind WHEN 'merge' THEN 'Merged ' || coalesce(a.name, o.me) || ' ← ' || coalesce(b.name, o.you)
  WHEN 'addPerson' THEN 'Added person ' || replace(name_raw, '/', '') WHEN 'editPerson' THEN 'Edited ' || coalesce(a.name, o.me)
  WHEN 'addEvent' THEN 'Added ' || event_type || ' event' WHEN 'editEvent' THEN 'Edited an event'
  WHEN 'linkRelationship' THEN 'Linked ' || CASE WHEN relation = 'spouse' THEN 'spouses' ELSE 'parent–child' END
  ELSE 'Unlinked ' || CASE WHEN relation = 'spouse' THEN 'spouses' ELSE 'parent–child' END END AS text
FROM ops o LEFT JOIN person a ON a.person_id = o.me LEFT JOIN person b ON b.person_id = o.you""", "ops", "person"),
    "people_added": more(
        BASE,
        f"""SELECT *, false AS user_supplied FROM bp UNION ALL SELECT tree_id, person_id, {FULL}, sex, coalesce(note, ''), true FROM ops o
WHERE kind = 'addPerson' AND NOT EXISTS (SELECT 1 FROM p0 WHERE p0.person_id = o.person_id)""", "praw", "pname", "p0", "ops"),
    "people_edited": more(
        BASE + f""",
le AS (SELECT person_id, max_by({FULL}, n) FILTER (name_raw IS NOT NULL) AS nn, max_by(sex, n) FILTER (sex IS NOT NULL) AS ns,
  max_by(note, n) FILTER (note IS NOT NULL) AS no, true AS hit FROM ops WHERE kind = 'editPerson' GROUP BY ALL)""",
        """SELECT tree_id, person_id, coalesce(nn, names) AS names, coalesce(ns, sex) AS sex, coalesce(no, notes) AS notes, hit IS NOT NULL AS user_supplied
FROM bp LEFT JOIN le USING (person_id)""", "praw", "pname", "ops"),
    "events_added": build(
        f"""SELECT tree_id, owner_id AS owner, event_id, type, raw_tag, date_raw, place_key, description, false AS user_supplied FROM (
  SELECT e.tree_id, coalesce(e.owner_id, e.family_id) AS owner_id, e.event_id, e.type, r.raw_tag, e.date_raw, e.place_key, e.description FROM ev e JOIN eraw r USING (event_id))
UNION ALL SELECT o.tree_id, o.person, o.event_id, event_type, {TAG}, date_raw, {KEY.format('place_raw')}, description, true FROM (
  SELECT *, me AS person FROM ops WHERE kind = 'addEvent' AND family_id IS NULL UNION SELECT *, you FROM ops WHERE kind = 'addEvent' AND family_id IS NULL) o
  JOIN p0 ON p0.person_id = o.person
UNION ALL SELECT o.tree_id, o.family_id, o.event_id, event_type, {TAG}, date_raw, {KEY.format('place_raw')}, description, true FROM ops o JOIN fam USING (tree_id, family_id) WHERE kind = 'addEvent'""",
        "ev", "eraw", "ops", "p0", "fam"),
    "events_edited": more(
        f"""le AS (SELECT event_id, max_by({TAG}, n) FILTER (event_type IS NOT NULL) AS ntag, max_by(event_type, n) FILTER (event_type IS NOT NULL) AS nt,
  max(n) FILTER (n % 2 = 1) AS dn, max(n) FILTER (n % 4 = 0) AS pn, max(n) FILTER (n % 4 = 2) AS xn, true AS hit FROM ops WHERE kind = 'editEvent' GROUP BY ALL)""",
        f"""SELECT e.tree_id, e.event_id, coalesce(nt, e.type) AS type, coalesce(ntag, r.raw_tag) AS raw_tag, CASE WHEN dn IS NULL THEN e.date_raw ELSE d.date_raw END AS date_raw,
  CASE WHEN pn IS NULL THEN e.place_key ELSE {KEY.format('p.place_raw')} END AS place_key, CASE WHEN xn IS NULL THEN e.description ELSE x.description END AS description,
  hit IS NOT NULL AS user_supplied FROM ev e JOIN eraw r USING (event_id) LEFT JOIN le USING (event_id) LEFT JOIN ops d ON d.n = dn LEFT JOIN ops p ON p.n = pn LEFT JOIN ops x ON x.n = xn""",
        "ev", "eraw", "ops"),
    "relationships_linked": more(
        LINKED,
        """SELECT DISTINCT * FROM (SELECT * FROM bm UNION ALL SELECT tree_id, family_id, person_id, CASE WHEN r = 'c' THEN 'child' ELSE 'spouse' END FROM ly
UNION ALL SELECT tree_id, family_id, person_id, 'record' FROM ly WHERE r <> 'c'
UNION ALL SELECT tree_id, max_by(family_id, n), person_id, 'pointer' FROM ptr GROUP BY tree_id, person_id)""", "fs", "fc", "p0", "ops"),
    "relationships_unlinked": more(
        MEMBERS + """, ux AS (SELECT o.* FROM ops o JOIN fam USING (tree_id, family_id) WHERE kind = 'unlinkRelationship')""",
        """SELECT * FROM bm b WHERE NOT EXISTS (SELECT 1 FROM ux WHERE ux.family_id = b.family_id AND ux.me = b.person_id AND
  ((b.role = 'child' AND relation = 'parent-child') OR (b.role <> 'child' AND relation = 'spouse')))
UNION ALL SELECT c.tree_id, c.family_id, c.person_id, 'pointer' FROM fc c JOIN p0 USING (person_id) WHERE NOT EXISTS (
  SELECT 1 FROM ux WHERE ux.family_id = c.family_id AND ux.me = c.person_id AND relation = 'parent-child')""", "fs", "fc", "p0", "fam", "ops"),
    "redelivered_ops": build("SELECT tree_id, n AS seq, kind FROM ops", "ops"),
    "gedcom_header": build(
        "SELECT DISTINCT tree_id, 'bridge' AS source_system, '5.5.1' AS gedcom_version, 'UTF-8' AS charset FROM p0", "p0"),
    "gedcom_people": more(
        BASE,
        """SELECT b.tree_id, b.person_id, b.names, b.sex, c.family_id AS family_id_as_child, b.notes, CASE WHEN p.k % 4 = 0 THEN 1 ELSE 0 END AS sources
FROM bp b JOIN p0 p USING (person_id) LEFT JOIN fc c ON c.person_id = b.person_id""", "praw", "pname", "p0", "fc"),
    "bundled_people": more(
        BASE,
        """SELECT b.tree_id, b.person_id, b.names, b.sex, c.family_id AS family_id_as_child, b.notes, CASE WHEN p.k % 4 = 0 THEN 1 ELSE 0 END AS sources
FROM bp b JOIN p0 p USING (person_id) LEFT JOIN fc c ON c.person_id = b.person_id""", "praw", "pname", "p0", "fc"),
    "gedcom_families": more(MEMBERS, "SELECT * FROM bm", "fs", "fc"),
    "gedcom_events": more(
        GED_EV, "SELECT tree_id, event_id, type, raw_tag, date_raw, year, trim(place_raw) AS place_raw, description, cited FROM gev", "ev"),
    "gedcom_warnings": build(
        """SELECT c.tree_id, 'warning' AS severity, 'Family @' || c.family_id || '@ references a missing child @' || c.person_id || '@.' AS message, '@' || c.person_id || '@' AS context
FROM fc c WHERE c.person_id LIKE 'X%'""", "fc"),
    "warning_summary": build("SELECT tree_id, 'warning' AS severity, count(*) AS warnings FROM fc WHERE person_id LIKE 'X%' GROUP BY ALL", "fc"),
    "gedcom_text": more(
        TEXT,
        """SELECT tree_id, 0 AS section, 0 AS seq, unnest(['0 HEAD', '1 SOUR bridge', '1 GEDC', '2 VERS 5.5.1', '2 FORM LINEAGE-LINKED', '1 CHAR UTF-8']) AS text
  FROM (SELECT DISTINCT tree_id FROM p0) UNION ALL SELECT DISTINCT tree_id, 3, 0, '0 TRLR' FROM p0
UNION ALL SELECT tree_id, 1, seq, text FROM pl UNION ALL SELECT e.tree_id, 1, p.k, e.text FROM evl e JOIN p0 p ON p.person_id = e.owner_id
UNION ALL SELECT c.tree_id, 1, p.k, '1 FAMC @' || c.family_id || '@' FROM fc c JOIN p0 p USING (person_id)
UNION ALL SELECT tree_id, 1, k, '1 FAMS @' || family_id || '@' FROM fs
UNION ALL SELECT tree_id, 2, f, '0 @' || family_id || '@ FAM' FROM fam UNION ALL SELECT tree_id, 2, seq, text FROM fl
UNION ALL SELECT tree_id, 2, f, '1 CHIL @' || person_id || '@' FROM fc
UNION ALL SELECT e.tree_id, 2, f.f, e.text FROM evl e JOIN fam f ON f.family_id = e.family_id""", "ev", "p0", "praw", "fs", "fc", "fam"),
    "model_json": build(
        """SELECT tree_id, person_id, raw1 || coalesce('|' || raw2, '') AS raws, sex, 'kinloom/model' AS format, 1 AS version FROM praw""", "praw"),
    "model_json_rows": build(
        """SELECT 'header' AS table_name, tree_id, 'bridge' AS a, NULL::VARCHAR AS b, NULL::BIGINT AS n FROM (SELECT DISTINCT tree_id FROM p0)
UNION ALL SELECT 'person', tree_id, person_id, sex, k FROM praw UNION ALL SELECT 'person_fams', tree_id, person_id, family_id, f FROM fs
UNION ALL SELECT 'family', tree_id, family_id, NULL, f FROM fam UNION ALL SELECT 'family_spouse', tree_id, family_id, person_id, ord FROM fs
UNION ALL SELECT 'family_child', tree_id, family_id, person_id, ord FROM fc UNION ALL SELECT 'event', tree_id, event_id, type, year FROM ev
UNION ALL SELECT 'person_event', tree_id, owner_id, event_id, ord FROM ev WHERE owner_id IS NOT NULL
UNION ALL SELECT 'family_event', tree_id, family_id, event_id, ord FROM ev WHERE family_id IS NOT NULL
UNION ALL SELECT 'event_participant', tree_id, event_id, owner_id, 0 FROM ev WHERE owner_id IS NOT NULL
UNION ALL SELECT 'event_participant', e.tree_id, e.event_id, s.person_id, s.ord FROM ev e JOIN fs s USING (family_id)""", "p0", "praw", "fs", "fc", "fam", "ev"),
    "vault_documents": f"""WITH {doc()} SELECT doc_id, filename, original_name, mimetype, size FROM (SELECT hash AS doc_id,
  hash || '.' || CASE mimetype WHEN 'application/pdf' THEN 'pdf' WHEN 'image/png' THEN 'png' ELSE 'jpg' END AS filename, original_name, mimetype, size,
  row_number() OVER (PARTITION BY hash ORDER BY seq) AS rn FROM up WHERE mimetype IS NOT NULL) WHERE rn = 1""",
    "new_source_files": f"""WITH {doc()} SELECT hash, min(original_name) AS path FROM up WHERE hash NOT IN (
  SELECT sha256(d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id) GROUP BY ALL""",
    "document_links": """SELECT 'D' || q AS doc_id, 'sar:' || f || '-' || a || ':' || link AS ref, q AS first_seq FROM (
  SELECT o_orderkey AS q, 'I' || (o_custkey // 64 * 64 + 56 + o_orderkey % 8) AS f, 'I' || (o_custkey // 64 * 64 + o_orderkey // 8 % 16) AS a,
    CASE WHEN o_custkey % 64 // 8 = 0 THEN 'service' ELSE 'I' || o_custkey || '->I' || (o_custkey // 64 * 64 + (o_custkey % 64 // 8 - 1) * 8
      + (o_custkey % 8 * 3 + o_custkey % 64 // 8) % 4 * 2 + o_orderkey % 2) END AS link FROM orders WHERE o_orderstatus = 'F')""",
    "project_manifests": """SELECT s_suppkey::VARCHAR AS file, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'Untitled' END AS name, 'source.ged' AS source_file,
  CASE WHEN s_suppkey % 2 = 0 THEN 'tree.ged' ELSE 'source.ged' END AS source_file_name, CASE WHEN s_suppkey % 5 = 0 THEN sha256(s_name) ELSE '' END AS source_hash,
  CASE WHEN s_suppkey % 4 = 0 THEN 'I' || s_suppkey END AS focal_person_id, CASE WHEN s_suppkey % 2 = 1 THEN 'horizontal' ELSE 'vertical' END AS orientation
FROM supplier WHERE s_suppkey % 7 <> 0""",
}

# The edits of each tree one after the other. A link between a parent and a child first climbs from the parent, a generation
# a step, until the child is met (refused) or nobody is left (accepted); any other edit takes one step.
_REPLACED = "list_distinct(list_transform(mem, lambda m: {'f': m.f, 'p': CASE WHEN m.p = you THEN me ELSE m.p END, 'r': m.r}))"
STEPS = f"""lo AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n) AS i, relation = 'parent-child' AS blood FROM ops
  WHERE kind IN ('addPerson', 'merge', 'linkRelationship', 'unlinkRelationship')),
s0 AS (SELECT tree_id, list({{'f': family_id, 'p': person_id, 'r': r}}) AS mem FROM (
  SELECT tree_id, family_id, person_id, 's' AS r FROM fs UNION SELECT tree_id, family_id, person_id, 'c' FROM fc) GROUP BY tree_id),
w AS (SELECT tree_id, 1::BIGINT AS i, mem, (SELECT list(person_id) FROM p0 WHERE p0.tree_id = s0.tree_id) AS alive, NULL::VARCHAR[] AS front,
    NULL::VARCHAR[] AS seen, NULL::BIGINT AS n, NULL::VARCHAR AS did FROM s0
  UNION ALL
  SELECT tree_id, CASE WHEN did = 'climb' THEN i ELSE i + 1 END,
    CASE did WHEN 'link' THEN list_distinct(mem || list_filter([{{'f': fam, 'p': me, 'r': 's'}}, {{'f': fam, 'p': you, 'r': CASE WHEN blood THEN 'c' ELSE 's' END}}],
        lambda m: list_contains(alive, m.p)))
      WHEN 'unlink' THEN list_filter(mem, lambda m: NOT (m.f = fam AND m.p = me AND m.r = CASE WHEN blood THEN 'c' ELSE 's' END))
      WHEN 'merge' THEN list_filter({_REPLACED}, lambda m: NOT (m.r = 'c' AND m.p = me AND list_contains(touched, m.f) AND list_contains(wed, m.f)))
      ELSE mem END,
    CASE did WHEN 'merge' THEN list_filter(alive, lambda x: x <> you) WHEN 'add' THEN list_append(alive, person) ELSE alive END,
    CASE WHEN did = 'climb' THEN CASE WHEN front IS NULL THEN [me] ELSE list_filter(up, lambda x: NOT list_contains(seen, x)) END END,
    CASE WHEN did = 'climb' THEN CASE WHEN front IS NULL THEN [me] ELSE list_distinct(seen || up) END END, n, did
  FROM (SELECT *, CASE kind
      WHEN 'addPerson' THEN CASE WHEN list_contains(alive, person) THEN 'none' ELSE 'add' END
      WHEN 'merge' THEN CASE WHEN me <> you AND list_contains(alive, me) AND list_contains(alive, you) THEN 'merge' ELSE 'none' END
      WHEN 'unlinkRelationship' THEN 'unlink'
      ELSE CASE WHEN NOT (list_contains(alive, me) AND list_contains(alive, you)) THEN 'link' WHEN me = you THEN 'self' WHEN NOT blood THEN 'link'
        WHEN list_contains(seen, you) THEN 'loop' WHEN len(front) = 0 THEN 'link' ELSE 'climb' END END AS did
    FROM (SELECT *, list_distinct(list_transform(list_filter(mem, lambda m: m.r = 's' AND list_contains(born, m.f) AND list_contains(alive, m.p)), lambda m: m.p)) AS up
      FROM (SELECT w.tree_id, w.i, mem, alive, front, seen, o.n, kind, blood, me, you, family_id AS fam, person_id AS person,
          CASE WHEN front IS NOT NULL THEN list_transform(list_filter(mem, lambda m: m.r = 'c' AND list_contains(front, m.p)), lambda m: m.f) END AS born,
          CASE WHEN kind = 'merge' THEN list_transform(list_filter(mem, lambda m: m.p = you), lambda m: m.f) END AS touched,
          CASE WHEN kind = 'merge' THEN list_transform(list_filter(mem, lambda m: m.r = 's' AND (m.p = you OR m.p = me)), lambda m: m.f) END AS wed
        FROM w JOIN lo o ON o.tree_id = w.tree_id AND o.i = w.i)))),
bad AS (SELECT w.tree_id, w.n AS seq, w.did, o.me, o.you, o.blood FROM w JOIN lo o ON o.n = w.n WHERE did IN ('self', 'loop')),
since AS (SELECT b.seq, x.p, coalesce(max(a.n), -1) AS s FROM bad b, LATERAL (SELECT unnest([b.me, b.you]) AS p) x
  LEFT JOIN (SELECT w.n, o.person_id FROM w JOIN lo o ON o.n = w.n WHERE did = 'add') a ON a.person_id = x.p AND a.n < b.seq GROUP BY ALL),
nm AS (SELECT s.seq, s.p, coalesce(any_value(e.nn), any_value(CASE WHEN s.s < 0 THEN q.full_name ELSE a.nn END), s.p) AS name FROM since s
  LEFT JOIN (SELECT s.seq, s.p, max_by({FULL}, o.n) AS nn FROM since s JOIN ops o ON o.kind = 'editPerson' AND o.me = s.p AND o.name_raw IS NOT NULL AND o.n > s.s AND o.n < s.seq
    GROUP BY ALL) e ON e.seq = s.seq AND e.p = s.p
  LEFT JOIN person q ON q.person_id = s.p LEFT JOIN (SELECT n, {FULL} AS nn FROM ops WHERE kind = 'addPerson') a ON a.n = s.s GROUP BY s.seq, s.p)"""
_GUARD = ("ops", "person", "p0", "fs", "fc")
ORACLES["blocked_links"] = more(
    STEPS,
    """SELECT b.tree_id, b.seq, CASE WHEN did = 'loop' THEN a.name || ' is already a descendant of ' || c.name || ', so this would make ' || c.name || ' their own ancestor.'
  WHEN blood THEN a.name || ' cannot be their own parent.' ELSE a.name || ' cannot be married to themselves.' END AS message
FROM bad b JOIN nm a ON a.seq = b.seq AND a.p = b.me JOIN nm c ON c.seq = b.seq AND c.p = b.you""", *_GUARD)
ORACLES["links_let_through"] = more(
    STEPS, "SELECT tree_id, n AS seq, family_id FROM ops WHERE kind = 'linkRelationship' AND n NOT IN (SELECT seq FROM bad)", *_GUARD)
ORACLES["guarded_families"] = more(
    STEPS,
    """SELECT tree_id, m.f AS family_id, m.p AS person_id, CASE m.r WHEN 's' THEN 'spouse' ELSE 'child' END AS role FROM (
  SELECT tree_id, unnest(max_by(mem, (i, n, coalesce(len(seen), 0)))) AS m FROM w GROUP BY tree_id)""", *_GUARD)
ORACLES["project_ops"] = build(
    """SELECT tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY n) - 1 AS seq, kind, person_id, CASE WHEN kind = 'merge' THEN me END AS keep_id,
  CASE WHEN kind = 'merge' THEN you END AS merge_id, name_raw AS name_raws, sex, note AS notes, event_id, event_type,
  CASE WHEN kind = 'addEvent' THEN me || '>' || you END AS participant_ids,
  CASE WHEN kind = 'addEvent' OR n % 2 = 1 THEN date_raw END AS date_raw, kind = 'editEvent' AND n % 2 = 1 AS date_set,
  CASE WHEN kind = 'addEvent' OR n % 4 = 0 THEN place_raw END AS place_raw, kind = 'editEvent' AND n % 4 = 0 AS place_set,
  CASE WHEN kind = 'addEvent' OR n % 4 = 2 THEN description END AS description, kind = 'editEvent' AND n % 4 = 2 AS description_set,
  family_id, relation, CASE WHEN kind = 'linkRelationship' AND relation = 'parent-child' THEN me END AS parent_id,
  CASE WHEN relation = 'parent-child' THEN CASE WHEN kind = 'linkRelationship' THEN you ELSE me END END AS child_id,
  CASE WHEN relation = 'spouse' THEN me END AS spouse_a, CASE WHEN kind = 'linkRelationship' AND relation = 'spouse' THEN you END AS spouse_b FROM ops""", "ops")
_PROOFS = """pf AS (SELECT 'T' || (o_custkey // 64) AS tree_id, 'I' || (o_custkey // 64 * 64 + 56 + o_orderkey % 8) || '-I' || (o_custkey // 64 * 64 + o_orderkey // 8 % 16) AS checklist_id,
  'I' || (o_custkey // 64 * 64 + o_orderkey // 8 % 16) AS patriot_id, o_orderkey AS q, o_orderstatus = 'F' AS is_doc,
  CASE WHEN o_custkey % 64 // 8 = 0 THEN 'service' ELSE 'I' || o_custkey || '->I' || (o_custkey // 64 * 64 + (o_custkey % 64 // 8 - 1) * 8
    + (o_custkey % 8 * 3 + o_custkey % 64 // 8) % 4 * 2 + o_orderkey % 2) END AS link FROM orders),
held AS (SELECT pf.* FROM pf WHERE tree_id IN (SELECT tree_id FROM p0))"""
ORACLES["project_checklists"] = more(
    _PROOFS,
    """SELECT tree_id AS file, row_number() OVER (PARTITION BY tree_id ORDER BY checklist_id) - 1 AS checklist_no, checklist_id, 'SAR' AS society_id, patriot_id, count(*) AS proofs
FROM held GROUP BY tree_id, checklist_id, patriot_id""", "p0")
ORACLES["project_proofs"] = more(
    _PROOFS,
    """SELECT tree_id AS file, checklist_id, row_number() OVER (PARTITION BY tree_id, checklist_id ORDER BY q) - 1 AS seq, CASE WHEN is_doc THEN 'document' ELSE 'record-copy' END AS kind,
  CASE WHEN is_doc THEN 'D' || q END AS doc_id, CASE WHEN NOT is_doc AND q % 5 = 0 THEN link || '>service' ELSE link END AS covered_keys,
  CASE WHEN NOT is_doc THEN CASE WHEN q % 2 = 0 THEN 'SAR' ELSE 'DAR' END END AS society, CASE WHEN NOT is_doc THEN (q + 1000)::VARCHAR END AS national_number,
  CASE WHEN NOT is_doc THEN 1975 + q % 25 END AS approved_year, CASE WHEN NOT is_doc AND q % 4 = 1 THEN 'pension file' END AS service_proof_cited FROM held""", "p0")
# Where everybody ends up by merges alone, with the merges on the way from the person who is left.
FOLDS = MERGES + """,
fo AS (SELECT tree_id, person_id AS id, person_id AS at, [0::BIGINT][:0] AS path FROM p0
  UNION ALL SELECT f.tree_id, f.id, s.keep_id, list_prepend(s.n, f.path) FROM fo f JOIN st s ON s.tree_id = f.tree_id AND s.id = f.at),
fd AS (SELECT f.tree_id, f.id, f.at AS root, f.path FROM fo f JOIN ok ON ok.tree_id = f.tree_id AND ok.person_id = f.at)"""
_EVENTS = FOLDS + """, le AS (SELECT d.tree_id, d.root AS person_id, e.event_id, d.path, e.ord FROM fd d JOIN ev e ON e.tree_id = d.tree_id AND e.owner_id = d.id)"""
ORACLES["merged_event_rows"] = more(
    _EVENTS, "SELECT tree_id, person_id, event_id, row_number() OVER (PARTITION BY tree_id, person_id ORDER BY path, ord) - 1 AS position FROM le", "ops", "p0", "ev")
ORACLES["merged_event_lists"] = more(_EVENTS, "SELECT tree_id, person_id, count(*) AS events FROM le GROUP BY ALL", "ops", "p0", "ev")
ORACLES["merged_sources"] = more(
    FOLDS, """SELECT d.tree_id, d.root AS person_id, max(CASE WHEN a.k % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS sources
FROM fd d JOIN praw a ON a.person_id = d.id GROUP BY ALL""", "ops", "p0", "praw")
ORACLES["people_merged"] = more(
    FOLDS + """,
na AS (SELECT d.tree_id, d.root, d.path, n.pos0, n."full" AS shown, CASE WHEN n."full" <> '' THEN n."full" ELSE n.raw END AS label
  FROM fd d JOIN pname n ON n.person_id = d.id),
nb AS (SELECT tree_id, root, path, pos0, shown FROM na WHERE len(path) = 0 UNION ALL
  SELECT tree_id, root, path, pos0, shown FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, root, label ORDER BY path, pos0) AS nth FROM na m
    WHERE len(path) > 0 AND NOT EXISTS (SELECT 1 FROM na o WHERE o.tree_id = m.tree_id AND o.root = m.root AND len(o.path) = 0 AND o.label = m.label)) WHERE nth = 1),
nc AS (SELECT tree_id, root, string_agg(shown, '|' ORDER BY path, pos0) AS names FROM nb GROUP BY ALL),
rest AS (SELECT d.tree_id, d.root, coalesce(min_by(a.sex, d.path) FILTER (a.sex <> 'unknown'), 'unknown') AS sex,
    coalesce(string_agg('note ' || a.k, '|' ORDER BY d.path) FILTER (a.k % 5 = 0), '') AS notes,
    coalesce(string_agg(d.id, '|' ORDER BY d.path) FILTER (len(d.path) > 0), '') AS merged_from_ids
  FROM fd d JOIN praw a ON a.person_id = d.id GROUP BY ALL)""",
    """SELECT r.tree_id, r.root AS person_id, c.names, r.sex, r.notes, false AS user_supplied, r.merged_from_ids
FROM rest r LEFT JOIN nc c ON c.tree_id = r.tree_id AND c.root = r.root""", "ops", "p0", "praw", "pname")
