"""Saved projects as tables: edits, checklists and proofs, read from manifests and written to them.

A manifest is one JSON text per project. Its lists are taken apart element by
element and decoded by the element's kind; what cannot be decoded is reported, not
dropped silently. An edit may clear a field by an explicit null, which is not the
same as leaving the field out, so the keys of an element are looked at as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.edits import OP_SCHEMA
from kinloom.sources.files import MANIFEST_FORMAT

# Names of the fields of an edit in a manifest, by column, and the edits there are.
OP_FIELDS = {
    "kind": "kind", "person_id": "personId", "keep_id": "keepId", "merge_id": "mergeId", "name_raws": "nameRaws", "sex": "sex", "notes": "notes",
    "event_id": "eventId", "event_type": "eventType", "raw_tag": "rawTag", "participant_ids": "participantIds", "date_raw": "dateRaw",
    "place_raw": "placeRaw", "description": "description", "family_id": "familyId", "relation": "relation", "parent_id": "parentId",
    "child_id": "childId", "spouse_a": "spouseAId", "spouse_b": "spouseBId",
}
OP_KINDS = ["merge", "addPerson", "editPerson", "addEvent", "editEvent", "linkRelationship", "unlinkRelationship"]
CLEARED = {"date_raw": "date_set", "place_raw": "place_set", "description": "description_set"}
PROOF_KINDS = ["document", "record-copy"]
_LISTS = {"name_raws", "notes", "participant_ids"}
_CHECKLIST = "id string, societyId string, patriotId string, proofs array<string>, createdAt string"
_PROOF = (
    "kind string, linkKey string, docId string, coveredKeys array<string>, society string, nationalNumber string, patriotName string, "
    "approvedYear int, serviceProofCited string"
)


def _elements(projects: DataFrame, column: str) -> DataFrame:
    """(file, seq, value): one row per element, numbered from 0."""
    return projects.select("file", F.posexplode(column).alias("seq", "value")).withColumn("seq", F.col("seq").cast("bigint"))


def _has(key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys("value"), key), F.lit(False))


def _decoded_ops(projects: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f} {'array<string>' if c in _LISTS else 'string'}" for c, f in OP_FIELDS.items()) + ", at string"
    return _elements(projects, "ops").withColumn("o", F.from_json("value", schema))


def project_ops(projects: DataFrame) -> DataFrame:
    """The edits of parsed projects as a log (``OP_SCHEMA``; the tree is the file, seq the place in the list), and made_at."""
    rows = _decoded_ops(projects).where(F.col("o.kind").isin(OP_KINDS))
    editing = F.col("o.kind") == "editEvent"
    columns = {c: F.col(f"o.{f}") for c, f in OP_FIELDS.items()} | {c: editing & _has(OP_FIELDS[f]) for f, c in CLEARED.items()}
    names = [part.split(" ")[0] for part in OP_SCHEMA.replace("array<string>", "list").split(", ")]
    own = {"tree_id": F.col("file"), "seq": F.col("seq")}
    return rows.select(*[(own.get(n) if n in own else columns[n]).alias(n) for n in names], F.col("o.at").alias("made_at"))


def _decoded_checklists(projects: DataFrame) -> DataFrame:
    return _elements(projects, "checklists").withColumn("c", F.from_json("value", _CHECKLIST))


def project_checklists(projects: DataFrame) -> DataFrame:
    """(file, checklist_no, checklist_id, society_id, patriot_id, created_at, proofs), the last a number."""
    return _decoded_checklists(projects).where(F.col("c.id").isNotNull()).select(
        "file", F.col("seq").alias("checklist_no"), F.col("c.id").alias("checklist_id"), F.col("c.societyId").alias("society_id"),
        F.col("c.patriotId").alias("patriot_id"), F.col("c.createdAt").alias("created_at"),
        F.coalesce(F.size("c.proofs"), F.lit(0)).cast("bigint").alias("proofs"))


def _decoded_proofs(projects: DataFrame) -> DataFrame:
    lists = _decoded_checklists(projects).where(F.col("c.id").isNotNull())
    return lists.select("file", F.col("c.id").alias("checklist_id"), F.posexplode("c.proofs").alias("seq", "value")).withColumn(
        "seq", F.col("seq").cast("bigint")).withColumn("p", F.from_json("value", _PROOF))


def project_proofs(projects: DataFrame) -> DataFrame:
    """(file, checklist_id, seq, kind, doc_id, covered_keys, society, national_number, patriot_name, approved_year, service_proof_cited)."""
    document = F.col("p.kind") == "document"
    return _decoded_proofs(projects).where(F.col("p.kind").isin(PROOF_KINDS)).select(
        "file", "checklist_id", "seq", F.col("p.kind").alias("kind"), F.when(document, F.col("p.docId")).alias("doc_id"),
        F.when(document, F.array("p.linkKey")).otherwise(F.coalesce("p.coveredKeys", F.array().cast("array<string>"))).alias("covered_keys"),
        *[F.when(~document, F.col(f"p.{f}")).alias(c) for c, f in (
            ("society", "society"), ("national_number", "nationalNumber"), ("patriot_name", "patriotName"), ("approved_year", "approvedYear"),
            ("service_proof_cited", "serviceProofCited"))])


def project_problems(projects: DataFrame) -> DataFrame:
    """(file, part, seq, problem): elements that are in none of the tables."""
    ops = _decoded_ops(projects).where(~F.coalesce(F.col("o.kind").isin(OP_KINDS), F.lit(False))).select(
        "file", F.lit("ops").alias("part"), "seq", F.col("o.kind").alias("kind"))
    lists = _decoded_checklists(projects).where(F.col("c.id").isNull()).select(
        "file", F.lit("checklists").alias("part"), "seq", F.lit(None).cast("string").alias("kind"))
    proofs = _decoded_proofs(projects).where(~F.coalesce(F.col("p.kind").isin(PROOF_KINDS), F.lit(False))).select(
        "file", F.concat(F.lit("proofs of "), "checklist_id").alias("part"), "seq", F.col("p.kind").alias("kind"))
    told = F.when(F.col("kind").isNotNull(), F.concat(F.lit("unknown kind "), "kind")).when(F.col("part") == "checklists", "no id").otherwise("no kind")
    return ops.unionByName(lists).unionByName(proofs).select("file", "part", "seq", told.alias("problem"))


def _with_nulls(text: Column, fields: dict[str, Column]) -> Column:
    """JSON text of an object with ``"field":null`` added where asked."""
    more = F.concat(*[F.when(when, F.lit(f',"{name}":null')).otherwise("") for name, when in fields.items()])
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), more, F.lit("}"))


def op_texts(op: DataFrame) -> DataFrame:
    """(tree_id, seq, value): each edit of a log as an element of a manifest."""
    sent = [F.col(c).alias(f) for c, f in OP_FIELDS.items()] + ([F.col("made_at").alias("at")] if "made_at" in op.columns else [])
    cleared = {OP_FIELDS[c]: F.coalesce(F.col(flag), F.lit(False)) & F.col(c).isNull() for c, flag in CLEARED.items()}
    # a field that an edit does not set is left out, whatever the column holds
    kept = op.withColumns({c: F.when((F.col("kind") != "editEvent") | F.col(flag), F.col(c)) for c, flag in CLEARED.items()})
    return kept.select("tree_id", "seq", _with_nulls(F.to_json(F.struct(*sent)), cleared).alias("value"))


def proof_texts(proofs: DataFrame) -> DataFrame:
    """(tree_id, checklist_id, seq, value)."""
    document = F.col("kind") == "document"
    column = lambda c: F.col(c) if c in proofs.columns else F.lit(None).cast("string")
    sent = F.struct(
        "kind", F.when(document, F.element_at("covered_keys", 1)).alias("linkKey"), F.when(document, F.col("doc_id")).alias("docId"),
        F.when(~document, F.col("covered_keys")).alias("coveredKeys"), "society", F.col("national_number").alias("nationalNumber"),
        column("patriot_name").alias("patriotName"), F.col("approved_year").alias("approvedYear"), F.col("service_proof_cited").alias("serviceProofCited"))
    return proofs.select("tree_id", "checklist_id", "seq", F.to_json(sent).alias("value"))


def _listed(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The values of each group as the text of a JSON list, in order."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(order, "value"))), lambda x: x["value"])
    return rows.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")).alias(name))


def project_texts(projects: DataFrame, op: DataFrame, checklists: DataFrame, proofs: DataFrame) -> DataFrame:
    """(file, value): manifests of projects.

    ``projects(tree_id, name, source_file, source_file_name, source_hash, focal_person_id, orientation, updated_at)``,
    ``checklists(tree_id, checklist_id, society_id, patriot_id, created_at)`` and ``proofs`` with their checklist_id. A
    manifest is one value, as the format has it; its size is that of the project's edits.
    """
    backed = _listed(proof_texts(proofs), ["tree_id", "checklist_id"], "seq", "proofs")
    head = F.to_json(F.struct(F.col("checklist_id").alias("id"), F.col("society_id").alias("societyId"), F.col("patriot_id").alias("patriotId"),
                              F.col("created_at").alias("createdAt")))
    boxed = lambda text, *parts: F.concat(F.substring(text, F.lit(1), F.length(text) - 1), *parts, F.lit("}"))
    lists = checklists.join(backed, ["tree_id", "checklist_id"], "left").select(
        "tree_id", "checklist_id", boxed(head, F.lit(',"proofs":'), F.coalesce("proofs", F.lit("[]"))).alias("value"))
    top = F.to_json(F.struct(
        F.lit(MANIFEST_FORMAT).alias("format"), F.lit(1).alias("version"), "name", F.col("source_file").alias("sourceFile"),
        F.col("source_file_name").alias("sourceFileName"), F.col("source_hash").alias("sourceHash"), F.col("focal_person_id").alias("focalPersonId"),
        F.struct("orientation").alias("settings"), F.col("updated_at").alias("updatedAt")))
    return projects.join(_listed(op_texts(op), ["tree_id"], "seq", "ops"), "tree_id", "left").join(
        _listed(lists, ["tree_id"], "checklist_id", "checklists"), "tree_id", "left").select(
        F.col("tree_id").alias("file"),
        boxed(top, F.lit(',"ops":'), F.coalesce("ops", F.lit("[]")), F.lit(',"checklists":'), F.coalesce("checklists", F.lit("[]"))).alias("value"))
