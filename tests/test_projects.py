"""Saved projects: tables to manifests and back."""

from __future__ import annotations

import json
import random

from test_edits import FIELDS, random_ops

from kinloom.operators import edits
from kinloom.sources import files, projects


def test_edits_and_proofs_come_back(spark):
    ops = [op for t in ("T0", "T1") for op in random_ops(t, random.Random(ord(t[1])), 40, 3)]
    for op in ops:
        if op["kind"] == "editEvent":  # what an edit does not set is not saved
            op.update({c: op[c] if op[flag] else None for c, flag in projects.CLEARED.items()})
        else:
            op.update(date_set=False, place_set=False, description_set=False)
    log = spark.createDataFrame([tuple(op[f] for f in FIELDS) for op in ops], edits.OP_SCHEMA)
    heads = spark.createDataFrame(
        [(t, 'A "tree"', "s.ged", "up.ged", "", "P1", "horizontal", "2020") for t in ("T0", "T1", "T2")],
        "tree_id string, name string, source_file string, source_file_name string, source_hash string, focal_person_id string, orientation string, updated_at string")
    lists = spark.createDataFrame([("T0", "c1", "SAR", "P0", "2019"), ("T0", "c2", "SAR", "P1", None)],
                                  "tree_id string, checklist_id string, society_id string, patriot_id string, created_at string")
    proofs = spark.createDataFrame(
        [("T0", "c1", 7, "document", "D1", ["A->B"], None, None, None, None), ("T0", "c1", 3, "record-copy", None, ["A->B", "service"], "DAR", "12", 1990, "file")],
        "tree_id string, checklist_id string, seq long, kind string, doc_id string, covered_keys array<string>, society string, national_number string, "
        "approved_year int, service_proof_cited string")
    texts = projects.project_texts(heads, log, lists, proofs)
    for r in texts.collect():
        assert json.loads(r.value)["format"] == files.MANIFEST_FORMAT  # sound JSON
    saved = files.parse_projects(texts)
    assert {(r.file, r.name, r.orientation) for r in saved.collect()} == {(t, 'A "tree"', "horizontal") for t in ("T0", "T1", "T2")}
    got = projects.project_ops(saved).drop("made_at")
    assert got.schema.simpleString() == log.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, log.collect()))
    assert [tuple(r) for r in projects.project_checklists(saved).orderBy("checklist_no").collect()] == [
        ("T0", 0, "c1", "SAR", "P0", "2019", 2), ("T0", 1, "c2", "SAR", "P1", None, 0)]
    assert [(r.seq, r.kind, r.doc_id, r.covered_keys, r.society, r.approved_year) for r in projects.project_proofs(saved).orderBy("seq").collect()] == [
        (0, "record-copy", None, ["A->B", "service"], "DAR", 1990), (1, "document", "D1", ["A->B"], None, None)]
    assert projects.project_problems(saved).count() == 0


def test_what_cannot_be_decoded_is_reported(spark):
    manifest = {"format": files.MANIFEST_FORMAT, "ops": [{"kind": "fly"}, 5, {"keepId": "P1"}, {"kind": "editEvent", "eventId": "E", "dateRaw": None, "placeRaw": "x"}],
                "checklists": [{"societyId": "SAR"}, {"id": "c", "proofs": [{"kind": "hearsay"}, {"kind": "document", "linkKey": "k", "docId": "d"}, {}]}]}
    texts = spark.createDataFrame([("f", json.dumps(manifest)), ("g", "not json"), ("h", '{"format": "other"}')], "file string, value string")
    saved = files.parse_projects(texts)
    assert sorted(map(tuple, projects.project_problems(saved).collect())) == [
        ("f", "checklists", 0, "no id"), ("f", "ops", 0, "unknown kind fly"), ("f", "ops", 1, "no kind"), ("f", "ops", 2, "no kind"),
        ("f", "proofs of c", 0, "unknown kind hearsay"), ("f", "proofs of c", 2, "no kind")]
    (op,) = projects.project_ops(saved).collect()
    assert (op.seq, op.date_raw, op.date_set, op.place_raw, op.place_set, op.description_set) == (3, None, True, "x", True, False)
    assert [r.doc_id for r in projects.project_proofs(saved).collect()] == ["d"]
