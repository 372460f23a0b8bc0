"""Many trees in few files, dumps read back, societies and name search by hand."""

from __future__ import annotations

import json

import pytest

from kinloom.functions.names import parse_names
from kinloom.operators import society, views
from kinloom.sources import gedcom, sinks
from pyspark.sql import functions as F


def test_trees_share_files_and_come_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sizes = {f"t {i}%": 1 + i % 4 for i in range(60)} | {"big": 400}
    for name, n in sizes.items():
        people = "".join(f"0 @I{i}@ INDI\n1 NAME P{i} /{name}/\n" for i in range(n))
        (tmp_path / "in" / f"{name}.ged").write_text("0 HEAD\n1 SOUR x\n" + people + "0 TRLR\n")
    first = gedcom.parse_corpus(spark, str(tmp_path / "in"))
    sinks.write_bundles(first, str(tmp_path / "out"), files=5)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) <= 5
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")  # splits begin inside trees
    try:
        again = gedcom.parse_corpus(spark, str(tmp_path / "out"), bundled=True)
        rows = lambda c: sorted((r.tree_id, r.person_id, r["full"]) for r in c.person.selectExpr("tree_id", "person_id", "names[0].full as full").collect())
        assert rows(again) == rows(first) and len(rows(first)) == sum(sizes.values())
        assert [r.person_id for r in again.person.where("tree_id = 'big'").orderBy("seq").collect()] == [f"I{i}" for i in range(400)]
        assert again.header.count() == len(sizes) and not again.warning.where("severity <> 'info'").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_dump_of_another_version_is_an_error(spark, tmp_path):
    (tmp_path / "layouts").mkdir()
    (tmp_path / "layouts" / "part-0.json").write_text(json.dumps({"name": "person", "layout": "{}", "format": sinks.FORMAT, "version": 9}) + "\n")
    with pytest.raises(ValueError, match="person"):
        sinks.read_model_json(spark, str(tmp_path))


def test_a_society_without_rules_takes_documents_only(spark):
    line = "tree_id string, focal_id string, ancestor_id string"
    items = spark.createDataFrame([("T", "a", "z", "k1", 1), ("T", "a", "z", "k2", 2), ("T", "a", "z", "k3", 3)], line + ", link_key string, link_no int")
    proofs = spark.createDataFrame(
        [("T", "a", "z", 1, "document", "D1", ["k1"], None, None, None, None),
         ("T", "a", "z", 2, "record-copy", None, ["k2"], "S", "7", 1990, None),
         ("T", "a", "z", 3, "record-copy", None, ["k3"], "S", "8", None, None)],
        line + ", seq bigint, kind string, doc_id string, covered_keys array<string>, society string, national_number string, "
               "approved_year int, service_proof_cited string")
    base = society.SOCIETY_RULES[0]
    rules = society.society_rules(spark, [base, base | {"society_id": "late", "record_copy_cutoff": 1995}])
    asked = spark.createDataFrame([("T", "a", "z", s) for s in ("sar", "late", "none", "sar")], line + ", society_id string")
    got = {(r.society_id, r.link_key): (r.status, r.insufficient) for r in society.evaluate_applications(items, proofs, asked, rules).collect()}
    document, copy, open_ = ("sourced-by-document", False), ("proven-by-record-copy", False), "unproven"
    assert {k: got[k] for k in got if k[1] == "k1"} == {(s, "k1"): document for s in ("sar", "late", "none")}
    assert got["sar", "k2"] == copy and got["late", "k2"] == got["none", "k2"] == (open_, True)
    assert {got[s, "k3"][0] for s in ("sar", "late", "none")} == {open_} and len(got) == 9


def test_name_search_equals_a_plain_scan(spark):
    raws = ["Ann /Lee/", "ann /LEESON/", "Bo", "", "Zoë /Łuk/", "aaa /aaaa/", "Ann Marie /van Lee/ Jr", None]
    person = spark.createDataFrame([("T", f"I{i}", i, [raw, "Alias /X/"] if i % 3 == 0 else [raw]) for i, raw in enumerate(raws)],
                                   "tree_id string, person_id string, seq bigint, raws array<string>")
    person = person.withColumn("names", parse_names(F.col("raws")))
    texts = ["lee", " LEE ", "l", "nn", "aaaaa", "aaaa", "ann lee", "/lee", "zoë", "ŁUK", "x/", "nobody", "  ", "", "van lee jr", "Ann Marie /van Lee/ Jr and more"]
    asked = spark.createDataFrame([(t,) for t in texts * 2], "query string")
    got = sorted((r.query, r.person_id, r["rank"]) for r in views.search_people(person, views.name_grams(person), asked).collect())
    want = []
    people = [(r.person_id, [r2[f] or "" for r2 in r.names for f in ("full", "given", "surname", "raw")]) for r in person.orderBy("seq").collect()]
    for text in texts:
        needle = text.strip().lower()
        hits = [who for who, forms in people if needle and any(needle in form.lower() for form in forms)]
        want += [(text, who, at + 1) for at, who in enumerate(hits)]
    assert got == sorted(want)
