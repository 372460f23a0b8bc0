"""Reading, writing and streaming on small files."""

from __future__ import annotations

import copy
import random

from pyspark.sql import functions as F
from test_edits import FIELDS, as_state, base_state, base_tables, brute, random_ops, same

from kinloom.operators import edits, geo
from kinloom.sources import gedcom, sinks
from kinloom.streaming import oplog
from kinloom.streaming import places as place_stream

TREE = """0 HEAD
1 SOUR TestApp
1 _ROOT @I3@
0 @I1@ INDI
1 NAME John /Smith/
1 SEX M
1 BIRT
2 DATE 12 JUN 1900
2 PLAC Boston,  Suffolk
2 SOUR @S1@
3 PAGE p. 12
1 NOTE first
2 CONT second
2 CONC  third
1 FAMS @F1@
1 _VEND x
1 HOBBY fishing
1 GRAD
2 DATE 1920
0 @I2@ INDI
1 SEX F
1 FAMS @F9@
0 @I3@ INDI
1 NAME Ann /Smith/
1 FAMC @F1@
1 FAMC @F2@
1 BIRT
2 PLAC BOSTON, Suffolk
0 @F1@ FAM
1 WIFE @I2@
1 HUSB @I1@
1 CHIL @I3@
1 CHIL @I8@
0 @X1@ WEIRD
0 TRLR
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_read_and_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "small.ged").write_bytes(TREE.replace("\n", "\r\n").encode())
    c = gedcom.parse_corpus(spark, str(tmp_path / "in"))
    assert c.header.first().root_person_id == "I3"
    assert rows(c.person, "person_id", "sex", "family_id_as_child") == [
        ("I1", "male", None), ("I2", "female", None), ("I3", "unknown", "F1")
    ]
    assert c.person.where("person_id = 'I1'").first().notes == ["first\nsecond third"]
    ev = {r.event_id: r for r in c.event.collect()}
    assert set(ev) == {"I1-BIRT-0", "I1-GRAD-0", "I3-BIRT-0"}
    assert ev["I3-BIRT-0"].place.raw == "Boston,  Suffolk" and ev["I1-BIRT-0"].sources[0].page == "p. 12"
    assert [r.person_id for r in c.family_spouse.orderBy("ord").collect()] == ["I1", "I2"]
    assert gedcom.warning_summary(c.warning).count() == 2 and c.warning.count() == 7
    sinks.write_gedcom(c, str(tmp_path / "out"))
    again = gedcom.parse_corpus(spark, str(tmp_path / "out"), tree_from_folder=True)
    for table, cols in (("person", ["person_id", "sex", "seq"]), ("family_child", ["family_id", "person_id"]), ("event", ["event_id", "date", "place"])):
        key = [F.col(x) if x != "seq" else F.lit(0) for x in cols]
        assert rows(getattr(again, table), *key) == rows(getattr(c, table), *key)


def test_edit_stream_equals_batch(spark, tmp_path):
    trees = ["T0", "T1"]
    logs = {t: random_ops(t, random.Random(i), 18, 3) for i, t in enumerate(trees)}
    base, incoming = base_tables(spark, trees), tmp_path / "ops"
    everything = [op for ops in logs.values() for op in ops]
    for part in (everything[20:], everything[:24]):
        spark.createDataFrame([tuple(op[f] for f in FIELDS) for op in part], edits.OP_SCHEMA).coalesce(1).write.mode(
            "append").parquet(str(incoming))
    states: dict = {}
    query = oplog.apply_stream(
        oplog.stream_ops(spark, str(incoming), 1), base, str(tmp_path / "log"), str(tmp_path / "ckpt"),
        lambda tables, touched, batch: states.update(as_state(tables)),
    )
    query.awaitTermination()
    for t in trees:
        same(brute(base_state(), logs[t]), states[t])


def test_a_batch_of_edits_that_runs_again(spark, tmp_path):
    """The log holds every edit once, and the outcome is the same."""
    base = base_tables(spark, ["T0"])
    ops = random_ops("T0", random.Random(3), 10, 3)
    rows_of = lambda some: spark.createDataFrame([tuple(op[f] for f in FIELDS) for op in some], edits.OP_SCHEMA)
    log, seen = str(tmp_path / "log"), []
    publish = lambda tables, touched, batch: seen.append(as_state(tables)["T0"])
    for batch_id, part in ((0, ops[:6]), (0, ops[:6]), (1, ops[4:]), (1, ops[4:])):
        oplog.apply_batch(rows_of(part), batch_id, base, log, publish)
    assert oplog.read_log(spark, log).count() == len(ops) + 2  # two edits came in both batches
    same(copy.deepcopy(seen[0]), copy.deepcopy(seen[1]))
    same(copy.deepcopy(seen[2]), copy.deepcopy(seen[3]))
    same(brute(base_state(), ops), seen[3])


def test_files_of_one_name_encodings_and_line_ends(spark, tmp_path):
    text = lambda name: f"0 HEAD\n0 @I1@ INDI\n1 NAME {name} /Ütz/\n1 NOTE a\n2 CONT b\n0 @I2@ INDI\n0 TRLR\n"
    files = {
        "x/tree.ged": text("Ann").encode(), "y/tree.ged": text("Bob").encode("utf-8-sig"), "mac.ged": text("Cyr").replace("\n", "\r").encode(),
        "dos.v1.ged": text("Dan").replace("\n", "\r\n").encode(), "wide le.ged": text("Eva").encode("utf-16"),
        "wide+be.ged": b"\xfe\xff" + text("Fay").encode("utf-16-be"), "empty.ged": b"\n", "prose.ged": b"no record here\n",
    }
    for name, raw in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    c = gedcom.parse_corpus(spark, str(tmp_path / "in"))
    names = {r.tree_id: r.full for r in c.person.where("person_id = 'I1'").selectExpr("tree_id", "names[0].given as full").collect()}
    assert names == {"x/tree": "Ann", "y/tree": "Bob", "mac": "Cyr", "dos.v1": "Dan", "wide le": "Eva", "wide+be": "Fay"}
    assert {r.notes[0] for r in c.person.where("person_id = 'I1'").select("notes").collect()} == {"a\nb"}
    assert c.person.count() == 12
    hollow = c.warning.where("message like '%no individual and no family%'")
    assert rows(hollow, "tree_id") == [("empty",), ("prose",)]
    one = gedcom.parse_corpus(spark, str(tmp_path / "in" / "x" / "tree.ged"))
    assert rows(one.person, "tree_id", "person_id") == [("tree", "I1"), ("tree", "I2")]
    some = gedcom.parse_corpus(spark, str(tmp_path / "in" / "*" / "tree.ged"))
    assert {r.tree_id for r in some.person.collect()} == {"x/tree", "y/tree"}


def test_a_tree_in_several_parts(spark, tmp_path):
    people = "".join(f"0 @I{i}@ INDI\n1 NAME P{i} /Q/\n" for i in range(50))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.ged").write_text("0 HEAD\n" + people + "0 TRLR\n")
    first = gedcom.parse_corpus(spark, str(tmp_path / "in"))
    folder = tmp_path / "out" / "tree_id=big"
    folder.mkdir(parents=True)
    chunks = ("0 HEAD\n" + people).split("\n0 ")
    for k in range(3):
        part = chunks[k * 20:(k + 1) * 20]
        (folder / f"part-0000{k}.txt").write_text("\n".join(p if p.startswith("0 ") else f"0 {p}" for p in part) + "\n")
    again = gedcom.parse_corpus(spark, str(tmp_path / "out"), tree_from_folder=True)
    order = lambda c: [r.person_id for r in c.person.orderBy("seq").collect()]
    assert order(again) == order(first) == [f"I{i}" for i in range(50)]


def test_place_stream_resolves_each_place_once(spark, tmp_path):
    places = spark.createDataFrame(
        [("boston, ma", "Boston, MA", ["Boston", "MA"]), ("nowhere", "Nowhere", ["Nowhere"]), ("salem, ma", "Salem, MA", ["Salem", "MA"])],
        "place_key string, raw string, parts array<string>",
    )
    places.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    places.where("place_key <> 'nowhere'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.createDataFrame(
        [("massachusetts", 42.0, -71.0, 0.7, "Massachusetts")],
        "query string, lat double, lon double, importance double, resolved_name string",
    )
    seed = spark.createDataFrame([("boston, ma", 1.0, 2.0, None, None)], place_stream.CACHE_SCHEMA)
    stream = spark.readStream.schema(places.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    place_stream.resolve_stream(
        stream, str(tmp_path / "cache"), str(tmp_path / "ckpt"), [geo.ladder_lookup(table, "nominatim")], seed
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "cache"))
    assert rows(got, "place_key", "lat") == [("boston, ma", 1.0), ("salem, ma", 42.0)]


def test_a_repeated_batch_gives_the_same_cache(spark, tmp_path):
    places = spark.createDataFrame([("salem, ma", "Salem, MA", ["Salem", "MA"])], "place_key string, raw string, parts array<string>")
    table = spark.createDataFrame(
        [("massachusetts", 42.0, -71.0, 0.7, "Massachusetts")],
        "query string, lat double, lon double, importance double, resolved_name string",
    )
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("boston, ma", 1.0, 2.0, None, None)], place_stream.CACHE_SCHEMA).write.parquet(f"{cache}/batch_id=-1")
    for _ in range(2):
        place_stream.resolve_batch(places, 0, cache, [geo.ladder_lookup(table, "nominatim")])
        assert rows(spark.read.parquet(cache), "place_key", "lat") == [("boston, ma", 1.0), ("salem, ma", 42.0)]
