"""Work that is left out where nothing asks for it, and rows that are made once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_edits import FIELDS, base_tables, blank

from kinloom.functions.places import parse_place
from kinloom.operators import edits, events, guard
from kinloom.sources import gedcom, sinks

TEXT = """0 HEAD
0 @I1@ INDI
1 NAME Ann /Lee/
1 NOTE first
2 CONC  part
2 cont second
1 BIRT
2 DATE 1 JAN 1800
2 PLAC Concord, MA
0 @I2@ INDI
1 NAME Bob /Lee/
1 BIRT
2 PLAC CONCORD,  ma
0 @F1@ FAM
1 HUSB @I2@
1 CHIL @I1@
0 TRLR
"""


def test_people_and_families_parse_no_events(spark, tmp_path):
    (tmp_path / "a.ged").write_text(TEXT)
    c = gedcom.parse_corpus(spark, str(tmp_path))
    assert {r.person_id: r.notes for r in c.person.collect()} == {"I1": ["first part\nsecond"], "I2": []}
    assert (c.family_spouse.count(), c.family_child.count(), c.person_fams.count()) == (1, 1, 0)
    assert "event" not in vars(c)
    assert {r.event_id: r.place.raw for r in c.event.collect()} == {"I1-BIRT-0": "Concord, MA", "I2-BIRT-0": "Concord, MA"}


def test_places_are_parsed_once_per_spelling(spark):
    raws = ["Paris, Bourbon, KY", "PARIS,  Bourbon,  ky", "paris , bourbon , ky", "Ohio", "", ", ,", None, "OHIO"]
    rows = [(f"T{i % 3}", f"e{i}", 1000 - i * 7 % 101, raws[i % len(raws)]) for i in range(100)] + [(None, "x", 1, "Ohio"), ("T1", "y", None, "Rome")]
    raw = spark.createDataFrame(rows, "tree_id string, event_id string, seq bigint, place_raw string")
    want = events.intern_places(raw.withColumn("place", parse_place(F.col("place_raw"))))
    got = events.with_places(raw)
    shown = lambda df: sorted(map(str, df.select("tree_id", "event_id", "seq", "place_raw", "place").collect()))
    assert shown(got) == shown(want)


def test_event_lists_need_no_parsed_event(spark):
    base = base_tables(spark, ["T"])
    ids = base.event.select("tree_id", "event_id")

    class Unparsed(edits.Tree):
        def __init__(self):
            vars(self).update({k: v for k, v in vars(base).items() if k != "event"})

        event_ids = property(lambda self: ids)

        @property
        def event(self):
            raise AssertionError("events are parsed")

    ops = [blank("T", 0, "merge", keep_id="P0", merge_id="P1"), blank("T", 1, "addEvent", event_id="E", event_type="census", participant_ids=["P0", "P2"])]
    op = spark.createDataFrame([tuple(x[f] for f in FIELDS) for x in ops], edits.OP_SCHEMA)
    lists = lambda run: sorted(map(str, run.person_event.collect()))
    full = edits.Replay(base, op)
    assert lists(edits.Replay(Unparsed(), op)) == lists(full) == sorted(map(str, full.events[1].collect()))
    with pytest.raises(AssertionError):
        _ = edits.Replay(Unparsed(), op).event


def test_marked_lines_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    rows = [(f"T{i % 5}", 0, i, 0, 0, 0, f"0 @I{i}@ INDI") for i in range(200)]
    lines = spark.createDataFrame(rows, "tree_id string, section int, seq bigint, block int, ord bigint, pos int, text string")
    lines = lines.withColumn("text", F.udf(count, "string")("text")).withColumn("tree_id", F.when(F.col("text") != "", F.col("tree_id")))
    sinks.write_marked(lines, str(tmp_path / "out"), 4)
    assert made.value == 200
    assert gedcom.parse_corpus(spark, str(tmp_path / "out"), bundled=True).person.count() == 200


def test_settled_people_are_not_looked_at_again(spark, monkeypatch):
    people = [f"P{i}" for i in range(40)]
    person = spark.createDataFrame([("T", p) for p in people], "tree_id string, person_id string")
    ops = [blank("T", i, "merge", keep_id=f"P{i + 1}", merge_id=f"P{i}") for i in range(4)] + [
        blank("T", 9, "addPerson", person_id="P0"), blank("T", 10, "merge", keep_id="P0", merge_id="P5")]
    op = spark.createDataFrame([tuple(x[f] for f in FIELDS) for x in ops], edits.OP_SCHEMA)
    written, cut = [], edits.cut

    def counted(df, *metrics):
        out = cut(df, *metrics)
        written.append(out[1]["rows"])
        return out

    monkeypatch.setattr(edits, "cut", counted)
    life = edits.lifecycles(person, op).collect()
    assert sorted((r.id, r.from_seq, r.to_seq, r.into_id) for r in life) == sorted(
        [(f"P{i}", -1, i, f"P{i + 1}") for i in range(4)] + [("P5", -1, 10, "P0"), ("P0", 9, edits.FAR, None)]
        + [(p, -1, edits.FAR, None) for p in people[4:] if p != "P5"])
    assert sum(n >= 40 for n in written) == 3  # all added people, the first look at them, the outcome


def test_lawful_replay_settles_who_exists_once(spark, monkeypatch):
    calls, lifecycles = [], edits.lifecycles
    monkeypatch.setattr(edits, "lifecycles", lambda *a: calls.append(1) or lifecycles(*a))
    base = base_tables(spark, ["T"])
    ops = [blank("T", 0, "linkRelationship", relation="parent-child", parent_id="P5", child_id="P0", family_id="F2"),
           blank("T", 1, "merge", keep_id="P7", merge_id="P6")]
    op = spark.createDataFrame([tuple(x[f] for f in FIELDS) for x in ops], edits.OP_SCHEMA)
    run = guard.lawful_replay(base, op)
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(run.child_spans) + rows(run.spouse_spans)
    assert len(calls) == 1
    again = edits.Replay(base, guard.lawful_log(base, op))
    assert got == rows(again.child_spans) + rows(again.spouse_spans)
