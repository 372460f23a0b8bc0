"""Set-based replay against one-edit-at-a-time replay on random logs."""

from __future__ import annotations

import random

import pytest
from brute_replay import replay as brute
from pyspark.sql import functions as F

from kinloom.functions.dates import parse_date
from kinloom.functions.names import parse_names
from kinloom.functions.places import parse_place
from kinloom.operators import edits

FIELDS = [f.split(" ")[0] for f in edits.OP_SCHEMA.replace("array<string>", "a").split(", ")]


def blank(tree: str, seq: int, kind: str, **kw) -> dict:
    op = dict.fromkeys(FIELDS)
    op.update(tree_id=tree, seq=seq, kind=kind, **kw)
    return op


def base_state() -> dict:
    people = {
        f"P{i}": {
            "names": [f"N{i} /S/"], "sex": ["male", "female", "unknown"][i % 3], "notes": [f"n{i % 2}"], "events": [f"E{i}"],
            "fams": [], "famc": None, "merged": [],
        }
        for i in range(8)
    }
    fams = {
        "F0": {"spouses": ["P0", "P1"], "children": ["P2", "P3", "GHOST"], "events": ["M0"]},
        "F1": {"spouses": ["P2", "P4"], "children": ["P5", "P6"], "events": []},
    }
    for fid, f in fams.items():
        for s in f["spouses"]:
            people[s]["fams"].append(fid)
        for c in f["children"]:
            if c in people:
                people[c]["famc"] = fid
    events = {
        f"E{i}": {"type": "birth", "date": str(1900 + i), "place": "Town, State", "text": None, "people": [f"P{i}"]}
        for i in range(8)
    }
    events["M0"] = {"type": "marriage", "date": None, "place": None, "text": None, "people": ["P0", "P1"]}
    return {"people": people, "families": fams, "events": events}


def random_ops(tree: str, rng: random.Random, n: int, merge_weight: int = 4) -> list[dict]:
    people = [f"P{i}" for i in range(10)] + ["GHOST"]
    fams = ["F0", "F1", "F2", "F3"]
    kinds = ["addPerson", "editPerson", "addEvent", "editEvent", "linkRelationship", "linkRelationship", "unlinkRelationship"]
    kinds += ["merge"] * merge_weight
    ops = []
    for seq in range(n):
        k = rng.choice(kinds)
        maybe = lambda: rng.choice([*people, None])
        if k == "merge":
            op = blank(tree, seq, k, keep_id=rng.choice(people), merge_id=rng.choice(people))
        elif k == "addPerson":
            op = blank(tree, seq, k, person_id=rng.choice(people), name_raws=[f"A{seq} /T/"], sex=rng.choice(["male", "unknown"]),
                       notes=rng.choice([None, [f"a{seq}"]]))
        elif k == "editPerson":
            op = blank(tree, seq, k, person_id=rng.choice(people), name_raws=rng.choice([None, [f"E{seq} /U/", "X /Y/"]]),
                       sex=rng.choice([None, "female", "unknown"]), notes=rng.choice([None, [], [f"e{seq}"]]))
        elif k == "addEvent":
            op = blank(tree, seq, k, event_id=f"U{rng.randrange(6)}", event_type="residence",
                       participant_ids=rng.sample(people, 2), date_raw=rng.choice([None, "", "1950"]), place_raw=rng.choice([None, "Here"]),
                       description=rng.choice([None, "d"]), family_id=rng.choice([None, None, *fams]))
        elif k == "editEvent":
            op = blank(tree, seq, k, event_id=rng.choice(["U0", "U1", "U2", "E1", "E2", "M0"]), event_type=rng.choice([None, "census"]),
                       date_set=rng.random() < 0.5, date_raw=rng.choice([None, f"{1800 + seq}"]), place_set=rng.random() < 0.5,
                       place_raw=rng.choice([None, "There"]), description_set=rng.random() < 0.5, description=rng.choice([None, f"t{seq}"]))
        else:
            rel = rng.choice(["parent-child", "spouse"])
            who = {"parent_id": maybe(), "child_id": maybe()} if rel == "parent-child" else {"spouse_a": maybe(), "spouse_b": maybe()}
            op = blank(tree, seq, k, relation=rel, family_id=rng.choice(fams), **who)
        ops.append(op)
    return ops


def base_tables(spark, trees: list[str]) -> edits.Tree:
    s = base_state()
    mk = lambda rows, schema: spark.createDataFrame([(t, *r) for t in trees for r in rows], "tree_id string, " + schema)
    people = s["people"].items()
    person = mk(
        [(p, v["names"], v["sex"], v["notes"], v["famc"]) for p, v in people],
        "person_id string, raws array<string>, sex string, notes array<string>, family_id_as_child string",
    ).withColumn("names", parse_names(F.col("raws"))).withColumn(
        "sources", F.array().cast("array<struct<raw:string,source_id:string,page:string>>")
    ).drop("raws")
    links = lambda role: mk(
        [(f, i, x) for f, v in s["families"].items() for i, x in enumerate(v[role])], "family_id string, ord int, person_id string"
    )
    tags = {"birth": "BIRT", "marriage": "MARR"}
    event = mk(
        [(e, i, v["type"], tags[v["type"]], v["date"], v["place"], v["text"]) for i, (e, v) in enumerate(s["events"].items())],
        "event_id string, seq bigint, type string, raw_tag string, d string, p string, description string",
    ).withColumn("date", parse_date(F.col("d"))).withColumn("place", parse_place(F.col("p"))).drop("d", "p")
    return edits.Tree(
        person,
        mk([(p, i, f) for p, v in people for i, f in enumerate(v["fams"])], "person_id string, ord bigint, family_id string"),
        mk([(f, i) for i, f in enumerate(s["families"])], "family_id string, seq bigint"),
        links("spouses"), links("children"), event,
        mk([(p, i, e) for p, v in people for i, e in enumerate(v["events"])], "person_id string, ord bigint, event_id string"),
        mk([(f, i, e) for f, v in s["families"].items() for i, e in enumerate(v["events"])], "family_id string, ord bigint, event_id string"),
        mk([(e, x, i) for e, v in s["events"].items() for i, x in enumerate(v["people"])], "event_id string, person_id string, pord int"),
    )


def as_state(tree: edits.Tree) -> dict[str, dict]:
    out: dict[str, dict] = {}
    get = lambda t: out.setdefault(t, {"people": {}, "families": {}, "events": {}})
    for r in tree.person.collect():
        get(r.tree_id)["people"][r.person_id] = {
            "names": [n.raw for n in r.names], "sex": r.sex, "notes": list(r.notes), "events": [], "fams": [],
            "famc": r.family_id_as_child, "merged": list(r.merged_from_ids),
        }
    for r in tree.family.collect():
        get(r.tree_id)["families"][r.family_id] = {"spouses": [], "children": [], "events": []}
    for r in tree.event.collect():
        get(r.tree_id)["events"][r.event_id] = {
            "type": r.type, "date": r.date.raw if r.date else None, "place": r.place.raw if r.place else None,
            "text": r.description, "people": [],
        }
    for rows, part, key, field, value in (
        (tree.family_spouse, "families", "family_id", "spouses", "person_id"),
        (tree.family_child, "families", "family_id", "children", "person_id"),
        (tree.family_event, "families", "family_id", "events", "event_id"),
        (tree.person_fams, "people", "person_id", "fams", "family_id"),
        (tree.person_event, "people", "person_id", "events", "event_id"),
    ):
        for r in sorted(rows.collect(), key=lambda r: list(r.ord)):
            get(r.tree_id)[part][r[key]][field].append(r[value])
    for r in sorted(tree.event_participant.collect(), key=lambda r: r.pord):
        get(r.tree_id)["events"][r.event_id]["people"].append(r.person_id)
    return out


def same(want: dict, got: dict) -> None:
    assert got["people"].keys() == want["people"].keys()
    for p, v in want["people"].items():
        assert got["people"][p] == v, p
    assert got["families"] == want["families"]
    for e, v in want["events"].items():
        have = got["events"][e]
        # Two participants may share a place in the list after a merge.
        assert sorted(have.pop("people")) == sorted(v.pop("people")), e
        assert have == v, e


@pytest.mark.parametrize("merge_weight", [2, 8])
def test_replay_matches_one_by_one(spark, merge_weight):
    trees = [f"T{i}" for i in range(26)]
    logs = {t: random_ops(t, random.Random(100 * merge_weight + i), 12 + i, merge_weight) for i, t in enumerate(trees)}
    logs["T25"] = [  # a pointer that a merge brought does not come back with a new person of the same id
        blank("T25", 0, "merge", keep_id="P1", merge_id="P6"), blank("T25", 1, "merge", keep_id="P5", merge_id="P1"),
        blank("T25", 2, "addPerson", person_id="P1", name_raws=["New /P/"], sex="male")]
    rows = [tuple(op[f] for f in FIELDS) for ops in logs.values() for op in ops]
    result = edits.replay(base_tables(spark, trees), spark.createDataFrame(rows, edits.OP_SCHEMA))
    got = as_state(result)
    for t in trees:
        same(brute(base_state(), logs[t]), got[t])
