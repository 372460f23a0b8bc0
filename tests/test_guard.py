"""Refused links against a one-edit-at-a-time guard."""

from __future__ import annotations

import copy
import random

from brute_replay import apply
from test_edits import FIELDS, base_state, base_tables, blank, random_ops

from kinloom.operators import edits, guard


def ancestors(state: dict, person: str) -> set[str]:
    people, out, todo = state["people"], set(), [person]
    while todo:
        x = todo.pop()
        up = {p for f in state["families"].values() if x in f["children"] for p in f["spouses"] if p in people and p != x}
        todo += up - out
        out |= up
    return out


def brute(ops: list[dict]) -> dict[int, str]:
    state, out = copy.deepcopy(base_state()), {}
    for op in ops:
        people = state["people"]
        ends = (op["parent_id"], op["child_id"]) if op["relation"] == "parent-child" else (op["spouse_a"], op["spouse_b"])
        if op["kind"] == "linkRelationship" and all(x in people for x in ends):
            a, b = ((people[x]["names"] or [x])[0].replace("/", "").strip() for x in ends)
            if ends[0] == ends[1]:
                out[op["seq"]] = f"{a} cannot be " + ("married to themselves." if op["relation"] == "spouse" else "their own parent.")
            elif op["relation"] == "parent-child" and ends[1] in ancestors(state, ends[0]):
                out[op["seq"]] = f"{a} is already a descendant of {b}, so this would make {b} their own ancestor."
            if op["seq"] in out:
                continue
        apply(state, op)
    return out


def link(seq: int, parent: str, child: str, family: str) -> dict:
    return blank("T", seq, "linkRelationship", relation="parent-child", parent_id=parent, child_id=child, family_id=family)


def refused(spark, logs: dict[str, list[dict]]) -> dict[str, dict[int, str]]:
    rows = [tuple(op[f] for f in FIELDS) for ops in logs.values() for op in ops]
    got = guard.blocked_links(base_tables(spark, list(logs)), spark.createDataFrame(rows, edits.OP_SCHEMA)).collect()
    out: dict[str, dict[int, str]] = {t: {} for t in logs}
    for r in got:
        assert r.seq not in out[r.tree_id]
        out[r.tree_id][r.seq] = r.message
    return out


# P0 and P1 are the parents of P2 and P3, P2 and P4 of P5 and P6.
CASES = {
    "two links close a loop together": ([link(0, "P6", "P7", "F2"), link(1, "P7", "P0", "F3"), link(2, "P7", "P4", "F3")], {1, 2}),
    "a refused link does not count": ([link(0, "P5", "P0", "F2"), link(1, "P0", "P7", "F3"), link(2, "P7", "P5", "F4"), link(3, "P5", "P7", "F5")], {0, 3}),
    "lawful after an unlink": ([blank("T", 0, "unlinkRelationship", relation="parent-child", family_id="F0", child_id="P2"), link(1, "P5", "P0", "F2")], set()),
    "a merge brings people together": ([blank("T", 0, "merge", keep_id="P7", merge_id="P5"), link(1, "P7", "P0", "F2"), link(2, "P5", "P0", "F2")], {1}),
    "nobody there": ([link(0, "P9", "P0", "F2"), link(1, "P0", "GHOST", "F2"), link(2, "GHOST", "P0", "F3")], set()),
    "a person added later": ([blank("T", 0, "addPerson", person_id="GHOST", name_raws=["G /H/"], sex="male"), link(1, "GHOST", "P0", "F3")], {1}),
    "oneself": ([link(0, "P0", "P0", "F2"), blank("T", 1, "linkRelationship", relation="spouse", spouse_a="P1", spouse_b="P1", family_id="F4")], {0, 1}),
    "names of that moment": ([link(0, "P5", "P0", "F2"), blank("T", 1, "editPerson", person_id="P0", name_raws=["New /Name/"]), link(2, "P5", "P0", "F2")], {0, 2}),
}


def test_cases_by_hand(spark):
    logs = {}
    for name, (ops, _) in CASES.items():
        logs[name] = [{**op, "tree_id": name} for op in ops]
    got = refused(spark, logs)
    for name, (ops, want) in CASES.items():
        assert set(got[name]) == want, name
        assert got[name] == brute(ops), name


def test_random_logs(spark):
    rnd, logs = random.Random(8), {}
    for i in range(60):
        ops = random_ops(f"T{i}", random.Random(31 + i), 30 + i % 40, (1, 3, 8)[i % 3])
        for op in ops:  # more links between parents and children
            if op["kind"] in ("addEvent", "editEvent"):
                op.update(blank(op["tree_id"], op["seq"], "linkRelationship", relation="parent-child", family_id=rnd.choice(["F0", "F1", "F2", "F3"]),
                                parent_id=f"P{rnd.randrange(10)}", child_id=f"P{rnd.randrange(10)}"))
        logs[f"T{i}"] = ops
    got = refused(spark, logs)
    for t, ops in logs.items():
        assert got[t] == brute(ops), t
    assert sum(map(len, got.values())) > 100
