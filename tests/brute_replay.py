"""One-edit-at-a-time replay on dictionaries, the yardstick for the set-based one."""

from __future__ import annotations

import copy


def add_once(items: list, value) -> None:
    if value not in items:
        items.append(value)


def union(a: list, b: list) -> list:
    out: list = []
    for v in [*a, *b]:
        add_once(out, v)
    return out


def fold_person(state: dict, op: dict) -> None:
    people, fams = state["people"], state["families"]
    into, gone = op["keep_id"], op["merge_id"]
    if into == gone or into not in people or gone not in people:
        return
    a, b = people[into], people.pop(gone)
    names, seen = list(a["names"]), set(a["names"])
    for n in b["names"]:
        if n not in seen:
            seen.add(n)
            names.append(n)
    a["names"] = names
    a["sex"] = a["sex"] if a["sex"] != "unknown" else b["sex"]
    for field in ("events", "fams", "notes"):
        a[field] = union(a[field], b[field])
    a["merged"] = union(a["merged"], [gone, *b["merged"]])
    a["famc"] = a["famc"] if a["famc"] is not None else b["famc"]
    for f in fams.values():
        if gone in f["spouses"] or gone in f["children"]:
            for role in ("spouses", "children"):
                f[role] = union([], [into if x == gone else x for x in f[role]])
            if into in f["spouses"]:
                f["children"] = [c for c in f["children"] if c != into]
    if a["famc"] in fams and into in fams[a["famc"]]["spouses"]:
        a["famc"] = None
    for e in state["events"].values():
        if gone in e["people"]:
            e["people"] = union([], [into if x == gone else x for x in e["people"]])


def apply(state: dict, op: dict) -> None:
    people, fams, events = state["people"], state["families"], state["events"]
    kind = op["kind"]
    if kind == "merge":
        fold_person(state, op)
    elif kind == "addPerson" and op["person_id"] not in people:
        people[op["person_id"]] = {
            "names": list(op["name_raws"]), "sex": op["sex"], "notes": list(op["notes"] or []), "events": [],
            "fams": [], "famc": None, "merged": [],
        }
    elif kind == "editPerson" and op["person_id"] in people:
        p = people[op["person_id"]]
        if op["name_raws"] is not None:
            p["names"] = list(op["name_raws"])
        if op["sex"] is not None:
            p["sex"] = op["sex"]
        if op["notes"] is not None:
            p["notes"] = list(op["notes"])
    elif kind == "addEvent" and op["event_id"] not in events:
        who = [x for x in op["participant_ids"] if x in people]
        events[op["event_id"]] = {
            "type": op["event_type"], "date": op["date_raw"] or None, "place": op["place_raw"] or None,
            "text": op["description"] or None, "people": union([], who),
        }
        if op["family_id"]:
            if op["family_id"] in fams:
                add_once(fams[op["family_id"]]["events"], op["event_id"])
        else:
            for x in who:
                add_once(people[x]["events"], op["event_id"])
    elif kind == "editEvent" and op["event_id"] in events:
        e = events[op["event_id"]]
        if op["event_type"] is not None:
            e["type"] = op["event_type"]
        if op["date_set"]:
            e["date"] = op["date_raw"]
        if op["place_set"]:
            e["place"] = op["place_raw"]
        if op["description_set"]:
            e["text"] = op["description"]
    elif kind == "linkRelationship":
        parent_child = op["relation"] == "parent-child"
        pair = [op["parent_id"]] if parent_child else [op["spouse_a"], op["spouse_b"]]
        spouses = [x for x in pair if x in people]
        child = op["child_id"] if parent_child and op["child_id"] in people else None
        if not spouses and child is None:
            return
        f = fams.setdefault(op["family_id"], {"spouses": [], "children": [], "events": []})
        for x in spouses:
            add_once(f["spouses"], x)
            add_once(people[x]["fams"], op["family_id"])
        if child is not None:
            add_once(f["children"], child)
            people[child]["famc"] = op["family_id"]
    elif kind == "unlinkRelationship" and op["family_id"] in fams:
        f, fid = fams[op["family_id"]], op["family_id"]
        parent_child = op["relation"] == "parent-child"
        out = [op["parent_id"]] if parent_child else [op["spouse_a"], op["spouse_b"]]
        for x in out:
            if x is not None:
                f["spouses"] = [s for s in f["spouses"] if s != x]
                if x in people:
                    people[x]["fams"] = [g for g in people[x]["fams"] if g != fid]
        if parent_child and op["child_id"] is not None:
            f["children"] = [c for c in f["children"] if c != op["child_id"]]
            p = people.get(op["child_id"])
            if p and p["famc"] == fid:
                p["famc"] = None


def replay(state: dict, ops: list[dict]) -> dict:
    state = copy.deepcopy(state)
    for op in sorted(ops, key=lambda o: o["seq"]):
        apply(state, op)
    return state
