"""Paths and lines made block by block, against the operators that join and sort them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinloom.operators import blocks, closure, lineage, paths, research
from kinloom.operators.blocks import Block
from tests.test_graph import PARENTS, bends, diamonds, random_dag, table

PAIRS = "tree_id string, from_id string, to_id string"


def _trees(seed: int, people: int = 9, links: int = 14):
    rng = random.Random(seed)
    trees = {f"T{n}": random_dag(rng, people, links) for n in range(3)}
    trees["LOOP"] = [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("E", "A"), ("E", "B")]
    who = {t: sorted({x for e in edges for x in e}) for t, edges in trees.items()}
    return trees, [(t, a, b) for t, some in who.items() for a in some for b in some]


@pytest.fixture
def written(monkeypatch):
    """Rows of each table that is written on the way."""
    rows, real = [], lineage.cut

    def cut(df, *metrics):
        out = real(df, *metrics)
        rows.append(out[1]["rows"])
        return out

    for module in (blocks, paths, research, closure):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    return rows


def test_every_path_as_a_search_finds_them(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PAIRS", 7)
    trees, asked = _trees(3)
    parents, pairs = table(spark, trees), spark.createDataFrame(asked, PAIRS)
    for climbs in (blocks.CLIMBS, 2):  # listed at once, and walked one by one
        for tree, a, b in asked:
            block = Block()
            for i, (c, p) in enumerate(trees[tree]):
                block.links.append((block.number(c), block.number(p), i, 0, 0))
            block.close()
            if not block.looped:
                block.climbs = [x if x <= climbs else blocks.CLIMBS + 1 for x in block.climbs]
            s, t = block.number(a), block.number(b)
            n, pieces = block.paths(s, t) if a != b else (0, [])
            got = [tuple(block.ids[x] for x in p) for size, flat, _ in pieces for p in _split(flat.tolist(), size.tolist())]
            assert got == bends(trees[tree], a, b) and n == len(got)
    found = {}
    for r in paths.relationship_paths(parents, pairs, None).collect():
        found.setdefault((r.tree_id, r.from_id, r.to_id), []).append((r.path_no, tuple(r.steps), r.length, r.path_count))
    for key in asked:
        want = bends(trees[key[0]], *key[1:])
        assert sorted(found.get(key, [])) == [(i, p, len(p) - 1, len(want)) for i, p in enumerate(want, 1)]


def _split(flat, sizes):
    at = 0
    for n in sizes:
        yield flat[at:at + n]
        at += n


def test_first_paths_and_large_blocks(spark, monkeypatch):
    trees, asked = _trees(5)
    parents, pairs = table(spark, trees), spark.createDataFrame(asked, PAIRS)
    want = {(*key, i): (p, len(bends(trees[key[0]], *key[1:]))) for key in asked for i, p in enumerate(bends(trees[key[0]], *key[1:])[:2], 1)}
    for large in (blocks.LARGE, 3):  # in blocks, and where people have too many ancestors for that
        monkeypatch.setattr(blocks, "LARGE", large)
        got = {(r.tree_id, r.from_id, r.to_id, r.path_no): (tuple(r.steps), int(r.path_count)) for r in paths.relationship_paths(parents, pairs, 2).collect()}
        assert got == want


def test_paths_are_not_written(spark, written):
    """Before, all 2 ** 10 paths were written, sorted by pair and joined with their number."""
    found = paths.relationship_paths(table(spark, {"T": diamonds(10)}), spark.createDataFrame([("T", "D0", "D10")], PAIRS), None)
    assert found.count() == 1024 and sum(written) < 300
    assert {r.path_count for r in found.select("path_count").distinct().collect()} == {1024}


def test_highlights_need_no_path(spark):
    """2 ** 40 paths were listed before."""
    nodes, edges = paths.highlights(table(spark, {"T": diamonds(40) + [("Q", "D0"), ("D3", "L9")]}), spark.createDataFrame([("T", "D0", "D40"), ("T", "Q", "Q")], PAIRS))
    assert nodes.count() == 41 + 80 and edges.count() == 2 * 161


def test_highlights_and_listing_as_over_the_paths(spark):
    trees, asked = _trees(8)
    trees["TIE"] = []
    tie = spark.createDataFrame([("TIE", p, c, "F", 1, 0, 0) for p in ("P", "Q") for c in ("A", "B")], PARENTS)
    parents = table(spark, trees).unionByName(tie)
    pairs = spark.createDataFrame([*asked, ("TIE", "A", "B")], PAIRS)
    listed = paths._every_path(parents, pairs)
    for got, want in zip(paths.highlights(parents, pairs), paths.path_highlights(listed), strict=True):
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))
    names = spark.createDataFrame(
        [("T0", "P1", "One"), ("T0", "P1", "Another"), ("T0", "P2", ""), ("T1", "P3", None), ("LOOP", "A", "Ann"), ("TIE", "P", "Pa")],
        "tree_id string, person_id string, name string")
    got, want = paths.names_on_paths(parents, pairs, names), paths.path_listing(listed, names)
    keep = lambda df: Counter(tuple(r) for r in df.where("tree_id <> 'TIE'").collect())
    assert keep(got) == keep(want.select(*got.columns)) and got.where("tree_id = 'TIE'").count() == 2


def _facts(spark, rng, people):
    rows = []
    for tree, who in people:
        for n in range(rng.randrange(4)):
            place = rng.choice(["", "ohio", "kent", "york"])
            rows.append((tree, who, rng.choice([who.lower(), None]), f"{who}-{n}", rng.choice(["birth", "census"]), rng.choice(["ABT 1800", None]),
                         rng.choice([1800, 1810, None]), place, f"{place}!{rng.randrange(2)}" if place else research.UNKNOWN_PLACE, rng.choice(["sourced", "unsourced"])))
        if rng.random() < 0.5:
            rows.append((tree, who, who.lower(), None, "death", None, None, "", research.NO_RECORD, "none"))
    return spark.createDataFrame(rows, "tree_id string, person_id string, person_name string, event_id string, type string, date_raw string, year int, "
                                       "place_key string, place_label string, status string")


def test_places_and_plans_of_lines(spark, monkeypatch, written):
    """No row of a person and a line, and no line of text, is written or sorted."""
    monkeypatch.setattr(research, "LINES", 11)
    trees, asked = _trees(11)
    parents = table(spark, trees)
    lines = spark.createDataFrame([*asked, ("T0", "GHOST", "GHOST"), ("T0", "P1", "GHOST"), (None, "P1", "P2")], "tree_id string, focal_id string, ancestor_id string")
    everybody = lines.where("tree_id is not null").select("tree_id", "focal_id").distinct()
    facts = _facts(spark, random.Random(2), sorted({(t, a) for t, a, _ in asked} | {("T0", "GHOST")})).localCheckpoint()
    titles = lines.withColumn("title", F.concat_ws(" to ", "focal_id", "ancestor_id"))
    places, plan = research.locality_of_lines(parents, lines, facts), research.plan_of_lines(parents, titles, facts)
    rows = lambda df, like: Counter(tuple(r) for r in df.select(*like.columns).collect())
    got = rows(places, places), rows(plan, plan)
    assert max(written) <= len(asked) + 3  # the lines themselves
    on_line = research.people_on_line(closure.closure(parents, everybody), lines).localCheckpoint()
    assert got[0] == rows(research.locality_rows(on_line, facts), places)
    assert got[1] == rows(research.markdown_lines(on_line, facts, titles), plan)


def test_maintained_closure_in_few_tables(spark, monkeypatch):
    """Every three generations above a change took two tables more before."""
    from kinloom.operators import maintain

    trees, _ = _trees(21, 12, 18)
    trees["LONG"] = [(f"L{i:02}", f"L{i + 1:02}") for i in range(30)]
    old = table(spark, trees)
    rng = random.Random(4)
    after = {t: [e for e in edges if rng.random() < 0.8] + [(edges[0][0], edges[-1][1]), (edges[-1][1], edges[1][0])] for t, edges in trees.items()}
    after["LONG"] = trees["LONG"][1:] + [("L00", "L05"), ("L00", "NEW")]
    new = table(spark, {t: sorted({e for e in edges if e[0] != e[1]}) for t, edges in after.items()})
    who = {(t, x) for part in (trees, after) for t, edges in part.items() for e in edges for x in e}
    focals = spark.createDataFrame(sorted(who), "tree_id string, focal_id string")
    closed = closure.closure(old, focals).localCheckpoint()
    added, removed = maintain.link_changes(old, new)
    made, real = [], lineage.cut
    for module in (maintain, blocks):
        monkeypatch.setattr(module, "cut", lambda df, *m: made.append(1) or real(df, *m))
    got = Counter(map(tuple, maintain.maintained(closed, new, added, removed).collect()))
    assert got == Counter(map(tuple, closure.closure(new, focals).select("tree_id", "focal_id", "person_id", "min_depth").collect()))
    assert len(made) <= 14
    assert Counter(map(tuple, blocks.ancestors(old, focals).collect())) == Counter(map(tuple, closed.select("tree_id", "focal_id", "person_id", "min_depth").collect()))
