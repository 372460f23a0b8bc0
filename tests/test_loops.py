"""Counts through ancestry loops and closures kept up to date, against depth-first search and full closures."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from kinloom.operators import closure, loops, maintain
from tests.test_graph import climb, diamonds, random_dag, table


def everybody(spark, trees):
    people = {(t, x) for t, edges in trees.items() for edge in edges for x in edge}
    return spark.createDataFrame(sorted(people), "tree_id string, focal_id string")


def counted(rows):
    return {(r.tree_id, r.focal_id, r.node, r.depth): r.paths for r in rows.collect()}


def wanted(trees):
    out = Counter()
    for t, edges in trees.items():
        for start in {x for edge in edges for x in edge}:
            for tip, trails in climb(edges, start).items():
                out.update((t, start, tip, len(trail) - 1) for trail in trails)
    return dict(out)


def test_counts_on_looped_trees_match_depth_first_search(spark):
    rng = random.Random(3)
    trees = {"two": [("A", "B"), ("B", "A"), ("A", "C"), ("C", "D"), ("D", "C"), ("B", "D"), ("D", "E"), ("Z", "A")],
             "self": [("A", "A"), ("A", "B")]}
    for i in range(6):
        people = [f"P{n}" for n in range(9)]
        edges = {tuple(rng.sample(people, 2)) for _ in range(8 + i)}
        trees[f"R{i}"] = sorted(edges)
    parents = table(spark, trees)
    assert counted(loops.looped_path_counts(parents, everybody(spark, trees))) == wanted(trees)


def test_knots_are_the_mutual_ancestors(spark):
    rng = random.Random(5)
    trees = {f"R{i}": sorted({tuple(rng.sample([f"P{n}" for n in range(14)], 2)) for _ in range(20)}) for i in range(4)}
    got = {(r.tree_id, r.person_id): r.knot_id for r in loops.knots(table(spark, trees)).collect()}
    for t, edges in trees.items():
        above = {x: set(climb(edges, x)) for edge in edges for x in edge}
        for x in above:
            mates = {y for y in above[x] if x in above[y]}
            assert ((t, x) in got) == bool(mates)
            if mates:
                assert got[t, x] == max(mates | {x})


def test_a_loop_on_forty_diamonds(spark):
    loop = [("D40", "X"), ("X", "Y"), ("Y", "D40"), ("Y", "TOP")]
    parents = table(spark, {"T": diamonds(40) + loop})
    focals = spark.createDataFrame([("T", "D0")], "tree_id string, focal_id string")
    got = {r.ancestor_id: r.paths for r in closure.path_counts(parents, focals).where("ancestor_id in ('D40', 'X', 'Y', 'TOP', 'D3')").collect()}
    assert got == {"D40": 2**40, "X": 2**40, "Y": 2**40, "TOP": 2**40, "D3": 2**3}


def test_maintained_closure_equals_the_full_one(spark):
    rng = random.Random(1)
    before, after = {}, {}
    for i in range(15):
        people = [f"P{n}" for n in range(12)]
        old = random_dag(rng, 12, 18) if i % 2 else sorted({tuple(rng.sample(people, 2)) for _ in range(18)})
        gone = set(rng.sample(old, min(len(old), [0, 1, 3, 6, 18][i % 5])))
        new = {tuple(rng.sample(people, 2)) for _ in range([4, 0, 3, 5, 2][i % 5])}
        before[f"T{i}"], after[f"T{i}"] = old, sorted((set(old) - gone) | new)
    before["gone"], after["come"] = [("A", "B")], [("A", "B"), ("B", "A")]
    old, new = table(spark, before), table(spark, after)
    closed = closure.closure(old, everybody(spark, before))
    added, removed = maintain.link_changes(old, new)
    got = maintain.maintained(closed, new, added, removed).collect()
    full = closure.closure(new, everybody(spark, after)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, full))


def test_nothing_changes_without_changes(spark):
    trees = {"T": diamonds(3)}
    links = table(spark, trees)
    closed = closure.closure(links, everybody(spark, trees))
    none = links.where(F.lit(False))
    got = maintain.maintained(closed, links, none, none).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, closed.collect()))
