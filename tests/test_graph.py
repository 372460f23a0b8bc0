"""Paths, collapse and kinship against depth-first search on small graphs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinloom.operators import closure, first_paths, kinship, paths, quality, research, society
from kinloom.operators.numbering import number_rows

PARENTS = "tree_id string, parent_id string, child_id string, family_id string, fseq bigint, pord int, cord int"


def table(spark, trees: dict[str, list[tuple[str, str]]]):
    """Edges (child, parent) per tree, in file order."""
    rows = [(t, p, c, f"F{i}", i, 0, 0) for t, edges in trees.items() for i, (c, p) in enumerate(edges)]
    return spark.createDataFrame(rows, PARENTS)


def adjacency(edges):
    up, down = {}, {}
    for c, p in edges:
        up.setdefault(c, []).append(p)
        down.setdefault(p, []).append(c)
    return up, down


def climb(edges, start):
    """All upward paths per ancestor in depth-first order."""
    up, found = adjacency(edges)[0], {}

    def go(trail):
        if len(trail) > 1:
            found.setdefault(trail[-1], []).append(tuple(trail))
        for p in up.get(trail[-1], []):
            if p not in trail:
                go([*trail, p])

    go([start])
    return found


def bends(edges, a, b):
    """All paths up and then down again, in depth-first order."""
    up, down = adjacency(edges)
    out = []

    def go(trail, rising):
        if trail[-1] == b:
            out.append(tuple(trail))
            return
        if rising:
            for p in up.get(trail[-1], []):
                if p not in trail:
                    go([*trail, p], True)
        for c in down.get(trail[-1], []):
            if c not in trail:
                go([*trail, c], False)

    if a != b:
        go([a], True)
    return out


def random_dag(rng, people, links):
    edges = set()
    while len(edges) < links:
        a, b = rng.sample(range(people), 2)
        edges.add((f"P{max(a, b)}", f"P{min(a, b)}"))
    return sorted(edges, key=lambda _: rng.random())


def diamonds(n):
    """n diamonds on top of each other: 2 ** n paths from D0 to Dn, each 2 * n steps long."""
    return [
        (c, p) for i in range(n)
        for c, p in ((f"D{i}", f"L{i}"), (f"D{i}", f"R{i}"), (f"L{i}", f"D{i + 1}"), (f"R{i}", f"D{i + 1}"))
    ]


def lines_of(spark, *rows):
    return spark.createDataFrame([("T", *r) for r in rows], "tree_id string, focal_id string, ancestor_id string")


def test_three_diamonds(spark):
    parents = table(spark, {"T": diamonds(3)})
    lines = lines_of(spark, ("D0", "D3"))
    for first in (None, 5):
        got = paths.ancestral_paths(parents, lines, first).collect()
        assert len(got) == min(8, first or 8) and {r.path_count for r in got} == {8}
    found = {r.ancestor_id: (r.path_count, r.min_length) for r in paths.pedigree_collapse(parents, lines.select("tree_id", "focal_id")).collect()}
    assert found == {"D1": (2, 2), "D2": (4, 4), "D3": (8, 6), **{f"{s}{i}": (2**i, 2 * i + 1) for s in "LR" for i in (1, 2)}}


def test_thirty_generations_and_a_billion_paths(spark):
    """Counts, lines and checklists need no path."""
    parents = table(spark, {"T": diamonds(30)})
    lines = lines_of(spark, ("D0", "D30"))
    focal = lines.select("tree_id", "focal_id")
    top = {r.ancestor_id: (r.path_count, r.min_length) for r in paths.pedigree_collapse(parents, focal).collect()}
    assert top["D30"] == (2**30, 60) and len(top) == 30 + 2 * 29
    everybody = spark.createDataFrame(
        [("T", f"{k}{i}") for k in "DLR" for i in range(31)], "tree_id string, focal_id string")
    above = closure.closure(parents, everybody).cache()
    on_line = research.people_on_line(above, lines)
    assert on_line.count() == 91
    links = society.checklist_links(parents, on_line).collect()
    assert len(links) == 120 and max(r.generation for r in links) == 60 and {r.link_no for r in links} == set(range(1, 121))
    assert [r.reachable for r in society.reachability(lines, on_line).collect()] == [True]


def test_first_paths_of_many(spark):
    """No path beyond the first five is built."""
    edges = diamonds(6) + [("D6", "TOP"), ("Z", "TOP")] + [("X", "D0"), ("X", "R0")]
    parents = table(spark, {"T": edges, "LOOP": [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]})
    pairs = spark.createDataFrame(
        [("T", "D0", "D6"), ("T", "D6", "D0"), ("T", "D0", "GHOST"), ("T", "Z", "X"), ("T", "L3", "R3"), ("LOOP", "D", "B")],
        "tree_id string, from_id string, to_id string")
    got, count = {}, {}
    for r in paths.relationship_paths(parents, pairs, 5).collect():
        got.setdefault((r.tree_id, r.from_id, r.to_id), []).append((r.path_no, r.steps, r.length))
        count[r.tree_id, r.from_id, r.to_id] = r.path_count
    # X reaches all above D1 by either parent, by R0 itself in half as many ways
    assert count == {("T", "D0", "D6"): 64, ("T", "D6", "D0"): 64, ("T", "Z", "X"): 64 + 32, ("T", "L3", "R3"): 1, ("LOOP", "D", "B"): 2}
    assert all(len(v) == min(5, count[k]) for k, v in got.items())
    up = sorted(got["T", "D0", "D6"])
    assert up[0][1] == [s for i in range(6) for s in (f"D{i}", f"L{i}")] + ["D6"] and up[0][2] == 12
    turns = ["".join(x[0] for x in steps if x[0] in "LR")[-3:] for _, steps, _ in up]
    assert turns == ["LLL", "LLR", "LRL", "LRR", "RLL"]


def test_a_billion_paths_are_counted_by_pairs_of_people(spark):
    parents = table(spark, {"T": diamonds(30)})
    pairs = spark.createDataFrame([("T", "D0", "D30")], "tree_id string, from_id string, to_id string")
    high = first_paths.heights(parents)
    found = first_paths.pair_counts(first_paths._steps(parents, high), high, pairs)
    assert [r.n for r in found.where("u = 'D0' AND v = 'D30'").collect()] == [2**30]


def test_more_than_two_hundred_paths_are_listed(spark):
    parents = table(spark, {"T": diamonds(8)})
    lines = lines_of(spark, ("D0", "D8"))
    listed = paths.ancestral_paths(parents, lines, None).collect()
    assert sorted(r.path_no for r in listed) == list(range(1, 257)) and {r.path_count for r in listed} == {256}
    first = paths.ancestral_paths(parents, lines, 7).collect()
    assert {r.path_no: r.steps for r in first} == {r.path_no: r.steps for r in listed if r.path_no <= 7}
    pairs = lines.select("tree_id", F.col("focal_id").alias("from_id"), F.col("ancestor_id").alias("to_id"))
    bent = paths.relationship_paths(parents, pairs, 3).collect()
    assert len(bent) == 3 and {r.path_count for r in bent} == {256}


def test_a_distant_relation_is_found(spark):
    """Twenty generations up and twenty down."""
    edges = [(f"{s}{i}", f"{s}{i + 1}" if i < 19 else "TOP") for s in "AB" for i in range(20)]
    parents = table(spark, {"T": edges})
    pairs = spark.createDataFrame([("T", "A0", "B0"), ("T", "A0", "A19")], "tree_id string, from_id string, to_id string")
    assert {r.to_id: r.distance for r in kinship.path_distances(parents, pairs).collect()} == {"B0": 40, "A19": 19}
    assert {r.to_id: r.length for r in paths.relationship_paths(parents, pairs, None).collect()} == {"B0": 40, "A19": 19}
    person = spark.createDataFrame([("T", "B0", "male"), ("T", "A19", "female")], "tree_id string, person_id string, sex string")
    got = {r.to_id: r.term for r in kinship.describe_relationships(parents, person, pairs).collect()}
    assert "cousin" in got["B0"] and got["A19"].endswith("great-grandmother")


def test_long_lines_above_and_beside_a_loop(spark):
    """Lines of 40 steps with a loop on top are counted over simple paths; those beside it as ever."""
    chain = [(f"P{i}", f"P{i + 1}") for i in range(40)]
    loop = [("P40", "X"), ("X", "Y"), ("Y", "P40")]
    parents = table(spark, {"T": chain + loop, "U": diamonds(15)})
    focals = spark.createDataFrame([("T", "P0"), ("T", "P39"), ("U", "D0")], "tree_id string, focal_id string")
    got = {}
    for r in closure.path_counts(parents, focals).collect():
        got.setdefault((r.tree_id, r.focal_id), {})[r.ancestor_id] = got.get((r.tree_id, r.focal_id), {}).get(r.ancestor_id, 0) + r.paths
    assert got[("U", "D0")]["D15"] == 2**15
    assert got[("T", "P0")] == {**{f"P{i}": 1 for i in range(1, 41)}, "X": 1, "Y": 1}
    assert got[("T", "P39")] == {"P40": 1, "X": 1, "Y": 1}


def test_random_graphs_match_depth_first_search(spark):
    rng = random.Random(7)
    trees = {f"T{i}": random_dag(rng, 9, 16) for i in range(12)}
    parents = table(spark, trees)
    people = [(t, f"P{i}") for t in trees for i in range(9)]
    focals = spark.createDataFrame(people, "tree_id string, focal_id string")
    want = {}
    for t, who in people:
        for anc, ps in climb(trees[t], who).items():
            if len(ps) > 1:
                want[(t, who, anc)] = ps
    for first in (None, 2):
        got = {}
        for r in paths.collapse_paths(parents, focals, first).collect():
            got.setdefault((r.tree_id, r.focal_id, r.ancestor_id), []).append((r.path_no, tuple(r.steps), r.path_count))
        assert {k: sorted(v) for k, v in got.items()} == {
            k: [(i + 1, p, len(v)) for i, p in enumerate(v[:first])] for k, v in want.items()}
    short = {(r.tree_id, r.focal_id, r.ancestor_id): (r.path_count, r.min_length) for r in paths.pedigree_collapse(parents, focals).collect()}
    assert short == {k: (len(v), min(len(p) - 1 for p in v)) for k, v in want.items()}


def test_lines_and_links_match_the_paths(spark):
    rng = random.Random(5)
    trees = {f"T{i}": random_dag(rng, 9, 15) for i in range(8)}
    parents = table(spark, trees)
    people = [(t, f"P{i}") for t in trees for i in range(9)]
    above = closure.closure(parents, spark.createDataFrame(people, "tree_id string, focal_id string")).cache()
    asked = [(t, f"P{a}", f"P{b}") for t in trees for a in range(9) for b in range(9)]
    lines = spark.createDataFrame(asked, "tree_id string, focal_id string, ancestor_id string")
    on_line = research.people_on_line(above, lines).cache()
    got, links = {}, {}
    for r in on_line.collect():
        got.setdefault((r.tree_id, r.focal_id, r.ancestor_id), set()).add(r.person_id)
    for r in society.checklist_links(parents, on_line).collect():
        links.setdefault((r.tree_id, r.focal_id, r.ancestor_id), {})[r.link_key] = r.generation
    for t, a, b in asked:
        ps = climb(trees[t], a).get(b, [])
        assert got.get((t, a, b), set()) == ({a} if a == b else {x for p in ps for x in p})
        want = {}
        for p in ps:
            for i, (c, q) in enumerate(zip(p, p[1:], strict=False)):
                want[f"{c}->{q}"] = min(want.get(f"{c}->{q}", 99), i + 1)
        assert links.get((t, a, b), {}) == want


def test_bent_paths_match_depth_first_search(spark):
    rng = random.Random(11)
    trees = {f"T{i}": random_dag(rng, 8, 13) for i in range(10)}
    parents = table(spark, trees)
    pairs = [(t, f"P{a}", f"P{b}") for t in trees for a in range(8) for b in range(8)]
    asked = spark.createDataFrame(pairs, "tree_id string, from_id string, to_id string")
    for first in (None, 3):
        got = {}
        for r in paths.relationship_paths(parents, asked, first).collect():
            got.setdefault((r.tree_id, r.from_id, r.to_id), []).append((r.path_no, tuple(r.steps), r.path_count))
        for t, a, b in pairs:
            every = bends(trees[t], a, b)
            want = [(i + 1, p, len(every)) for i, p in enumerate(every[:first])]
            assert sorted(got.get((t, a, b), [])) == want, (t, a, b)
    near = {(r.tree_id, r.from_id, r.to_id): r.distance for r in kinship.path_distances(parents, asked).collect()}
    for t, a, b in pairs:
        listed = bends(trees[t], a, b)
        if a != b:
            assert near.get((t, a, b)) == (min(len(p) - 1 for p in listed) if listed else None)


def test_loops_end_and_are_reported(spark):
    parents = table(spark, {"T": [("A", "B"), ("B", "C"), ("C", "A"), ("X", "A"), ("X", "C")]})
    focals = spark.createDataFrame([("T", p) for p in "ABCX"], "tree_id string, focal_id string")
    up = {(r.focal_id, r.person_id): r.min_depth for r in closure.closure(parents, focals).collect()}
    assert up[("X", "B")] == 2 and ("A", "A") not in up and up[("A", "C")] == 2
    found = {r.ancestor_id: (r.path_count, r.min_length) for r in paths.pedigree_collapse(parents, focals).collect() if r.focal_id == "X"}
    assert found == {"A": (2, 1), "B": (2, 2), "C": (2, 1)}
    assert {r.person_id for r in paths.looping_people(parents).collect()} == {"A", "B", "C"}
    person = spark.createDataFrame([("T", p) for p in "ABCX"], "tree_id string, person_id string").withColumn(
        "names", F.array(F.struct(F.col("person_id").alias("full")))
    )
    no_date = "struct<date:struct<year:int>>"
    vitals = person.select("tree_id", "person_id", F.lit(None).cast(no_date).alias("birth"), F.lit(None).cast(no_date).alias("death"))
    audit = quality.audit_links(person, parents, vitals).collect()
    assert {(r.parent_id, r.child_id) for r in audit} == {("B", "A"), ("C", "B"), ("A", "C")}


def test_kinship_terms(spark):
    edges = [("F", "G"), ("M", "GM"), ("U", "G"), ("ME", "F"), ("ME", "M"), ("SIS", "F"), ("COZ", "U"), ("KID", "COZ"), ("G", "GG")]
    parents = table(spark, {"T": edges})
    sexes = {"F": "male", "M": "female", "G": "male", "GG": "unknown", "U": "female", "SIS": "female", "COZ": "male", "KID": "male", "ME": "male", "GM": "female"}
    person = spark.createDataFrame([("T", p, s) for p, s in sexes.items()], "tree_id string, person_id string, sex string")
    want = {
        ("ME", "F"): "father", ("ME", "G"): "grandfather", ("ME", "GG"): "great-grandparent", ("F", "ME"): "son",
        ("ME", "SIS"): "sister", ("ME", "U"): "aunt", ("U", "ME"): "nephew", ("ME", "COZ"): "first cousin",
        ("ME", "KID"): "first cousin once removed", ("GG", "KID"): "2nd great-grandson", ("ME", "ME"): "self",
        ("M", "F"): "no traceable relationship within this tree", ("KID", "F"): "great-uncle",
    }
    pairs = spark.createDataFrame([("T", a, b) for a, b in want], "tree_id string, from_id string, to_id string")
    got = {(r.from_id, r.to_id): r.term for r in kinship.describe_relationships(parents, person, pairs).collect()}
    assert got == want


def test_numbering_of_a_hot_group(spark):
    df = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 500).cast("string"))).alias("g"),
        F.hash("id").cast("bigint").alias("h"), "id",
    )
    rows = number_rows(df, ["g"], ["h", "id"], "n").groupBy("g").agg(
        F.count("*").alias("c"), F.countDistinct("n").alias("d"), F.max("n").alias("m"), F.min("n").alias("lo")
    ).collect()
    assert all(r.c == r.d == r.m and r.lo == 1 for r in rows) and len(rows) == 501
