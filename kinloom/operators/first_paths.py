"""The first relationship paths of a pair, and how many there are, without listing the others.

A path climbs from one end to an apex and comes down to the other. Both sides may
share the apex only. Seen as two climbs that end where they first meet, it is a walk
over pairs of people (u, v): of two people who are not the same, the one lower in
the tree moves on to a parent. A common person can then only be met by both at once,
so the walks from (from, to) to some (x, x) are exactly the paths, and their number
is a sum over pairs of people, whatever the number of paths.

The first paths come from the same sums. People are numbered so that ancestors have the
larger numbers, and a way of (u, v) is a way of the next pair with one person put before
it (u moved) or behind it (v moved). Among ways of one length neither changes the
depth-first order, so the first ways of a pair and length are among the first ones of
the next pairs: each pair keeps ``first`` of every length, and nothing is built beyond them.

Trees with an ancestry loop have no lower and higher; ``paths`` lists theirs whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.closure import looping_people
from kinloom.operators.lineage import cut

LEVELS = 4  # levels planned per job
HEIGHT_STEP = 1 << 48  # numbers of one height; row ids of 32,768 partitions fit in
DOWN = 1 << 30  # added to the place of a child: a climb that goes on comes before one that turns
_PAIR = ["tree_id", "from_id", "to_id"]
_WAYS = "array<struct<key:array<int>,path:array<bigint>>>"


def heights(parents: DataFrame) -> DataFrame:
    """(tree_id, person_id, height, no): the longest line of descent below each person of loop-free trees; numbers rise with it."""
    step = parents.select("tree_id", F.col("child_id").alias("node"), F.col("parent_id").alias("next"))
    everyone = parents.select("tree_id", F.col("child_id").alias("node")).unionByName(parents.select("tree_id", F.col("parent_id").alias("node"))).distinct()
    level, _ = cut(everyone)
    found, depth = level.withColumn("height", F.lit(0)), 0
    while True:
        batch = None
        for _ in range(LEVELS):
            depth += 1
            level = level.join(step, ["tree_id", "node"]).select("tree_id", F.col("next").alias("node")).distinct()
            part = level.withColumn("height", F.lit(depth))
            batch = part if batch is None else batch.unionByName(part)
        batch, seen = cut(batch, F.max("height").alias("deepest"))
        found = found.unionByName(batch)
        if not seen["rows"] or seen["deepest"] < depth:
            high, _ = cut(found.groupBy("tree_id", F.col("node").alias("person_id")).agg(F.max("height").alias("height")))
            return cut(high.withColumn("no", F.col("height") * F.lit(HEIGHT_STEP) + F.monotonically_increasing_id()))[0]
        level = batch.where(F.col("height") == depth).drop("height")


def _steps(parents: DataFrame, high: DataFrame) -> DataFrame:
    """(tree_id, node, next, f, p, c, next_height): one step up, with the order of parents and of children."""
    return parents.join(high.withColumnRenamed("person_id", "parent_id"), ["tree_id", "parent_id"]).select(
        "tree_id", F.col("child_id").alias("node"), F.col("parent_id").alias("next"), F.col("fseq").cast("bigint").alias("f"),
        F.col("pord").cast("bigint").alias("p"), F.col("cord").cast("bigint").alias("c"), F.col("height").alias("next_height"))


def _moves(steps: DataFrame, high: DataFrame) -> DataFrame:
    """(node, next, a, b): steps between numbers, with the places of the parent and, seen from above, of the child."""
    number = lambda who, no: high.select("tree_id", F.col("person_id").alias(who), F.col("no").alias(no))
    known = steps.join(number("node", "n1"), ["tree_id", "node"]).join(number("next", "n2"), ["tree_id", "next"])
    return cut(known.select(
        F.col("n1").alias("node"), F.col("n2").alias("next"),
        F.dense_rank().over(Window.partitionBy("n1").orderBy("f", "p")).alias("a"),
        F.dense_rank().over(Window.partitionBy("n2").orderBy("f", "c")).alias("b")))[0]


def _numbers(high: DataFrame, pairs: DataFrame) -> DataFrame:
    """Asked pairs of known people with the numbers u and v of their ends."""
    for end, no in (("from_id", "u"), ("to_id", "v")):
        pairs = pairs.join(high.select("tree_id", F.col("person_id").alias(end), F.col("no").alias(no)), ["tree_id", end])
    return cut(pairs.select(*_PAIR, "u", "v").distinct())[0]


def _pair_steps(moves: DataFrame, pairs: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(u, v, u2, v2, a, b): all steps on the ways up of the asked (u, v), and (u, v) of all pairs that are met on them."""
    pair = ["u", "v"]
    seen, size = cut(pairs.select(*pair).distinct())
    frontier, edges = seen, None
    while size["rows"]:
        made, level = None, frontier
        for _ in range(LEVELS):
            on = level.where("u != v").withColumn("node", F.least("u", "v")).join(moves, "node").select(
                *pair, F.when(F.col("u") < F.col("v"), F.col("next")).otherwise(F.col("u")).alias("u2"),
                F.when(F.col("u") < F.col("v"), F.col("v")).otherwise(F.col("next")).alias("v2"), "a", "b")
            level = on.select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct()
            made = on if made is None else made.unionByName(on)
        # every step of a pair is made whenever the pair is met
        made, _ = cut(made.dropDuplicates([*pair, "u2", "v2"]))
        edges = made if edges is None else edges.unionByName(made)
        fresh, _ = cut(made.select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct().join(seen, pair, "left_anti"))
        seen = seen.unionByName(fresh)
        frontier, size = cut(fresh.where("u != v").join(made.select(*pair), pair, "left_anti"))
    return None if edges is None else cut(edges.dropDuplicates([*pair, "u2", "v2"]))[0], seen


def _first_ways(moves: DataFrame, asked: DataFrame, first: int) -> DataFrame:
    """(u, v, n, ways): the number of ways of the asked (u, v) that have any, and the first of them in depth-first order."""
    pair = ["u", "v"]
    edges, seen = _pair_steps(moves, asked)
    none = F.array().cast("array<int>")
    level = seen.where("u = v").select(
        *pair, F.lit(1).cast("decimal(38,0)").alias("n"), F.array(F.struct(none.alias("key"), F.array("u").alias("path"))).cast(_WAYS).alias("ways"))
    wanted = asked.select(*pair).distinct().withColumn("asked", F.lit(True))
    best = lambda ways: F.slice(F.sort_array(F.flatten(F.collect_list(ways))), 1, first) if first else F.first(F.lit(None).cast(_WAYS))
    done = level.join(wanted.select(*pair), pair, "left_semi")
    if edges is None:
        return done
    climbs = F.col("u") < F.col("v")
    longer = lambda w: F.struct(
        F.when(climbs, F.concat(F.array("a"), w["key"])).otherwise(F.concat(w["key"], F.array(F.col("b") + DOWN))).alias("key"),
        F.when(climbs, F.concat(F.array("u"), w["path"])).otherwise(F.concat(w["path"], F.array("v"))).alias("path"))
    depth = 0
    while True:
        batch = None
        for _ in range(LEVELS):
            depth += 1
            onto = level.select(F.col("u").alias("u2"), F.col("v").alias("v2"), "n", "ways")
            on = edges.join(onto, ["u2", "v2"]).select(*pair, "n", F.transform("ways", longer).alias("ways"))
            level = on.groupBy(*pair).agg(F.sum("n").cast("decimal(38,0)").alias("n"), best("ways").alias("ways"))
            part = level.withColumn("d", F.lit(depth))
            batch = part if batch is None else batch.unionByName(part)
        # of the others only the last level is gone on from
        kept = batch.join(wanted, pair, "left").where(F.col("asked") | (F.col("d") == depth))
        batch, size = cut(kept, F.max("d").alias("deepest"))
        done = done.unionByName(batch.where("asked").select(*done.columns))
        if not size["rows"] or size["deepest"] < depth:
            return cut(done.groupBy(*pair).agg(F.sum("n").cast("decimal(38,0)").alias("n"), best("ways").alias("ways")))[0]
        level = batch.where(F.col("d") == depth).select(*pair, "n", "ways")


def pair_counts(steps: DataFrame, high: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, u, v, n): number of ways in which two lines up from u and v first meet, for the asked pairs of people;
    pairs whose lines never meet are left out."""
    asked = _numbers(high, pairs)
    found = asked.join(_first_ways(_moves(steps, high), asked, 0), ["u", "v"])
    return found.select("tree_id", F.col("from_id").alias("u"), F.col("to_id").alias("v"), "n")


def first_paths(parents: DataFrame, pairs: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """The first paths of every asked pair of loop-free trees, and the number of all.

    (tree_id, from_id, to_id, path_no, length, steps, apex_id) and (tree_id, from_id, to_id, path_count), a
    decimal: pairs without a path are in neither.
    """
    high = heights(parents)
    asked = _numbers(high, pairs.select(*_PAIR).where("from_id != to_id").distinct())
    ways = _first_ways(_moves(_steps(parents, high), high), asked, first)
    found, _ = cut(asked.join(ways, ["u", "v"]))
    listed = found.select(*_PAIR, F.posexplode("ways").alias("at", "way")).withColumn("path_no", F.col("at") + 1)
    each = [*_PAIR, "path_no"]
    # numbers become people again, the apex is the highest of a path
    names = high.select(F.col("no"), F.col("person_id").alias("who"))
    walked = listed.select(*each, F.array_max("way.path").alias("top"), F.posexplode("way.path").alias("pos", "no")).join(names, "no")
    steps = F.transform(F.sort_array(F.collect_list(F.struct("pos", "who"))), lambda s: s["who"]).alias("steps")
    apex = F.max(F.when(F.col("no") == F.col("top"), F.col("who"))).alias("apex_id")
    numbered = walked.groupBy(*each).agg(steps, apex)
    return numbered.select(*each, (F.size("steps") - 1).alias("length"), "steps", "apex_id"), found.select(*_PAIR, F.col("n").alias("path_count"))


def loop_trees(parents: DataFrame) -> DataFrame:
    """(tree_id) of trees with an ancestry loop."""
    return cut(looping_people(parents).select("tree_id").distinct())[0]
