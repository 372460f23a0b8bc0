"""Ancestor and descendant closure for many focal persons at once.

Levels are expanded by joining the frontier with the edges on the node key, so a
large tree is spread by person, never held in one task. Several levels are
planned per job. A (focal, node) pair reached at two depths is expanded at both;
the minimum is taken once at the end. Pairs already seen at a smaller depth are
dropped at every job border, which keeps the work near the size of the closure
and ends the loop on cyclic data too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.lineage import cut

LEVELS_PER_JOB = 4
LOOP_CHECK = 24  # levels after which lines that are still open are examined for loops
HOPS = "array<struct<f:bigint,p:int,c:int>>"


def steps_of(parents: DataFrame, direction: str) -> DataFrame:
    """Directed one-hop table (tree_id, node, next, k1, k2) in adjacency order."""
    if direction == "up":
        return parents.select(
            "tree_id", F.col("child_id").alias("node"), F.col("parent_id").alias("next"),
            F.col("fseq").alias("k1"), F.col("pord").cast("bigint").alias("k2"),
        )
    return parents.select(
        "tree_id", F.col("parent_id").alias("node"), F.col("child_id").alias("next"),
        F.col("fseq").alias("k1"), F.col("cord").cast("bigint").alias("k2"),
    )


def closure(
    parents: DataFrame,
    focals: DataFrame,
    direction: str = "up",
    max_depth: int | None = None,
    ordered: bool = False,
    levels_per_job: int = LEVELS_PER_JOB,
) -> DataFrame:
    """(tree_id, focal_id, person_id, min_depth[, walk_key]) for depth >= 1.

    ``walk_key`` orders persons of one depth as a breadth-first walk meets them.
    """
    if max_depth is not None and max_depth <= 0:
        max_depth = 0
    step = steps_of(parents, direction)
    keys = ["tree_id", "focal_id", "node"]
    empty_key = F.array().cast("array<bigint>")
    frontier = focals.select("tree_id", "focal_id").distinct().withColumn("node", F.col("focal_id"))
    frontier = frontier.withColumn("walk_key", empty_key) if ordered else frontier
    seen: DataFrame | None = None
    depth = 0
    while max_depth is None or depth < max_depth:
        span = levels_per_job if max_depth is None else min(levels_per_job, max_depth - depth)
        level, batch = frontier, None
        for _ in range(span):
            depth += 1
            level = _expand(level, step, keys, ordered)
            part = level.withColumn("depth", F.lit(depth))
            batch = part if batch is None else batch.unionByName(part)
        batch = batch.where(F.col("node") != F.col("focal_id"))
        if seen is not None:
            batch = batch.join(seen.select(*keys), keys, "left_anti")
        last = F.max("depth").alias("deepest")
        batch, metrics = cut(batch, last)
        if metrics["rows"] == 0:
            break
        seen = batch if seen is None else seen.unionByName(batch)
        if metrics["deepest"] < depth:
            break
        frontier = batch.where(F.col("depth") == depth).drop("depth")
    if seen is None:
        seen = frontier.where(F.lit(False)).withColumn("depth", F.lit(0))
    out = seen.groupBy(*keys)
    if ordered:
        best = F.min(F.struct("depth", "walk_key")).alias("best")
        out = out.agg(best).select(
            "tree_id", "focal_id", F.col("node").alias("person_id"),
            F.col("best.depth").alias("min_depth"), F.col("best.walk_key").alias("walk_key"),
        )
        return out
    return out.agg(F.min("depth").alias("min_depth")).select(
        "tree_id", "focal_id", F.col("node").alias("person_id"), "min_depth"
    )


def _expand(frontier: DataFrame, step: DataFrame, keys: list[str], ordered: bool) -> DataFrame:
    reached = frontier.join(step, ["tree_id", "node"])
    if not ordered:
        return reached.select("tree_id", "focal_id", F.col("next").alias("node")).distinct()
    key = F.concat("walk_key", F.array("k1", "k2"))
    return (
        reached.select("tree_id", "focal_id", F.col("next").alias("node"), key.alias("walk_key"))
        .groupBy(*keys).agg(F.min("walk_key").alias("walk_key"))
    )


def with_self(closed: DataFrame, focals: DataFrame) -> DataFrame:
    """Add the depth-0 row of every focal person."""
    own = focals.select("tree_id", "focal_id").distinct().select(
        "tree_id", "focal_id", F.col("focal_id").alias("person_id"), F.lit(0).alias("min_depth")
    )
    return closed.select("tree_id", "focal_id", "person_id", "min_depth").unionByName(own)


def focal_generations(ancestors: DataFrame, descendants: DataFrame, focals: DataFrame) -> DataFrame:
    """Ancestors positive, descendants negative; an ancestor number wins."""
    down = descendants.select(
        "tree_id", "focal_id", "person_id", (-F.col("min_depth")).alias("generation"), F.lit(1).alias("rank")
    )
    up = with_self(ancestors, focals).select(
        "tree_id", "focal_id", "person_id", F.col("min_depth").alias("generation"), F.lit(0).alias("rank")
    )
    return (
        up.unionByName(down).groupBy("tree_id", "focal_id", "person_id")
        .agg(F.min_by("generation", "rank").alias("generation"))
    )


def path_counts(parents: DataFrame, focals: DataFrame, levels_per_job: int = LEVELS_PER_JOB) -> DataFrame:
    """Upward paths per (focal, ancestor, depth), exact, whatever their number and length.

    Loop-free lines need no path: each level adds up the counts of the level
    before, until the lines end. Lines that are still open after ``LOOP_CHECK``
    levels are examined for loops; the focals that reach one are counted by
    ``loops.looped_path_counts``, over simple paths, the others go on as before.
    """
    step = steps_of(parents, "up").select("tree_id", "node", "next")
    focals = focals.select("tree_id", "focal_id").distinct()
    level = focals.select("tree_id", "focal_id", F.col("focal_id").alias("node"), F.lit(1).cast("bigint").alias("paths"))
    done: DataFrame | None = None
    depth, looked = 0, False
    while True:
        batch = None
        for _ in range(levels_per_job):
            depth += 1
            level = (
                level.join(step, ["tree_id", "node"])
                .groupBy("tree_id", "focal_id", F.col("next").alias("node"))
                .agg(F.sum("paths").alias("paths"))
            )
            part = level.withColumn("depth", F.lit(depth))
            batch = part if batch is None else batch.unionByName(part)
        batch, metrics = cut(batch, F.max("depth").alias("deepest"))
        done = batch if done is None else done.unionByName(batch)
        if metrics["rows"] == 0 or metrics["deepest"] < depth:
            break
        level = batch.where(F.col("depth") == depth).drop("depth")
        if depth >= LOOP_CHECK and not looked:
            looked = True
            loops, found = cut(looping_people(parents))
            if found["rows"]:
                caught, _ = cut(_reaching(parents, focals, loops))
                keys = ["tree_id", "focal_id"]
                done, level = done.join(caught, keys, "left_anti"), level.join(caught, keys, "left_anti")
                from kinloom.operators.loops import looped_path_counts  # it builds on this module

                extra, _ = cut(looped_path_counts(parents, caught))
                done = done.unionByName(extra.select(*done.columns))
    return done.withColumnRenamed("node", "ancestor_id")


def _reaching(parents: DataFrame, focals: DataFrame, loops: DataFrame) -> DataFrame:
    """Focals that are on a loop or below one."""
    every = with_self(closure(parents, focals), focals)
    return every.join(loops, ["tree_id", "person_id"], "left_semi").select("tree_id", "focal_id").distinct()


def looping_people(parents: DataFrame) -> DataFrame:
    """(tree_id, person_id) that lie on, above and below an ancestry loop.

    People without parents among the rest are peeled off until none is left;
    then people without children among the rest.
    """
    edges = parents.select("tree_id", "parent_id", "child_id")
    for end, other in (("parent_id", "child_id"), ("child_id", "parent_id")):
        edges, metrics = cut(edges)
        before = None
        while metrics["rows"] and metrics["rows"] != before:
            before = metrics["rows"]
            inner = edges.select("tree_id", F.col(other).alias(end)).distinct()
            edges, metrics = cut(edges.join(inner, ["tree_id", end], "left_semi"))
    return edges.select("tree_id", F.col("child_id").alias("person_id")).distinct()


def hop_table(parents: DataFrame) -> DataFrame:
    hop = F.struct(
        F.col("fseq").cast("bigint").alias("f"), F.col("pord").cast("int").alias("p"),
        F.col("cord").cast("int").alias("c"),
    )
    return parents.select(
        "tree_id", F.col("child_id").alias("tip_id"), F.col("parent_id").alias("up_id"), hop.alias("hop")
    )


def upward_trails(
    parents: DataFrame, focals: DataFrame, first: int | None = None, levels_per_job: int = LEVELS_PER_JOB
) -> DataFrame:
    """All simple upward trails of length >= 1, of any length.

    With ``first`` only the first so many trails per (focal, tip) in depth-first
    order have to survive, so at job borders the frontier is thinned to them. On
    loop-free lines this loses none of the first trails of any later tip: a
    dropped trail already has that many smaller siblings with every
    continuation. Trees with a loop are not thinned.
    """
    hops = hop_table(parents)
    frontier = focals.select("tree_id", "focal_id").distinct().select(
        "tree_id", "focal_id", F.col("focal_id").alias("tip_id"),
        F.array("focal_id").alias("steps"), F.array().cast(HOPS).alias("hops"),
    )
    looping = None
    done: DataFrame | None = None
    depth = 0
    while True:
        batch = None
        level = frontier
        for _ in range(levels_per_job):
            depth += 1
            level = (
                level.join(hops, ["tree_id", "tip_id"])
                .where(~F.array_contains("steps", F.col("up_id")))
                .select(
                    "tree_id", "focal_id", F.col("up_id").alias("tip_id"),
                    F.concat("steps", F.array("up_id")).alias("steps"),
                    F.concat("hops", F.array("hop")).alias("hops"),
                )
            )
            part = level.withColumn("length", F.lit(depth))
            batch = part if batch is None else batch.unionByName(part)
        batch, metrics = cut(batch, F.max("length").alias("longest"))
        done = batch if done is None else done.unionByName(batch)
        if metrics["rows"] == 0 or metrics["longest"] < depth:
            return done
        frontier = batch.where(F.col("length") == depth)
        if first is not None:
            if looping is None:
                looping, _ = cut(looping_people(parents).select("tree_id").distinct())
            kept = first_trails(done, first).where(F.col("length") == depth)
            loose = frontier.join(looping, "tree_id", "left_semi")
            frontier, _ = cut(kept.join(looping, "tree_id", "left_anti").drop("path_no").unionByName(loose))
        frontier = frontier.drop("length")


def first_trails(trails: DataFrame, count: int | None) -> DataFrame:
    """Trails numbered per (focal, tip) in depth-first order; with ``count`` only so many of each."""
    order = Window.partitionBy("tree_id", "focal_id", "tip_id").orderBy("hops")
    numbered = trails.withColumn("path_no", F.row_number().over(order))
    return numbered if count is None else numbered.where(F.col("path_no") <= count)
