"""Lines through ancestry loops, counted without building them outside the loops.

People who are each other's ancestors form a knot, a strongly connected component of
the parent links. A line that enters a knot and leaves it never comes back, and knots
never share people, so a line without repeats is a chain of stretches inside knots,
tied together by links between them. Stretches are enumerated once per knot; all the
rest is addition, whatever the number of lines above and below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.closure import looping_people, upward_trails
from kinloom.operators.lineage import cut

ROUNDS_PER_JOB = 4


def knots(parents: DataFrame) -> DataFrame:
    """(tree_id, person_id, knot_id) of people who are their own ancestors; the knot is named after its greatest id.

    The greatest id that reaches a person is its colour. Whoever reaches the person
    that gave a colour, inside the colour, is in one knot with that person. Knots found
    are taken out, and people no longer between two loops are peeled off, until no link
    is left: every round finds a knot or ends a chain, in all trees at once.
    """
    links = parents.select("tree_id", "parent_id", "child_id").where("parent_id <> child_id").distinct()
    found: DataFrame | None = None
    while True:
        core, _ = cut(looping_people(links))
        inside = links.join(core.withColumnRenamed("person_id", "child_id"), ["tree_id", "child_id"], "left_semi")
        links, left = cut(inside.join(core.withColumnRenamed("person_id", "parent_id"), ["tree_id", "parent_id"], "left_semi"))
        if not left["rows"]:
            break
        colours = _spread(core.withColumn("colour", F.col("person_id")), links)
        ends = lambda who: colours.select("tree_id", F.col("person_id").alias(f"{who}_id"), F.col("colour").alias(f"{who}_colour"))
        painted, _ = cut(
            links.join(ends("child"), ["tree_id", "child_id"]).join(ends("parent"), ["tree_id", "parent_id"])
            .where("child_colour = parent_colour").select("tree_id", "parent_id", "child_id"))
        # back from the person that gave the colour: a child of a member is a member
        members = colours.where("person_id = colour")
        fresh = members
        while True:
            step = fresh
            for _ in range(ROUNDS_PER_JOB):
                met = step.join(painted.withColumnRenamed("parent_id", "person_id"), ["tree_id", "person_id"])
                step = met.select("tree_id", F.col("child_id").alias("person_id"), "colour").unionByName(step).distinct()
            fresh, new = cut(step.join(members.select("tree_id", "person_id"), ["tree_id", "person_id"], "left_anti"))
            if not new["rows"]:
                break
            members = members.unionByName(fresh)
        members, _ = cut(members)
        found = members if found is None else found.unionByName(members)
        out = members.select("tree_id", F.col("person_id").alias("child_id"))
        links = links.join(out, ["tree_id", "child_id"], "left_anti").join(
            out.withColumnRenamed("child_id", "parent_id"), ["tree_id", "parent_id"], "left_anti")
    if found is None:
        return parents.select("tree_id", F.col("child_id").alias("person_id"), F.col("child_id").alias("knot_id")).where(F.lit(False))
    found = found.withColumnRenamed("colour", "knot_id")
    several = found.groupBy("tree_id", "knot_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(found.join(several.drop("n"), ["tree_id", "knot_id"], "left_semi").select("tree_id", "person_id", "knot_id"))[0]


def _spread(colours: DataFrame, links: DataFrame) -> DataFrame:
    """Every person takes the greatest colour of those below, until nothing changes."""
    edge = links.select("tree_id", F.col("child_id").alias("person_id"), "parent_id")
    colours = colours.withColumn("changed", F.lit(True))
    while True:
        for _ in range(ROUNDS_PER_JOB):
            sent = colours.join(edge, ["tree_id", "person_id"]).select("tree_id", F.col("parent_id").alias("person_id"), "colour")
            best = sent.groupBy("tree_id", "person_id").agg(F.max("colour").alias("sent"))
            colours = colours.join(best, ["tree_id", "person_id"], "left").select(
                "tree_id", "person_id", F.greatest("colour", "sent").alias("colour"),
                F.coalesce(F.col("sent") > F.col("colour"), F.lit(False)).alias("changed"))
        colours, seen = cut(colours, F.count_if("changed").alias("changes"))
        if not seen["changes"]:
            return colours.drop("changed")


def stretches(parents: DataFrame, tied: DataFrame) -> DataFrame:
    """(tree_id, entry_id, node, steps, ways): lines without repeats inside each knot, by length."""
    side = lambda who: tied.select("tree_id", F.col("person_id").alias(f"{who}_id"), F.col("knot_id").alias(f"{who}_knot"))
    inner = parents.join(side("child"), ["tree_id", "child_id"]).join(side("parent"), ["tree_id", "parent_id"]).where("child_knot = parent_knot")
    inner, _ = cut(inner.select(*parents.columns))
    trails = upward_trails(inner, tied.select("tree_id", F.col("person_id").alias("focal_id")))
    return trails.groupBy("tree_id", F.col("focal_id").alias("entry_id"), F.col("tip_id").alias("node"), F.col("length").alias("steps")).agg(
        F.count(F.lit(1)).alias("ways"))


def looped_path_counts(parents: DataFrame, focals: DataFrame, rounds_per_job: int = ROUNDS_PER_JOB) -> DataFrame:
    """(tree_id, focal_id, node, paths, depth): lines without repeats from each focal, exact.

    A row of ``arrived`` counts the lines whose last link came from outside the knot of
    ``node`` (or that begin there). A round adds the stretches of that knot and follows
    the links that leave it; links between knots have no loop, so the rounds end.
    """
    tied = knots(parents)
    inside, _ = cut(stretches(parents, tied))
    side = lambda who: tied.select("tree_id", F.col("person_id").alias(f"{who}_id"), F.col("knot_id").alias(f"{who}_knot"))
    links = parents.select("tree_id", "parent_id", "child_id").where("parent_id <> child_id")
    leaving, _ = cut(
        links.join(side("child"), ["tree_id", "child_id"], "left").join(side("parent"), ["tree_id", "parent_id"], "left")
        .where(~F.equal_null("child_knot", "parent_knot") | F.col("child_knot").isNull())
        .select("tree_id", F.col("child_id").alias("node"), F.col("parent_id").alias("next")))
    arrived = focals.select("tree_id", "focal_id").distinct().select(
        "tree_id", "focal_id", F.col("focal_id").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("paths"))
    done: DataFrame | None = None
    hop = 0
    while True:
        batch = None
        for _ in range(rounds_per_job):
            through = arrived.withColumnRenamed("node", "entry_id").join(inside, ["tree_id", "entry_id"]).select(
                "tree_id", "focal_id", "node", (F.col("depth") + F.col("steps")).alias("depth"), (F.col("paths") * F.col("ways")).alias("paths"))
            here = arrived.unionByName(through).groupBy("tree_id", "focal_id", "node", "depth").agg(F.sum("paths").alias("paths"))
            part = here.withColumn("hop", F.lit(hop))
            batch = part if batch is None else batch.unionByName(part)
            arrived = here.join(leaving, ["tree_id", "node"]).groupBy(
                "tree_id", "focal_id", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")).agg(F.sum("paths").alias("paths"))
            hop += 1
        batch, seen = cut(batch.unionByName(arrived.withColumn("hop", F.lit(hop))), F.max("hop").alias("last"))
        done = batch.where(F.col("hop") < hop) if done is None else done.unionByName(batch.where(F.col("hop") < hop))
        if not seen["rows"] or seen["last"] < hop:
            break
        arrived = batch.where(F.col("hop") == hop).drop("hop")
    return done.where("depth > 0").groupBy("tree_id", "focal_id", "node", "depth").agg(F.sum("paths").alias("paths")).select(
        "tree_id", "focal_id", "node", "paths", "depth")
