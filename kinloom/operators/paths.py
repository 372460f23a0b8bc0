"""Relationship paths, ancestral paths and pedigree collapse.

A *trail* is one simple upward path from a focal person to a tip:
``(tree_id, focal_id, tip_id, length, steps, hops)``. ``hops`` holds one
``(fseq, pord, cord)`` struct per step; comparing hops arrays gives depth-first
order, a proper prefix first.

Counts are exact and no length is too long. Listings take ``first``, the number
of paths wanted of each group, or None for all; the caller has to choose, and
the exact count stands beside the paths either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import blocks
from kinloom.operators.closure import HOPS, first_trails, looping_people, path_counts, upward_trails
from kinloom.operators.first_paths import first_paths, loop_trees
from kinloom.operators.lineage import cut

__all__ = [
    "ancestral_paths", "collapse_paths", "looping_people", "met_paths", "path_highlights", "path_listing", "pedigree_collapse",
    "relationship_paths", "upward_trails",
]


def _totals(parents: DataFrame, focals: DataFrame) -> DataFrame:
    return path_counts(parents, focals).groupBy("tree_id", "focal_id", "ancestor_id").agg(
        F.sum("paths").alias("path_count"), F.min("depth").alias("min_length")
    )


def pedigree_collapse(parents: DataFrame, focals: DataFrame) -> DataFrame:
    """Ancestors reached by two or more upward paths: (tree_id, focal_id, ancestor_id, path_count, min_length)."""
    return _totals(parents, focals).where(F.col("path_count") >= 2)


def collapse_paths(parents: DataFrame, focals: DataFrame, first: int | None) -> DataFrame:
    """Paths to every ancestor reached by two or more, in depth-first order.

    (tree_id, focal_id, ancestor_id, path_no, length, steps, path_count)
    """
    many = pedigree_collapse(parents, focals).drop("min_length")
    trails = first_trails(upward_trails(parents, focals, first), first)
    return trails.withColumnRenamed("tip_id", "ancestor_id").join(many, ["tree_id", "focal_id", "ancestor_id"]).select(
        "tree_id", "focal_id", "ancestor_id", "path_no", "length", "steps", "path_count"
    )


def ancestral_paths(parents: DataFrame, lines: DataFrame, first: int | None) -> DataFrame:
    """Upward paths of each asked (focal_id, ancestor_id): path_no, length, steps, path_count."""
    keys = ["tree_id", "focal_id", "ancestor_id"]
    asked = lines.select(*keys).distinct()
    focals = asked.select("tree_id", "focal_id").distinct()
    trails = upward_trails(parents, focals, first).withColumnRenamed("tip_id", "ancestor_id").join(asked, keys, "left_semi")
    numbered = first_trails(trails.withColumnRenamed("ancestor_id", "tip_id"), first).withColumnRenamed("tip_id", "ancestor_id")
    return numbered.join(_totals(parents, focals), keys).select(*keys, "path_no", "length", "steps", "path_count")


def relationship_paths(parents: DataFrame, pairs: DataFrame, first: int | None) -> DataFrame:
    """Paths that climb to a shared ancestor and come down again, per asked pair, in depth-first order.

    (tree_id, from_id, to_id, path_no, length, steps, apex_id, path_count)

    With ``first`` no path beyond them is built, and the count (a decimal) adds up pairs of
    people; trees with an ancestry loop are listed whole all the same.
    """
    odd, plain, asked, told = _by_order(parents, pairs)
    if first is None:
        found = blocks.every_path(plain, asked)
        return found if not told else found.unionByName(_every_path(*odd))
    ready, nodes, wide, many = blocks.parted(plain, asked)
    found = blocks.some_paths(ready, nodes, plain, first)
    for rest in ([(plain, wide)] if many else []) + ([odd] if told else []):
        found = found.unionByName(_first_by_joins(*rest, first))
    return found


def _by_order(parents: DataFrame, pairs: DataFrame) -> tuple[tuple[DataFrame, DataFrame], DataFrame, DataFrame, int]:
    """Links and pairs of trees that do not tell the order of parents and children, and those of all others; the number of the former."""
    tied, size = cut(blocks.tied_trees(parents))
    if not size["rows"]:
        return (parents, pairs), parents, pairs, 0
    split = lambda how: tuple(x.join(tied, "tree_id", how) for x in (parents, pairs))
    return split("left_semi"), *split("left_anti"), size["rows"]


def _first_by_joins(parents: DataFrame, pairs: DataFrame, first: int) -> DataFrame:
    """The first paths by joins over pairs of people: for people with very many ancestors, and trees without an order."""
    keys = ["tree_id", "from_id", "to_id"]
    looping = loop_trees(parents)
    found, count = first_paths(parents.join(looping, "tree_id", "left_anti"), pairs.join(looping, "tree_id", "left_anti"), first)
    listed = _every_path(parents.join(looping, "tree_id", "left_semi"), pairs.join(looping, "tree_id", "left_semi")).where(F.col("path_no") <= first)
    return found.join(count, keys).select(*listed.columns).unionByName(listed.withColumn("path_count", F.col("path_count").cast("decimal(38,0)")))


def _every_path(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """All paths by joins, numbered, and how many there are; for trees where positions are tied."""
    keys = ["tree_id", "from_id", "to_id"]
    met, _ = cut(met_paths(parents, pairs))
    numbered = met.withColumn("path_no", F.row_number().over(Window.partitionBy(*keys).orderBy("path_key")))
    total = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("path_count"))
    return numbered.join(total, keys).select(*keys, "path_no", "length", "steps", "apex_id", "path_count")


def met_paths(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """All paths: upward trails of both ends meet on the apex (an end itself may be the apex).

    (tree_id, from_id, to_id, apex_id, length, steps, path_key); paths of a pair in the order of the key.
    """
    asked = pairs.select("tree_id", "from_id", "to_id").where(F.col("from_id") != F.col("to_id")).distinct()
    ends = (
        asked.select("tree_id", F.col("from_id").alias("focal_id"))
        .unionByName(asked.select("tree_id", F.col("to_id").alias("focal_id"))).distinct()
    )
    trails = upward_trails(parents, ends)
    own = ends.select(
        "tree_id", "focal_id", F.col("focal_id").alias("tip_id"), F.array("focal_id").alias("steps"),
        F.array().cast(HOPS).alias("hops"), F.lit(0).alias("length"),
    )
    every = trails.unionByName(own)
    climb = every.select(
        "tree_id", F.col("focal_id").alias("from_id"), F.col("tip_id").alias("apex_id"),
        F.col("steps").alias("up_steps"), F.col("length").alias("up_len"),
        F.flatten(
            F.transform("hops", lambda h: F.array(F.lit(0).cast("bigint"), h["f"], h["p"].cast("bigint")))
        ).alias("up_key"),
    )
    descend = every.select(
        "tree_id", F.col("focal_id").alias("to_id"), F.col("tip_id").alias("apex_id"),
        F.reverse("steps").alias("down_steps"), F.col("length").alias("down_len"),
        F.flatten(
            F.transform(
                F.reverse("hops"), lambda h: F.array(F.lit(1).cast("bigint"), h["f"], h["c"].cast("bigint"))
            )
        ).alias("down_key"),
    )
    return (
        asked.join(climb, ["tree_id", "from_id"])
        .join(descend, ["tree_id", "to_id", "apex_id"])
        .where(F.size(F.array_intersect("up_steps", "down_steps")) == 1)
        .select(
            "tree_id", "from_id", "to_id", "apex_id",
            (F.col("up_len") + F.col("down_len")).alias("length"),
            F.concat("up_steps", F.expr("slice(down_steps, 2, size(down_steps))")).alias("steps"),
            F.concat("up_key", "down_key").alias("path_key"),
        )
    )


def path_highlights(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node ids and both orientations of every hop on the paths of each pair."""
    ids = ["tree_id", "from_id", "to_id"]
    nodes = paths.select(*ids, F.explode("steps").alias("person_id")).distinct()
    hops = paths.select(
        *ids,
        F.explode(
            F.arrays_zip(
                F.expr("slice(steps, 1, size(steps) - 1)").alias("a"),
                F.expr("slice(steps, 2, size(steps) - 1)").alias("b"),
            )
        ).alias("hop"),
    ).select(*ids, "hop.a", "hop.b")
    text = lambda x, y: F.concat(F.lit("parentOf:"), F.col(x), F.lit("->"), F.col(y)).alias("edge_key")
    edges = hops.select(*ids, text("a", "b")).unionByName(hops.select(*ids, text("b", "a"))).distinct()
    return nodes, edges


def highlights(parents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path_highlights`` of all paths of the asked pairs; where nobody has very many ancestors, no path is listed."""
    ids = ["tree_id", "from_id", "to_id"]
    asked, nodes, wide, many = blocks.parted(parents, pairs)
    hops = blocks.hops_on_paths(asked, nodes, parents)
    # the hops of a pair come out of one task, one after the other
    met = hops.select(*ids, F.explode(F.array("a", "b")).alias("person_id")).distinct()
    text = lambda x, y: F.concat(F.lit("parentOf:"), F.col(x), F.lit("->"), F.col(y))
    edges = hops.select(*ids, F.explode(F.array(text("a", "b"), text("b", "a"))).alias("edge_key"))
    if many:
        more = path_highlights(met_paths(parents, wide))
        met, edges = met.unionByName(more[0]), edges.unionByName(more[1])
    return met, edges


def names_on_paths(parents: DataFrame, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``path_listing`` of all paths of the asked pairs: paths are named where they are made."""
    odd, plain, asked, told = _by_order(parents, pairs)
    found = _listing(blocks.every_path(plain, asked, names).withColumn("chain", F.array_join("steps", " → ")))
    return found if not told else found.unionByName(path_listing(_every_path(*odd), names))


def _listing(paths: DataFrame) -> DataFrame:
    plural = F.when(F.col("length") == 1, "").otherwise("s")
    return paths.select(
        "tree_id", "from_id", "to_id", "path_no",
        F.concat(
            F.lit("#"), F.col("path_no").cast("string"), F.lit(" ("), F.col("length").cast("string"),
            F.lit(" step"), plural, F.lit("): "), "chain",
        ).alias("listing"),
    )


def path_listing(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``#n (k steps): A → B → C`` per path; ``names(tree_id, person_id, name)``.

    Paths of one pair go through the same people again and again: names are looked up once per pair and person.
    """
    pair = ["tree_id", "from_id", "to_id"]
    people = paths.select(*pair, F.explode("steps").alias("person_id")).distinct()
    known = people.join(names.select("tree_id", "person_id", "name"), ["tree_id", "person_id"], "left")
    # a person with several names stands there with each of them
    shown = F.sort_array(F.collect_list(F.coalesce("name", "person_id"))).alias("shown")
    labels = known.groupBy(*pair, "person_id").agg(shown).groupBy(*pair).agg(
        F.map_from_entries(F.collect_list(F.struct("person_id", "shown"))).alias("labels"))
    chain = F.array_join(F.flatten(F.transform("steps", lambda s: F.try_element_at("labels", s))), " → ")
    return _listing(paths.join(labels, pair).withColumn("chain", chain))
