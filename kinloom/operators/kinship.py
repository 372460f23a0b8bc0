"""Common ancestors, kinship terms and collapse reports for asked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.kinship_terms import (
    UNRELATED,
    ancestor_term,
    collateral_term,
    descendant_term,
)
from kinloom.operators.closure import closure, with_self
from kinloom.operators.lineage import cut

_PAIR = ["tree_id", "from_id", "to_id"]


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("tree_id", F.col("from_id").alias("focal_id")).unionByName(
        pairs.select("tree_id", F.col("to_id").alias("focal_id"))
    ).distinct()


def _side(ancestors: DataFrame, end: str, depth: str) -> DataFrame:
    return ancestors.select(
        "tree_id", F.col("focal_id").alias(end), F.col("person_id").alias("ancestor_id"),
        F.col("min_depth").alias(depth),
    )


def common_ancestors(ancestors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every ancestor shared by both ends of a pair, with both generations."""
    asked = pairs.select(*_PAIR).where(F.col("from_id") != F.col("to_id")).distinct()
    return asked.join(_side(ancestors, "from_id", "from_depth"), ["tree_id", "from_id"]).join(
        _side(ancestors, "to_id", "to_depth"), ["tree_id", "to_id", "ancestor_id"]
    )


def nearest_common(parents: DataFrame, common: DataFrame) -> DataFrame:
    """Drop shared ancestors that are above another shared one.

    All ancestors of a shared ancestor are shared, so it is enough to drop the
    parents of shared ancestors.
    """
    above = common.select(*_PAIR, F.col("ancestor_id").alias("child_id")).join(
        parents.select("tree_id", "child_id", F.col("parent_id").alias("ancestor_id")),
        ["tree_id", "child_id"],
    ).select(*_PAIR, "ancestor_id").distinct()
    return common.join(above, [*_PAIR, "ancestor_id"], "left_anti")


def path_distances(parents: DataFrame, asked: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Length of the shortest path of every (from_id, to_id) that are related.

    It is the smallest sum of the two depths over the shared apexes (an end may be
    the apex): where the two ways to an apex meet below it, the meeting point is a
    nearer apex. ``ancestors``: closure of all ends; computed where it is not given.
    """
    asked = asked.select(*_PAIR).distinct()
    ends = _ends(asked)
    above = closure(parents, ends) if ancestors is None else ancestors.join(ends, ["tree_id", "focal_id"], "left_semi")
    every = with_self(above, ends)
    a = every.select("tree_id", F.col("focal_id").alias("from_id"), "person_id", F.col("min_depth").alias("d1"))
    b = every.select("tree_id", F.col("focal_id").alias("to_id"), "person_id", F.col("min_depth").alias("d2"))
    return (
        asked.join(a, ["tree_id", "from_id"]).join(b, ["tree_id", "to_id", "person_id"])
        .groupBy(*_PAIR).agg(F.min(F.col("d1") + F.col("d2")).cast("int").alias("distance"))
    )


def nearest_common_ancestors(parents: DataFrame, pairs: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """Nearest common ancestors: (tree_id, from_id, to_id, ancestor_id, gen_from, gen_to).

    ``ancestors``: closure of everybody in the trees asked; without it, the
    closures of the ends and of the ancestors found are computed.
    """
    known = closure(parents, _ends(pairs)) if ancestors is None else ancestors
    nearest, _ = cut(nearest_common(parents, common_ancestors(known, pairs)))
    legs = nearest.select("tree_id", "from_id", F.col("ancestor_id").alias("to_id")).unionByName(
        nearest.select("tree_id", F.col("to_id").alias("from_id"), F.col("ancestor_id").alias("to_id"))
    ).distinct()
    dist, _ = cut(path_distances(parents, legs, ancestors))
    one = dist.select("tree_id", "from_id", F.col("to_id").alias("ancestor_id"), F.col("distance").alias("gen_from"))
    two = dist.select(
        "tree_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("ancestor_id"),
        F.col("distance").alias("gen_to"),
    )
    return (
        nearest.select(*_PAIR, "ancestor_id")
        .join(one, ["tree_id", "from_id", "ancestor_id"], "left")
        .join(two, ["tree_id", "to_id", "ancestor_id"], "left")
        .select(*_PAIR, "ancestor_id", "gen_from", "gen_to")
    )


def describe_relationships(
    parents: DataFrame, person: DataFrame, pairs: DataFrame, everybody: DataFrame | None = None
) -> DataFrame:
    """Kinship term of ``to_id`` as seen from ``from_id`` for every asked pair.

    ``everybody``: ancestor closure of all people in the trees asked, if it is at hand.
    """
    asked = pairs.select(*_PAIR).distinct()
    ancestors = cut(closure(parents, _ends(asked)))[0] if everybody is None else everybody
    up = ancestors.select(
        "tree_id", F.col("focal_id").alias("from_id"), F.col("person_id").alias("to_id"),
        F.col("min_depth").alias("up"),
    )
    down = ancestors.select(
        "tree_id", F.col("focal_id").alias("to_id"), F.col("person_id").alias("from_id"),
        F.col("min_depth").alias("down"),
    )
    lineal, _ = cut(asked.join(up, _PAIR, "left").join(down, _PAIR, "left"))
    collateral = lineal.where(
        F.col("up").isNull() & F.col("down").isNull() & (F.col("from_id") != F.col("to_id"))
    )
    shared = nearest_common_ancestors(parents, collateral, everybody)
    total = F.col("gen_from") + F.col("gen_to")
    rank = F.struct(total.isNull().alias("far"), total.alias("total"), F.col("ancestor_id").alias("id"))
    best = shared.groupBy(*_PAIR).agg(F.min_by(F.struct("gen_from", "gen_to"), rank).alias("best"))
    sex = person.select("tree_id", F.col("person_id").alias("to_id"), "sex")
    a, b = F.col("best.gen_from"), F.col("best.gen_to")
    who = F.coalesce("sex", F.lit("unknown"))
    return (
        lineal.join(best, _PAIR, "left").join(sex, ["tree_id", "to_id"], "left")
        .select(
            *_PAIR,
            F.when(F.col("from_id") == F.col("to_id"), "self")
            .when(F.col("up").isNotNull(), ancestor_term(F.col("up"), who))
            .when(F.col("down").isNotNull(), descendant_term(F.col("down"), who))
            .when(a.isNotNull() & b.isNotNull(), collateral_term(a, b, who))
            .otherwise(UNRELATED).alias("term"),
        )
    )


def collapse_report(collapse_paths: DataFrame, person: DataFrame, names: DataFrame) -> DataFrame:
    """One line per collapse path: ``your <term> via <first step's name>'s line``."""
    sex = person.select("tree_id", F.col("person_id").alias("ancestor_id"), "sex")
    via = names.select("tree_id", F.col("person_id").alias("via_id"), F.col("name").alias("via_name"))
    title = names.select("tree_id", F.col("person_id").alias("ancestor_id"), F.col("name").alias("ancestor_name"))
    apostrophe = "’s line"
    return (
        collapse_paths.withColumn("via_id", F.element_at("steps", 2))
        .join(sex, ["tree_id", "ancestor_id"]).join(title, ["tree_id", "ancestor_id"])
        .join(via, ["tree_id", "via_id"], "left")
        .select(
            "tree_id", "focal_id", "ancestor_id", "path_no",
            F.concat(
                F.col("ancestor_name"), F.lit(" — reached "), F.col("path_count").cast("string"), F.lit(" ways"),
            ).alias("heading"),
            F.concat(
                F.lit("your "), ancestor_term(F.col("length"), F.col("sex")), F.lit(" via "),
                F.coalesce("via_name", F.lit("unknown")), F.lit(apostrophe),
            ).alias("line"),
        )
    )


def closes_loop(parents: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed (parent_id, child_id) whose parent already descends from the child."""
    asked = proposals.select("tree_id", "parent_id", "child_id").distinct()
    above = closure(parents, asked.select("tree_id", F.col("parent_id").alias("focal_id")))
    return asked.join(
        above.select("tree_id", F.col("focal_id").alias("parent_id"), F.col("person_id").alias("child_id")),
        ["tree_id", "parent_id", "child_id"], "left_semi",
    )
