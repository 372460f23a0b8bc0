"""Typed person-to-person edges from families, and one-hop questions on them.

Every table carries ``tree_id``; joins run on ``(tree_id, id)`` so that one very
large tree spreads over all tasks.

``parent_of(tree_id, parent_id, child_id, family_id, fseq, pord, cord)``
``spouse_of(tree_id, a_id, b_id, family_id, fseq, aord, bord)`` with ``a_id < b_id``

``fseq`` is the family's place in the file, ``pord``/``cord`` the positions inside
the family. Parents of a child come in ``(fseq, pord)`` order, children of a
parent in ``(fseq, cord)`` order; no dense numbering is needed for ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.numbering import number_rows


def _members(links: DataFrame, person: DataFrame, who: str, order: str) -> DataFrame:
    known = person.select("tree_id", "person_id")
    return links.join(known, ["tree_id", "person_id"], "left_semi").select(
        "tree_id", "family_id", F.col("person_id").alias(who), F.col("ord").alias(order)
    )


def parent_of(
    person: DataFrame, family: DataFrame, family_spouse: DataFrame, family_child: DataFrame
) -> DataFrame:
    """Every existing parent x every existing child of a family, first family wins."""
    parents = _members(family_spouse, person, "parent_id", "pord").join(
        family.select("tree_id", "family_id", F.col("seq").alias("fseq")), ["tree_id", "family_id"]
    )
    children = _members(family_child, person, "child_id", "cord")
    first = F.min(F.struct("fseq", "pord", "cord", "family_id")).alias("at")
    return (
        parents.join(children, ["tree_id", "family_id"])
        .groupBy("tree_id", "parent_id", "child_id").agg(first)
        .select("tree_id", "parent_id", "child_id", "at.family_id", "at.fseq", "at.pord", "at.cord")
    )


def spouse_of(person: DataFrame, family: DataFrame, family_spouse: DataFrame) -> DataFrame:
    """Every unordered pair of existing spouses, stored once, first family wins.

    Families record two spouses as a rule; the join is on the family key and
    only keeps pairs in position order.
    """
    spouses = _members(family_spouse, person, "person_id", "ord")
    left = spouses.select("tree_id", "family_id", F.col("person_id").alias("p"), F.col("ord").alias("po"))
    right = spouses.select("tree_id", "family_id", F.col("person_id").alias("q"), F.col("ord").alias("qo"))
    flip = F.col("p") < F.col("q")
    pairs = left.join(right, ["tree_id", "family_id"]).where(
        (F.col("po") < F.col("qo")) & (F.col("p") != F.col("q"))
    )
    order = family.select("tree_id", "family_id", F.col("seq").alias("fseq"))
    first = F.min(F.struct("fseq", "po", "qo", "family_id", "flip")).alias("at")
    aord = F.when(F.col("at.flip"), F.col("at.po")).otherwise(F.col("at.qo"))
    bord = F.when(F.col("at.flip"), F.col("at.qo")).otherwise(F.col("at.po"))
    return (
        pairs.join(order, ["tree_id", "family_id"])
        .withColumn("flip", flip)
        .withColumn("a_id", F.least("p", "q")).withColumn("b_id", F.greatest("p", "q"))
        .groupBy("tree_id", "a_id", "b_id").agg(first)
        .select(
            "tree_id", "a_id", "b_id", "at.family_id", "at.fseq",
            aord.alias("aord"), bord.alias("bord"),
        )
    )


def all_edges(parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """The typed edge list; ``parentOf`` of a family comes before its ``spouseOf``."""
    blood = parents.select(
        "tree_id", F.lit("parentOf").alias("type"), F.col("parent_id").alias("from_id"),
        F.col("child_id").alias("to_id"), "family_id",
    )
    married = spouses.select(
        "tree_id", F.lit("spouseOf").alias("type"), F.col("a_id").alias("from_id"),
        F.col("b_id").alias("to_id"), "family_id",
    )
    return blood.unionByName(married)


def spouse_links(spouses: DataFrame) -> DataFrame:
    """Both directions of the spouse pairs: (tree_id, person_id, spouse_id, fseq, sord, family_id)."""
    one = spouses.select(
        "tree_id", F.col("a_id").alias("person_id"), F.col("b_id").alias("spouse_id"),
        "fseq", F.col("bord").alias("sord"), F.col("aord").alias("oord"), "family_id",
    )
    other = spouses.select(
        "tree_id", F.col("b_id").alias("person_id"), F.col("a_id").alias("spouse_id"),
        "fseq", F.col("aord").alias("sord"), F.col("bord").alias("oord"), "family_id",
    )
    return one.unionByName(other)


def neighbours(parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """Distinct parents, children and spouses: (tree_id, person_id, neighbour_id)."""
    up = parents.select(
        "tree_id", F.col("child_id").alias("person_id"), F.col("parent_id").alias("neighbour_id")
    )
    down = parents.select(
        "tree_id", F.col("parent_id").alias("person_id"), F.col("child_id").alias("neighbour_id")
    )
    across = spouse_links(spouses).select(
        "tree_id", "person_id", F.col("spouse_id").alias("neighbour_id")
    )
    return up.unionByName(down).unionByName(across).distinct()


def adjacency_order(parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """Dense first-seen positions of parents, children and spouses per person."""
    up = parents.select(
        "tree_id", F.lit("parent").alias("kind"), F.col("child_id").alias("person_id"),
        F.col("parent_id").alias("other_id"), "fseq", F.col("pord").alias("o1"), F.col("cord").alias("o2"),
    )
    down = parents.select(
        "tree_id", F.lit("child").alias("kind"), F.col("parent_id").alias("person_id"),
        F.col("child_id").alias("other_id"), "fseq", F.col("pord").alias("o1"), F.col("cord").alias("o2"),
    )
    across = spouse_links(spouses).select(
        "tree_id", F.lit("spouse").alias("kind"), "person_id", F.col("spouse_id").alias("other_id"),
        "fseq", F.least("sord", "oord").alias("o1"), F.greatest("sord", "oord").alias("o2"),
    )
    rows = up.unionByName(down).unionByName(across)
    return number_rows(rows, ["tree_id", "kind", "person_id"], ["fseq", "o1", "o2"], "position").select(
        "tree_id", "kind", "person_id", "other_id", "position"
    )


def siblings(parents: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Full and half siblings, with the order in which parents' child lists name them."""
    mine = parents.select(
        "tree_id", F.col("child_id").alias("person_id"), "parent_id",
        F.col("fseq").alias("f1"), F.col("pord").alias("p1"),
    )
    if people is not None:
        mine = mine.join(people.select("tree_id", "person_id"), ["tree_id", "person_id"], "left_semi")
    theirs = parents.select(
        "tree_id", "parent_id", F.col("child_id").alias("sibling_id"),
        F.col("fseq").alias("f2"), F.col("cord").alias("c2"),
    )
    return (
        mine.join(theirs, ["tree_id", "parent_id"])
        .where(F.col("person_id") != F.col("sibling_id"))
        .groupBy("tree_id", "person_id", "sibling_id")
        .agg(F.min(F.struct("f1", "p1", "f2", "c2")).alias("order_key"))
    )


def degrees(person: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """Parents + children + spouses of every person, and whether they have no children."""
    tag = lambda who, df, child: df.select(
        "tree_id", F.col(who).alias("person_id"), F.lit(child).alias("as_parent")
    )
    ends = (
        tag("parent_id", parents, 1).unionByName(tag("child_id", parents, 0))
        .unionByName(tag("a_id", spouses, 0)).unionByName(tag("b_id", spouses, 0))
    )
    counted = ends.groupBy("tree_id", "person_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("as_parent").alias("kids")
    )
    return person.select("tree_id", "person_id").join(counted, ["tree_id", "person_id"], "left").select(
        "tree_id", "person_id",
        F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
        (F.coalesce("kids", F.lit(0)) == 0).alias("is_leaf"),
    )


def parent_child_family(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Family that carries each asked (parent_id, child_id) link, null when none does."""
    return pairs.select("tree_id", "parent_id", "child_id").join(
        parents.select("tree_id", "parent_id", "child_id", "family_id"),
        ["tree_id", "parent_id", "child_id"], "left",
    )


def spouse_family(spouses: DataFrame, pairs: DataFrame) -> DataFrame:
    """Family that carries each asked (a_id, b_id) marriage, in either order."""
    asked = pairs.select(
        "tree_id", "a_id", "b_id", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi")
    )
    known = spouses.select(
        "tree_id", F.col("a_id").alias("lo"), F.col("b_id").alias("hi"), "family_id"
    )
    return asked.join(known, ["tree_id", "lo", "hi"], "left").drop("lo", "hi")


def co_parents(person: DataFrame, family_spouse: DataFrame, asked: DataFrame) -> DataFrame:
    """Existing spouses of a family besides the asked parent: one row per co-parent."""
    others = _members(family_spouse, person, "co_parent_id", "ord")
    return (
        asked.select("tree_id", "family_id", "parent_id")
        .join(others, ["tree_id", "family_id"])
        .where(F.col("co_parent_id") != F.col("parent_id"))
    )
