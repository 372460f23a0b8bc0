"""Queries over the relationship graph, its paths and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import closure as cl
from kinloom.operators import graph, kinship, loops, maintain, paths, views
from kinloom.operators.lineage import cut
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, joined, query


@query
def pedigree_collapse(b: Bridge) -> DataFrame:
    return paths.pedigree_collapse(b.parents(), b.focals()).select(
        "tree_id", "focal_id", "ancestor_id", big("path_count"), big("min_length")
    )


@query
def collapse_paths(b: Bridge) -> DataFrame:
    return paths.collapse_paths(b.parents(), b.focals(), None).select(
        "tree_id", "focal_id", "ancestor_id", big("path_no"), big("length"), joined("steps"), "path_count"
    )


@query
def collapse_report(b: Bridge) -> DataFrame:
    listed = paths.collapse_paths(b.parents(), b.focals(), None)
    return kinship.collapse_report(listed, b.person(), b.names()).withColumn("path_no", big("path_no"))


@query
def graph_edges(b: Bridge) -> DataFrame:
    return graph.all_edges(b.parents(), b.spouses())


@query
def adjacency_order(b: Bridge) -> DataFrame:
    return graph.adjacency_order(b.parents(), b.spouses())


@query
def ancestor_closure(b: Bridge) -> DataFrame:
    return cl.closure(b.parents(), b.focals()).withColumn("min_depth", big("min_depth"))


@query
def ancestors_two_generations(b: Bridge) -> DataFrame:
    return cl.closure(b.parents(), b.focals(), max_depth=2).withColumn("min_depth", big("min_depth"))


@query
def descendant_closure(b: Bridge) -> DataFrame:
    return cl.closure(b.parents(), b.focals(), "down").withColumn("min_depth", big("min_depth"))


@query
def focal_generations(b: Bridge) -> DataFrame:
    return cl.focal_generations(b.ancestors(), b.descendants(), b.focals()).withColumn("generation", big("generation"))


@query
def siblings(b: Bridge) -> DataFrame:
    return graph.siblings(b.parents()).select("tree_id", "person_id", "sibling_id")


@query
def neighbours(b: Bridge) -> DataFrame:
    return graph.neighbours(b.parents(), b.spouses())


@query
def degrees_and_leaves(b: Bridge) -> DataFrame:
    return graph.degrees(b.person_raw(), b.parents(), b.spouses())


@query
def path_counts(b: Bridge) -> DataFrame:
    return cl.path_counts(b.parents(), b.focals()).groupBy("tree_id", "focal_id", "ancestor_id").agg(
        F.sum("paths").cast("bigint").alias("paths")
    )


def _with_edits(b: Bridge) -> tuple[DataFrame, DataFrame]:
    """The parent links before and after the links and unlinks of the edits."""
    before = b.parents().select("tree_id", "parent_id", "child_id", "family_id")
    edits = b.ops().where("relation = 'parent-child'")
    gone = edits.where("kind = 'unlinkRelationship'").select("tree_id", "family_id", "child_id")
    made = edits.where("kind = 'linkRelationship' and parent_id <> child_id").select("tree_id", "parent_id", "child_id")
    for end in ("parent_id", "child_id"):
        made = made.join(b.person_raw().select("tree_id", F.col("person_id").alias(end)), ["tree_id", end], "left_semi").select(*made.columns)
    links = before.join(gone, ["tree_id", "family_id", "child_id"], "left_anti").select("tree_id", "parent_id", "child_id")
    return before, cut(links.unionByName(made).distinct())[0]


@query
def maintained_closure(b: Bridge) -> DataFrame:
    """Ancestors of everybody after the links of the edits, from those before."""
    before, after = _with_edits(b)
    added, removed = maintain.link_changes(before, after)
    return maintain.maintained(b.ancestors(), after, added, removed).withColumn("min_depth", big("min_depth"))


@query
def looped_path_counts(b: Bridge) -> DataFrame:
    """Lines by length where a link of every supplier makes a younger person the parent of an older one."""
    a = "(s_suppkey * 15)"
    later = f"({a} div 64 * 64 + ({a} % 64 + 8 + s_suppkey % 10) % 64)"
    person = lambda k: F.concat(F.lit("I"), F.expr(f"cast({k} as string)"))
    zero = F.lit(0)
    back = b.source("supplier").select(
        F.concat(F.lit("T"), F.expr(f"cast({a} div 64 as string)")).alias("tree_id"), person(later).alias("parent_id"), person(a).alias("child_id"),
        F.lit("FS").alias("family_id"), zero.cast("bigint").alias("fseq"), zero.alias("pord"), zero.alias("cord"))
    same = ["tree_id", "parent_id", "child_id"]
    parents = b.parents().select(*same, "family_id", "fseq", "pord", "cord")
    links, _ = cut(parents.unionByName(back.join(parents.select(*same), same, "left_anti").dropDuplicates(same)))
    return loops.looped_path_counts(links, b.focals()).select(
        "tree_id", "focal_id", F.col("node").alias("ancestor_id"), big("depth"), big("paths"))


@query
def ancestral_paths(b: Bridge) -> DataFrame:
    return paths.ancestral_paths(b.parents(), b.lines(), None).select(
        "tree_id", "focal_id", "ancestor_id", big("path_no"), big("length"), joined("steps"), big("path_count")
    )


def _pair_paths(b: Bridge) -> DataFrame:
    return paths.relationship_paths(b.parents(), b.pairs(), None)


@query
def relationship_paths(b: Bridge) -> DataFrame:
    return _pair_paths(b).select(
        "tree_id", "from_id", "to_id", big("path_no"), big("length"), joined("steps"), big("path_count")
    )


@query
def first_relationship_paths(b: Bridge) -> DataFrame:
    """The first two paths of every pair, and how many there are."""
    return paths.relationship_paths(b.parents(), b.pairs(), 2).select(
        "tree_id", "from_id", "to_id", big("path_no"), big("length"), joined("steps"), big("path_count")
    )


@query
def path_listing(b: Bridge) -> DataFrame:
    return paths.names_on_paths(b.parents(), b.pairs(), b.names()).withColumn("path_no", big("path_no"))


@query
def highlighted_people(b: Bridge) -> DataFrame:
    return paths.highlights(b.parents(), b.pairs())[0]


@query
def highlighted_edges(b: Bridge) -> DataFrame:
    return paths.highlights(b.parents(), b.pairs())[1]


@query
def common_ancestors(b: Bridge) -> DataFrame:
    pairs = b.pairs()
    above = cl.closure(b.parents(), kinship._ends(pairs))
    return kinship.common_ancestors(above, pairs).select(
        "tree_id", "from_id", "to_id", "ancestor_id", big("from_depth"), big("to_depth")
    )


@query
def nearest_common_ancestors(b: Bridge) -> DataFrame:
    return kinship.nearest_common_ancestors(b.parents(), b.pairs(), b.ancestors()).select(
        "tree_id", "from_id", "to_id", "ancestor_id", big("gen_from"), big("gen_to")
    )


@query
def relationship_terms(b: Bridge) -> DataFrame:
    return kinship.describe_relationships(b.parents(), b.person(), b.pairs(), b.ancestors())


@query
def loop_closing_links(b: Bridge) -> DataFrame:
    asked = b.pairs().select("tree_id", F.col("from_id").alias("parent_id"), F.col("to_id").alias("child_id"))
    return kinship.closes_loop(b.parents(), asked)


@query
def parent_child_family(b: Bridge) -> DataFrame:
    asked = b.family_child().join(b.family_spouse().select("tree_id", "family_id", F.col("person_id").alias("parent_id")),
                                  ["tree_id", "family_id"])
    asked = asked.select("tree_id", "parent_id", F.col("person_id").alias("child_id")).distinct()
    return graph.parent_child_family(b.parents(), asked)


@query
def spouse_family(b: Bridge) -> DataFrame:
    asked = b.pairs().select("tree_id", F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id"))
    wed = b.spouses().select("tree_id", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return graph.spouse_family(b.spouses(), asked.unionByName(wed).distinct())


@query
def co_parents(b: Bridge) -> DataFrame:
    asked = b.family_spouse().select("tree_id", "family_id", F.col("person_id").alias("parent_id"))
    return graph.co_parents(b.person_raw(), b.family_spouse(), asked).select(
        "tree_id", "family_id", "parent_id", "co_parent_id"
    )


def _ego(b: Bridge, up: int = 4, down: int = 0, budget: int | None = None) -> DataFrame:
    return cut(views.ego_members(b.parents(), b.spouses(), b.person_raw(), b.focals(), up, down, budget=budget))[0]


def _flagged(df: DataFrame) -> DataFrame:
    return df.withColumn("generation", big("generation"))


@query
def ego_nodes(b: Bridge) -> DataFrame:
    ego = _ego(b)
    return _flagged(views.flag_nodes(ego, ego, b.parents(), b.spouses(), b.collapse()))


@query
def ego_edges(b: Bridge) -> DataFrame:
    return views.induced_edges(_ego(b), graph.all_edges(b.parents(), b.spouses()))


@query
def ego_budget(b: Bridge) -> DataFrame:
    return _flagged(_ego(b, up=3, down=2, budget=12))


@query
def blood_edges(b: Bridge) -> DataFrame:
    edges = views.induced_edges(_ego(b, 2, 1), graph.all_edges(b.parents(), b.spouses()))
    return views.blood_edges(edges)


def _expanded(b: Bridge):
    asked = b.focals().withColumn("person_id", F.col("focal_id")).withColumn("direction", F.lit("all"))
    return views.expand(_ego(b, 1), asked, b.parents(), b.spouses(), b.collapse())


@query
def expanded_nodes(b: Bridge) -> DataFrame:
    return _flagged(_expanded(b)[0])


@query
def expanded_edges(b: Bridge) -> DataFrame:
    return _expanded(b)[1]


@query
def sibling_view(b: Bridge) -> DataFrame:
    return views.with_siblings(_ego(b, 2), b.parents(), 20).select("tree_id", "focal_id", "person_id")


@query
def induced_view(b: Bridge) -> DataFrame:
    """Sibling-augmented node set with generations of both directions and flags."""
    members = cut(views.with_siblings(_ego(b, 2, 1), b.parents(), None).select("tree_id", "focal_id", "person_id"))[0]
    gens = cl.focal_generations(b.ancestors(), b.descendants(), b.focals())
    nodes = members.join(gens, ["tree_id", "focal_id", "person_id"], "left")
    return _flagged(views.flag_nodes(nodes, members, b.parents(), b.spouses(), b.collapse()))


@query
def default_focal(b: Bridge) -> DataFrame:
    latest = views.latest_years(b.person_event(), b.event())
    # Every supplier row declares the root person of one tree (not all of them exist).
    roots = b.source("supplier").select(
        F.concat(F.lit("T"), F.expr("cast(s_suppkey * 4 as string)")).alias("tree_id"),
        F.concat(F.lit("I"), F.expr("cast(s_suppkey * 256 + s_nationkey as string)")).alias("root_id"),
    )
    return views.default_focal(b.person_raw(), graph.degrees(b.person_raw(), b.parents(), b.spouses()), latest, roots)


@query
def latest_years(b: Bridge) -> DataFrame:
    return views.latest_years(b.person_event(), b.event()).select("tree_id", "person_id", big("latest_year"))


@query
def next_ids(b: Bridge) -> DataFrame:
    return views.next_ids(b.person_raw(), "I", "person_id").withColumnRenamed("next_id", "next_person").join(
        views.next_ids(b.family(), "FU", "family_id").withColumnRenamed("next_id", "next_family"), "tree_id", "left"
    ).withColumn("next_family", F.coalesce("next_family", F.lit("FU1")))


@query
def ancestor_picker(b: Bridge) -> DataFrame:
    asked = b.focals().withColumn("query", F.lit("")).unionByName(b.focals().withColumn("query", F.lit("mach")))
    return views.pick_ancestors(b.ordered_ancestors(), b.names(), asked).withColumn("rank", big("rank"))
