"""Family statistics over the direct ancestors of every focal person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.places import region_of

_FOCAL = ["tree_id", "focal_id"]


def round1(col):
    return F.floor(col * 10 + 0.5) / 10


def person_facts(vitals: DataFrame, service: DataFrame) -> DataFrame:
    """Small facts per person: age, birth region, served flag, wars."""
    birth, death = F.col("birth.date.year"), F.col("death.date.year")
    region = region_of(F.col("birth.place.parts"), F.col("birth.place.raw"))
    return vitals.select(
        "tree_id", "person_id",
        F.when(death >= birth, death - birth).alias("age"),
        F.when(F.col("birth.place").isNotNull() & (region != ""), region).alias("region"),
    ).join(
        service.select("tree_id", "person_id", "wars", F.lit(True).alias("served")),
        ["tree_id", "person_id"], "left",
    )


def region_tally(facts: DataFrame) -> DataFrame:
    """Birth regions per focal, most people first: (tree_id, focal_id, rank, region, people)."""
    counted = facts.where(F.col("region").isNotNull()).groupBy(*_FOCAL, "region").agg(
        F.count(F.lit(1)).alias("people")
    )
    order = Window.partitionBy(*_FOCAL).orderBy(F.desc("people"), "region")
    return counted.withColumn("rank", F.row_number().over(order))


def war_tally(facts: DataFrame) -> DataFrame:
    return facts.select(*_FOCAL, F.explode("wars").alias("war")).groupBy(*_FOCAL, "war").agg(
        F.count(F.lit(1)).alias("people")
    )


def family_sizes(ancestors: DataFrame, person_fams: DataFrame, family_child: DataFrame) -> DataFrame:
    """Distinct spouse families of the ancestors and their mean child count."""
    sizes = family_child.groupBy("tree_id", "family_id").agg(F.count(F.lit(1)).alias("kids"))
    fams = (
        ancestors.select(*_FOCAL, "person_id").join(person_fams, ["tree_id", "person_id"])
        .select(*_FOCAL, "family_id").distinct()
    )
    joined = fams.join(sizes, ["tree_id", "family_id"], "left")
    return joined.groupBy(*_FOCAL).agg(
        F.count(F.lit(1)).alias("couples"),
        round1(F.sum(F.coalesce("kids", F.lit(0))) / F.count(F.lit(1))).alias("average_children"),
    )


def ancestor_facts(ancestors: DataFrame, facts: DataFrame) -> DataFrame:
    return ancestors.select(*_FOCAL, "person_id", "min_depth").join(facts, ["tree_id", "person_id"], "left")


def longevity(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("age").isNotNull()).groupBy(*_FOCAL).agg(
        F.count(F.lit(1)).alias("aged"), round1(F.avg("age")).alias("average_years"),
        F.percentile("age", F.lit(0.5)).alias("median_years"),
    )


def family_stats(
    focals: DataFrame, ancestors: DataFrame, facts: DataFrame, person_fams: DataFrame, family_child: DataFrame
) -> DataFrame:
    """One row of scalar statistics per focal person."""
    per = ancestor_facts(ancestors, facts)
    core = per.groupBy(*_FOCAL).agg(
        F.count(F.lit(1)).alias("ancestors"), F.max("min_depth").alias("max_generation"),
        F.count("age").alias("aged"), round1(F.avg("age")).alias("average_years"),
        F.percentile("age", F.lit(0.5)).alias("median_years"),
        F.count(F.when(F.col("served"), 1)).alias("served"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (
        focals.select(*_FOCAL).distinct().join(core, _FOCAL, "left")
        .join(family_sizes(ancestors, person_fams, family_child), _FOCAL, "left")
        .select(
            *_FOCAL, zero("ancestors"), zero("max_generation"), zero("aged"), "average_years", "median_years",
            zero("served"), zero("couples"), "average_children",
        )
    )


def data_richness(person: DataFrame, person_event: DataFrame) -> DataFrame:
    """names + events + sources + notes per person."""
    n = person_event.groupBy("tree_id", "person_id").agg(F.count(F.lit(1)).alias("events"))
    total = F.size("names") + F.coalesce("events", F.lit(0)) + F.size("sources")
    total = total + F.coalesce(F.size("notes"), F.lit(0))
    return person.join(n, ["tree_id", "person_id"], "left").select(
        "tree_id", "person_id", total.cast("bigint").alias("richness")
    )


def merge_survivors(richness: DataFrame, pairs: DataFrame) -> DataFrame:
    """Richer record of each (from_id, to_id) pair survives; the first one on a tie."""
    score = lambda end, name: richness.select(
        "tree_id", F.col("person_id").alias(end), F.col("richness").alias(name)
    )
    both = pairs.join(score("from_id", "a"), ["tree_id", "from_id"], "left").join(
        score("to_id", "b"), ["tree_id", "to_id"], "left"
    )
    first = F.coalesce("a", F.lit(0)) >= F.coalesce("b", F.lit(0))
    return both.select(
        "tree_id", "from_id", "to_id", F.when(first, F.col("from_id")).otherwise(F.col("to_id")).alias("keep_id")
    )


