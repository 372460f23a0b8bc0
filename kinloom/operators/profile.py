"""One row per person: sketch and research facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.dates import life_span
from kinloom.functions.names import display_name, trimmed_name
from kinloom.functions.places import place_head
from kinloom.functions.text import blank_to_null, trim
from kinloom.operators.graph import spouse_links
from kinloom.operators.numbering import number_rows

_PERSON = ["tree_id", "person_id"]
_NAME = "struct<given:string,surname:string,full:string>"


def display_names(person: DataFrame) -> DataFrame:
    return person.select(*_PERSON, display_name(F.col("names")).alias("name"))


def person_sketch(
    person: DataFrame, parents: DataFrame, spouses: DataFrame, vitals: DataFrame, service: DataFrame
) -> DataFrame:
    """Name, sex, vital facts, age, spouse and child counts and wars of every person.

    The spouses themselves are rows of ``relatives``.
    """
    name = person.select(*_PERSON, trimmed_name(F.col("names")).alias("name"))
    wed = spouse_links(spouses).groupBy(*_PERSON).agg(F.count(F.lit(1)).alias("spouses"))
    kids = parents.groupBy("tree_id", F.col("parent_id").alias("person_id")).agg(
        F.count(F.lit(1)).alias("children")
    )
    by, dy = F.col("birth.date.year"), F.col("death.date.year")
    return (
        person.select(*_PERSON, "sex").join(name, _PERSON).join(vitals, _PERSON, "left")
        .join(wed, _PERSON, "left").join(kids, _PERSON, "left")
        .join(service.select(*_PERSON, "wars", F.lit(True).alias("served")), _PERSON, "left")
        .select(
            *_PERSON, "name", "sex",
            blank_to_null(F.col("birth.date.raw")).alias("birth_raw"), by.alias("birth_year"),
            blank_to_null(F.col("birth.place.raw")).alias("birth_place"),
            blank_to_null(F.col("death.date.raw")).alias("death_raw"), dy.alias("death_year"),
            blank_to_null(F.col("death.place.raw")).alias("death_place"),
            (dy - by).alias("age_at_death"),
            F.coalesce("spouses", F.lit(0)).cast("bigint").alias("spouses"),
            F.coalesce("children", F.lit(0)).cast("bigint").alias("children"),
            F.coalesce("served", F.lit(False)).alias("served"),
            F.coalesce("wars", F.array().cast("array<string>")).alias("wars"),
        )
    )


def life_lines(vitals: DataFrame, person_event: DataFrame, event: DataFrame) -> DataFrame:
    """Life span text and primary place of every person."""
    located = event.where(F.col("place").isNotNull()).select("tree_id", "event_id", "place")
    first = person_event.join(located, ["tree_id", "event_id"]).groupBy(*_PERSON).agg(
        F.min_by("place", "ord").alias("first_place")
    )
    place = F.coalesce("birth.place", "first_place")
    return vitals.join(first, _PERSON, "left").select(
        *_PERSON, life_span(F.col("birth.date.year"), F.col("death.date.year")).alias("life_span"),
        F.coalesce(place_head(place["parts"], place["raw"]), F.lit("")).alias("primary_place"),
    )


def _name_parts(names):
    first = F.try_element_at(names, F.lit(1))
    tidy = lambda c: F.coalesce(trim(c), F.lit(""))
    return F.struct(
        tidy(first["given"]).alias("given"), tidy(first["surname"]).alias("surname"),
        tidy(F.coalesce(blank_to_null(first["full"]), first["raw"])).alias("full"),
    )


def _kin(person: DataFrame, parents: DataFrame, spouses: DataFrame) -> dict[str, DataFrame]:
    """Named parents, spouses and children of each person: (.., k1, k2, other_id, other_sex, other)."""
    names = person.select("tree_id", F.col("person_id").alias("other_id"), F.col("sex").alias("other_sex"),
                          _name_parts(F.col("names")).alias("other"))
    hop = lambda df, me, other, k2: df.select(
        "tree_id", F.col(me).alias("person_id"), F.col(other).alias("other_id"), F.col("fseq").alias("k1"), F.col(k2).alias("k2")
    ).join(names, ["tree_id", "other_id"])
    return {
        "parent": hop(parents, "child_id", "parent_id", "pord"),
        "spouse": hop(spouse_links(spouses), "person_id", "spouse_id", "sord"),
        "child": hop(parents, "parent_id", "child_id", "cord"),
    }


def relatives(person: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """One row per relative: (tree_id, person_id, role, position, other_id, full)."""
    rows = None
    for role, df in _kin(person, parents, spouses).items():
        part = df.select(*_PERSON, F.lit(role).alias("role"), "k1", "k2", "other_id", F.col("other.full").alias("full"))
        rows = part if rows is None else rows.unionByName(part)
    numbered = number_rows(rows, ["tree_id", "person_id", "role"], ["k1", "k2", "other_id"], "position")
    return numbered.select(*_PERSON, "role", "position", "other_id", "full")


def _kin_list(df: DataFrame, name: str, count: int | None = None) -> DataFrame:
    """The relatives of one person in order, as an array; with ``count`` the first ones only."""
    order = Window.partitionBy(*_PERSON).orderBy("k1", "k2", "other_id")
    few = df.withColumn("_at", F.row_number().over(order))
    few = few if count is None else few.where(F.col("_at") <= count)
    return few.groupBy(*_PERSON).agg(F.sort_array(F.collect_list(F.struct("_at", "other_sex", "other"))).alias(name))


def research_facts(
    person: DataFrame, parents: DataFrame, spouses: DataFrame, vitals: DataFrame
) -> DataFrame:
    """Everything a search form takes, one row per person (column ``facts``).

    Each parent fills one of the two parent slots, so the first two decide: a
    first woman is the mother, anyone else the father, the second takes the other
    slot. ``spouse`` is the first of ``spouses``; spouses and children are complete,
    what a search form takes of them is up to its link.
    """
    kin = _kin(person, parents, spouses)
    folks, wed = _kin_list(kin["parent"], "ps", 2), _kin_list(kin["spouse"], "ws")
    kids = _kin_list(kin["child"], "cs")
    at = lambda c, i: F.try_element_at(F.col(c), F.lit(i))["other"]
    woman = F.try_element_at(F.col("ps"), F.lit(1))["other_sex"] == "female"
    none = F.array().cast(f"array<{_NAME}>")
    names = person.select(*_PERSON, "sex", _name_parts(F.col("names")).alias("n"))
    return (
        names.join(vitals, _PERSON, "left").join(folks, _PERSON, "left").join(wed, _PERSON, "left")
        .join(kids, _PERSON, "left")
        .select(
            *_PERSON,
            F.struct(
                F.col("n").alias("self"), "sex",
                F.col("birth.date.year").alias("birth_year"), F.col("birth.place.parts").alias("birth_parts"),
                F.col("birth.place.raw").alias("birth_raw"),
                F.col("death.date.year").alias("death_year"), F.col("death.place.parts").alias("death_parts"),
                F.col("death.place.raw").alias("death_raw"),
                F.when(woman, at("ps", 2)).otherwise(at("ps", 1)).alias("father"),
                F.when(woman, at("ps", 1)).otherwise(at("ps", 2)).alias("mother"), at("ws", 1).alias("spouse"),
                F.coalesce(F.transform("ws", lambda c: c["other"]), none).alias("spouses"),
                F.coalesce(F.transform("cs", lambda c: c["other"]), none).alias("children"),
            ).alias("facts"),
        )
    )
