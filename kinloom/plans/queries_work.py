"""Queries over link quality and place resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import geo, quality
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, query


def _as(b: Bridge, first: str, second: str) -> DataFrame:
    return b.pairs().select("tree_id", F.col("from_id").alias(first), F.col("to_id").alias(second))


@query
def parent_child_checks(b: Bridge) -> DataFrame:
    asked = _as(b, "parent_id", "child_id").unionByName(b.parents().select("tree_id", "parent_id", "child_id"))
    return quality.check_parent_child(b.person(), b.parents(), b.vitals(), asked.distinct()).withColumn(
        "issue_no", big("issue_no")
    )


@query
def spouse_checks(b: Bridge) -> DataFrame:
    wed = b.spouses().select("tree_id", "a_id", "b_id")
    blood = b.parents().select("tree_id", F.col("parent_id").alias("a_id"), F.col("child_id").alias("b_id"))
    asked = _as(b, "a_id", "b_id").unionByName(wed).unionByName(blood).distinct()
    return quality.check_spouses(b.person(), b.parents(), b.spouses(), asked).withColumn("issue_no", big("issue_no"))


@query
def link_audit(b: Bridge) -> DataFrame:
    return quality.audit_links(b.person(), b.parents(), b.vitals()).withColumn("issue_no", big("issue_no"))


def _candidates(b: Bridge, role: str) -> DataFrame:
    return quality.candidate_families(b.family(), b.family_spouse(), b.family_child(), b.person_raw(), role).drop("seq")


@query
def families_for_child(b: Bridge) -> DataFrame:
    return _candidates(b, "child")


@query
def families_for_parent(b: Bridge) -> DataFrame:
    return _candidates(b, "parent")


@query
def families_for_spouse(b: Bridge) -> DataFrame:
    return _candidates(b, "spouse")


@query
def families_for_spouse_after_unlinks(b: Bridge) -> DataFrame:
    """Families a new spouse could join once the spouses that edits unlink have left."""
    gone = b.ops().where("kind = 'unlinkRelationship' and relation = 'spouse'").select("tree_id", "family_id", F.col("spouse_a").alias("person_id"))
    left = b.family_spouse().join(gone, ["tree_id", "family_id", "person_id"], "left_anti")
    return quality.candidate_families(b.family(), left, b.family_child(), b.person_raw(), "spouse").drop("seq")


@query
def unlink_parent_impact(b: Bridge) -> DataFrame:
    return quality.unlink_parent_impact(b.person_raw(), b.family_spouse(), b.parents(), b.names())


@query
def unlink_spouse_impact(b: Bridge) -> DataFrame:
    return quality.unlink_spouse_impact(b.spouses(), b.family_child(), b.names())


def _places(b: Bridge) -> DataFrame:
    used = b.event().where("place is not null").select(
        F.col("place.normalized").alias("place_key"), F.col("place.raw").alias("raw"), F.col("place.parts").alias("parts")
    )
    return geo.distinct_places(used)


def _static(b: Bridge) -> DataFrame:
    return b.gazetteer_of("manual").select(
        F.col("query").alias("place_key"), "lat", "lon", F.col("importance").alias("confidence"), "resolved_name"
    )


def _table(b: Bridge, provider: str) -> DataFrame:
    return b.gazetteer_of(provider).select("query", "lat", "lon", "importance", "resolved_name")


def _chain(b: Bridge) -> list[geo.Provider]:
    return [
        geo.ladder_lookup(_table(b, "nominatim"), "nominatim"),
        geo.ladder_lookup(_table(b, "photon"), "photon", geo.FALLBACK_CONFIDENCE),
    ]


@query
def distinct_places(b: Bridge) -> DataFrame:
    return _places(b).select("place_key", "raw")


@query
def static_place_lookup(b: Bridge) -> DataFrame:
    return geo.static_lookup(_static(b))(_places(b))


@query
def ladder_place_lookup(b: Bridge) -> DataFrame:
    return _chain(b)[0](_places(b))


@query
def resolved_places(b: Bridge) -> DataFrame:
    return geo.resolve_places(_places(b), _static(b), _chain(b))[0]


@query
def resolved_without_first_provider(b: Bridge) -> DataFrame:
    return geo.resolve_places(_places(b), _static(b), _chain(b), [False, True])[0]


@query
def place_cache_additions(b: Bridge) -> DataFrame:
    return geo.resolve_places(_places(b), _static(b), _chain(b))[1]


@query
def places_to_resolve(b: Bridge) -> DataFrame:
    return geo.new_places(_places(b), _static(b)).select("place_key")
