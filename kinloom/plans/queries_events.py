"""Queries over events, migration, statistics and research."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import events, paths, research, society, stats
from kinloom.operators.lineage import cut
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, query

LATER_CUTOFF = 1992
SOCIETIES = [*society.SOCIETY_RULES, society.SOCIETY_RULES[0] | {"society_id": "later", "record_copy_cutoff": LATER_CUTOFF}]
LINE = ["tree_id", "focal_id", "ancestor_id"]


@query
def first_events(b: Bridge) -> DataFrame:
    return events.first_events(b.person_event(), b.event()).select(
        "person_id", "type", "event_id", big("date.year", "year")
    )


@query
def all_person_events(b: Bridge) -> DataFrame:
    return events.all_events(b.person_event(), b.person_fams(), b.family_event()).select("person_id", "event_id")


@query
def event_sequence(b: Bridge) -> DataFrame:
    return events.event_sequence(b.located()).select(
        "tree_id", "person_id", "event_id", "type", big("year"), "sort_key", "place_key", "place_raw", "position"
    )


@query
def line_stops(b: Bridge) -> DataFrame:
    asked = b.lines().select("tree_id", F.col("focal_id").alias("from_id"), F.col("ancestor_id").alias("to_id"))
    members = events.line_members(paths.relationship_paths(b.parents(), asked, 1))
    return events.stops_of_people(members, b.located()).select(
        "tree_id", "set_id", "event_id", "person_id", big("year"), "sort_key", "place_key"
    )


def _ancestry(b: Bridge) -> DataFrame:
    return events.ancestry_members(b.ordered_ancestors(), b.focals())


@query
def ancestor_stops(b: Bridge) -> DataFrame:
    """All-ancestor stops per focal, summed up: owners, first and last event, places."""
    return events.stop_totals(_ancestry(b), b.located(), unique=True).withColumnRenamed("set_id", "focal_id")


@query
def ancestor_stop_rows(b: Bridge) -> DataFrame:
    """The stops themselves, each with the nearest person it belongs to."""
    return events.stops_of_people(_ancestry(b), b.located(), unique=True).select(
        "tree_id", F.col("set_id").alias("focal_id"), "event_id", "person_id", big("year"), "sort_key", "place_key")


@query
def unique_stop_places(b: Bridge) -> DataFrame:
    stops = b.located().withColumn("set_id", F.col("person_id"))
    return events.unique_places(stops).select("tree_id", "set_id", "place_key", "place_raw")


def _resolved(b: Bridge) -> DataFrame:
    return events.resolved_stops(b.located(), b.coordinates())


PERSON = ["tree_id", "person_id"]


@query
def resolved_stops(b: Bridge) -> DataFrame:
    return _resolved(b).select("person_id", "event_id", "place_key", "lat", "lon")


@query
def migration_legs(b: Bridge) -> DataFrame:
    return events.migration_legs(_resolved(b), PERSON).select(
        "person_id", "position", "from_event", "to_event", "from_lat", "from_lon", "to_lat", "to_lon"
    )


@query
def stop_time_order(b: Bridge) -> DataFrame:
    return events.time_order(_resolved(b), PERSON).select("person_id", "event_id", "position", "fraction")


@query
def stop_year_range(b: Bridge) -> DataFrame:
    return events.year_range(_resolved(b), PERSON).select("person_id", big("min_year"), big("max_year"), "located")


@query
def time_frames(b: Bridge) -> DataFrame:
    return events.time_frames(events.year_range(_resolved(b), PERSON), PERSON).select("person_id", big("frame_year"))


@query
def visible_per_frame(b: Bridge) -> DataFrame:
    stops = cut(_resolved(b))[0]
    frames = events.time_frames(events.year_range(stops, PERSON), PERSON)
    return events.visible_per_frame(stops, frames, PERSON).select("person_id", big("frame_year"), big("visible"))


@query
def visible_until_1800(b: Bridge) -> DataFrame:
    return events.visible_until(_resolved(b), 1800).select("person_id", "event_id", big("year"))


def _facts(b: Bridge) -> DataFrame:
    return stats.person_facts(b.vitals(), b.service())


@query
def family_stats(b: Bridge) -> DataFrame:
    return stats.family_stats(b.focals(), b.ancestors(), _facts(b), b.person_fams(), b.family_child())


@query
def top_birth_regions(b: Bridge) -> DataFrame:
    """The five most frequent ones of each focal person."""
    return stats.region_tally(stats.ancestor_facts(b.ancestors(), _facts(b))).where("rank <= 5").select(
        "focal_id", big("rank"), "region", "people"
    )


@query
def war_tally(b: Bridge) -> DataFrame:
    return stats.war_tally(stats.ancestor_facts(b.ancestors(), _facts(b))).select("focal_id", "war", "people")


@query
def ancestor_longevity(b: Bridge) -> DataFrame:
    return stats.longevity(stats.ancestor_facts(b.ancestors(), _facts(b))).select(
        "focal_id", "aged", "average_years", "median_years"
    )


@query
def ancestral_family_sizes(b: Bridge) -> DataFrame:
    return stats.family_sizes(b.ancestors(), b.person_fams(), b.family_child()).select(
        "focal_id", "couples", "average_children"
    )


@query
def data_richness(b: Bridge) -> DataFrame:
    return stats.data_richness(b.person(), b.person_event()).select("person_id", "richness")


@query
def merge_survivor_choice(b: Bridge) -> DataFrame:
    return stats.merge_survivors(stats.data_richness(b.person(), b.person_event()), b.pairs())


def _on_line(b: Bridge) -> DataFrame:
    return cut(research.people_on_line(b.ancestors(), b.lines()))[0]


def _person_research(b: Bridge) -> DataFrame:
    return research.person_facts(b.person(), b.person_event(), b.person_fams(), b.family_event(), b.event())


@query
def people_on_line(b: Bridge) -> DataFrame:
    return research.people_on_line(b.ancestors(), b.lines()).drop("depth")


@query
def research_person_facts(b: Bridge) -> DataFrame:
    return _person_research(b).select(
        "person_id", "person_name", "event_id", "type", "date_raw", big("year"), "place_key", "place_label", "status"
    )


@query
def locality_report(b: Bridge) -> DataFrame:
    return research.locality_of_lines(b.parents(), b.lines(), _person_research(b)).select(
        *LINE, big("place_no"), "place_key", "place_label", "facts", "people", "is_target"
    )


@query
def research_gaps(b: Bridge) -> DataFrame:
    return research.gap_counts(_on_line(b), _person_research(b))


@query
def research_plan_lines(b: Bridge) -> DataFrame:
    titles = b.lines().withColumn("title", F.concat_ws(" to ", "focal_id", "ancestor_id"))
    plan = research.plan_of_lines(b.parents(), titles, _person_research(b))
    return plan.withColumn("section", big("section")).withColumn("item", big("item"))


def _links(b: Bridge) -> DataFrame:
    return cut(society.checklist_links(b.parents(), _on_line(b)))[0]


@query
def checklist_links(b: Bridge) -> DataFrame:
    return _links(b).select(*LINE, "link_key", big("generation"), big("link_no"))


@query
def checklist_reach(b: Bridge) -> DataFrame:
    return society.reachability(b.lines(), _on_line(b))


def _evaluated(b: Bridge) -> DataFrame:
    return society.evaluate_items(society.checklist_items(b.lines(), _links(b)), b.proofs())


@query
def checklist_items(b: Bridge) -> DataFrame:
    return _evaluated(b).select(
        *LINE, "link_key", "status", "doc_id", "record_copy", "insufficient", "citation"
    )


@query
def checklist_summary(b: Bridge) -> DataFrame:
    return society.checklist_summary(_evaluated(b))


def _by_society(b: Bridge) -> DataFrame:
    rules = society.society_rules(b.spark, SOCIETIES)
    ids = F.array(*[F.lit(r["society_id"]) for r in SOCIETIES])
    asked = b.lines().withColumn("society_id", F.explode(ids))
    return society.evaluate_applications(society.checklist_items(b.lines(), _links(b)), b.proofs(), asked, rules)


@query
def society_checklists(b: Bridge) -> DataFrame:
    """Every line as an application to two societies that take record copies from different years on."""
    return _by_society(b).select(
        *LINE, "society_id", "link_key", "status", "doc_id", "record_copy", "insufficient", "citation"
    )


@query
def society_totals(b: Bridge) -> DataFrame:
    return society.checklist_summary(_by_society(b), by_society=True)


@query
def record_copy_spans(b: Bridge) -> DataFrame:
    links = _links(b)
    spans = links.select(*LINE, F.col("link_key").alias("start_key"), (F.col("generation") % 3 + 1).alias("generations"))
    own = b.lines().select(*LINE, F.lit("service").alias("start_key"), F.lit(2).alias("generations"))
    return society.record_copy_span(links, spans.unionByName(own)).select(
        *LINE, "start_key", big("generations"), "link_key"
    )


