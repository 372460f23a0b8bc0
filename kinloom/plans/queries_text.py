"""Queries over dates, names, places and military texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import dates, kinship_terms, links, military, names, places
from kinloom.operators import events, profile, views
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, joined, query

SEARCHES = ["sn00", "Household", "ALIAS 9", "jr", "   ", "machinery a."]


@query
def dates_normalised(b: Bridge) -> DataFrame:
    d = b.event_raw().where("date_raw is not null").select("event_id", dates.parse_date(F.col("date_raw")).alias("d"))
    return d.select(
        "event_id", "d.raw", "d.qualifier", big("d.year"), big("d.month"), big("d.day"), "d.iso",
        big("d.range_end.year", "end_year"), big("d.range_end.month", "end_month"),
        big("d.range_end.day", "end_day"), "d.calendar",
    )


@query
def society_dates(b: Bridge) -> DataFrame:
    d = b.event().where("date is not null")
    return d.select(
        "event_id", dates.society_date(F.col("date.year"), F.col("date.month"), F.col("date.day")).alias("label")
    )


@query
def event_sort_keys(b: Bridge) -> DataFrame:
    return b.event().select(
        "event_id", dates.sort_key(F.col("date.year"), F.col("date.month"), F.col("date.day")).alias("sort_key")
    )


@query
def life_lines(b: Bridge) -> DataFrame:
    return profile.life_lines(b.vitals(), b.person_event(), b.event())


@query
def names_parsed(b: Bridge) -> DataFrame:
    n = b.person().select("person_id", F.posexplode("names").alias("pos", "n"))
    return n.select("person_id", big("pos"), "n.raw", "n.given", "n.surname", "n.full", "n.is_primary")


@query
def sexes_parsed(b: Bridge) -> DataFrame:
    return b.person().select("person_id", "sex")


@query
def display_names(b: Bridge) -> DataFrame:
    n = F.col("names")
    return b.person().select(
        "person_id", names.display_name(n).alias("shown"), names.trimmed_name(n).alias("sketch"),
        names.trimmed_name(n, F.col("person_id")).alias("locality"),
    )


@query
def name_search(b: Bridge) -> DataFrame:
    texts = b.spark.createDataFrame([(text,) for text in SEARCHES], "query string")
    return views.search_people(b.person(), b.name_grams(), texts)


@query
def name_search_texts(b: Bridge) -> DataFrame:
    """A text of every part: an alias by its number, or the beginning of a surname."""
    n = F.col("p_partkey")
    text = F.when(n % 2 == 0, F.concat(F.lit("aliaS "), n.cast("string"))).otherwise(
        F.concat(F.lit(" #"), F.lpad((n * 3 / 4).cast("bigint").cast("string"), 6, "0")))
    return views.search_people(b.person(), b.name_grams(), b.source("part").select(text.alias("query")))


@query
def people_list(b: Bridge) -> DataFrame:
    return views.list_people(b.person())


@query
def places_parsed(b: Bridge) -> DataFrame:
    p = b.event_raw().where("place_raw is not null").select("event_id", places.parse_place(F.col("place_raw")).alias("p"))
    return p.select("event_id", "p.raw", "p.normalized", joined("p.parts", "|", "parts"))


@query
def place_dimension(b: Bridge) -> DataFrame:
    return events.place_dimension(b.placed_event()).select(
        "tree_id", "normalized", "raw", joined("parts", "|"), big("uses")
    )


@query
def interned_places(b: Bridge) -> DataFrame:
    return b.placed_event().select("event_id", F.col("place.raw").alias("place_raw"))


@query
def place_regions(b: Bridge) -> DataFrame:
    p = b.placed_event().where("place is not null")
    return p.select("event_id", places.region_of(F.col("place.parts"), F.col("place.raw")).alias("region"))


@query
def state_codes(b: Bridge) -> DataFrame:
    p = b.event_raw().where("place_raw is not null").select(
        "event_id", F.posexplode(F.split("place_raw", ",")).alias("pos", "segment")
    )
    return p.select("event_id", big("pos"), places.state_code(F.col("segment")).alias("code"))


@query
def society_places(b: Bridge) -> DataFrame:
    return b.event_raw().select("event_id", places.society_place(F.col("place_raw")).alias("label"))


@query
def place_query_ladder(b: Bridge) -> DataFrame:
    p = b.placed_event().where("place is not null")
    ladder = places.query_ladder(F.col("place.parts"), F.col("place.raw"))
    return p.select("event_id", F.posexplode(ladder).alias("rung", "query")).withColumn("rung", big("rung"))


@query
def war_classes(b: Bridge) -> DataFrame:
    y = F.col("date.year")
    return b.event().where(y.isNotNull()).select("event_id", big("date.year"), military.war_of_year(y).alias("war"))


@query
def service_records(b: Bridge) -> DataFrame:
    m = events.military_events(b.person_event(), b.event_participant(), b.event())
    return events.service_records(m).select(
        "person_id", "event_id", "raw", "war", "branch", "rank", "unit", "service_raw",
        big("start_year"), big("end_year"),
    )


@query
def military_service(b: Bridge) -> DataFrame:
    return b.service().select("person_id", big("events"), joined("wars", "|"))


@query
def ordinal_terms(b: Bridge) -> DataFrame:
    n = F.col("n")
    return b.source("part").select("p_partkey", (F.col("p_partkey") % 130).alias("n")).select(
        "p_partkey", kinship_terms.ordinal(n).alias("ordinal"), kinship_terms.ordinal_word(n).alias("word"),
        kinship_terms.removal_word(n).alias("times"), kinship_terms.great_prefix(n).alias("great"),
    )


@query
def lineal_terms(b: Bridge) -> DataFrame:
    g = F.col("g")
    rows = b.person().select("person_id", "sex", (F.col("seq") % 24 + 1).alias("g"))
    return rows.select(
        "person_id", kinship_terms.ancestor_term(g, F.col("sex")).alias("up"),
        kinship_terms.descendant_term(g, F.col("sex")).alias("down"),
    )


def _facts(b: Bridge) -> DataFrame:
    return profile.research_facts(b.person(), b.parents(), b.spouses(), b.vitals())


@query
def research_facts(b: Bridge) -> DataFrame:
    full = lambda c: F.transform(c, lambda x: x["full"])
    return _facts(b).select(
        "person_id", F.col("facts.self.full").alias("full_name"), "facts.sex", big("facts.birth_year"),
        "facts.birth_raw", big("facts.death_year"), "facts.death_raw",
        F.col("facts.father.full").alias("father"), F.col("facts.mother.full").alias("mother"),
        F.col("facts.spouse.full").alias("spouse"), F.array_join(full("facts.spouses"), "|").alias("spouses"),
        F.array_join(full("facts.children"), "|").alias("children"),
    )


@query
def research_relatives(b: Bridge) -> DataFrame:
    return profile.relatives(b.person(), b.parents(), b.spouses()).select(
        "person_id", "role", "position", "other_id", "full"
    )


@query
def search_links(b: Bridge) -> DataFrame:
    f = F.col("facts")
    return _facts(b).select(
        "person_id", links.ancestry_url(f).alias("ancestry"), links.familysearch_url(f).alias("familysearch"),
        links.dar_url().alias("dar"),
    )


@query
def person_sketch(b: Bridge) -> DataFrame:
    s = profile.person_sketch(b.person(), b.parents(), b.spouses(), b.vitals(), b.service())
    return s.select(
        "person_id", "name", "sex", "birth_raw", big("birth_year"), "birth_place", "death_raw", big("death_year"),
        "death_place", big("age_at_death"), "spouses", "children", "served", joined("wars", "|"),
    )


@query
def society_vitals(b: Bridge) -> DataFrame:
    from kinloom.operators.society import vitals_lines

    return vitals_lines(b.vitals()).select("person_id", "vitals")
