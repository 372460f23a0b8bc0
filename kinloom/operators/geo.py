"""Place resolution as joins on gazetteer tables.

A provider is a callable ``DataFrame(place_key, raw, parts) -> DataFrame(place_key,
lat, lon, source, confidence, resolved_name)``; any further source of coordinates
can be added to the chain in that form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.places import query_ladder
from kinloom.operators.lineage import cut

Provider = Callable[[DataFrame], DataFrame]

# Confidence when the provider gives none.
LADDER_CONFIDENCE = 0.5
FALLBACK_CONFIDENCE = 0.45
RESOLVED = ["place_key", "lat", "lon", "source", "confidence", "resolved_name"]


def distinct_places(stops: DataFrame) -> DataFrame:
    """Distinct non-empty places, one row per normal form over the whole corpus."""
    return stops.where(F.col("place_key") != "").groupBy("place_key").agg(
        F.min(F.struct("raw", "parts")).alias("first")
    ).select("place_key", "first.raw", "first.parts")


def new_places(places: DataFrame, known: DataFrame) -> DataFrame:
    return places.where(F.col("place_key") != "").join(known.select("place_key"), "place_key", "left_anti")


def static_lookup(table: DataFrame) -> Provider:
    """Hand-verified table keyed by the normal form: (place_key, lat, lon, confidence, resolved_name)."""

    def resolve(places: DataFrame) -> DataFrame:
        return places.join(table, "place_key").select(
            "place_key", "lat", "lon", F.lit("manual").alias("source"),
            F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
            F.coalesce("resolved_name", "raw").alias("resolved_name"),
        )

    return resolve


def query_candidates(places: DataFrame) -> DataFrame:
    """Lookup texts per place: (place_key, rung, query); the normal form when there is none."""
    ladder = query_ladder(F.col("parts"), F.col("raw"))
    texts = F.when(F.size(ladder) > 0, ladder).otherwise(F.array("place_key"))
    return places.select("place_key", F.posexplode(texts).alias("rung", "query"))


def ladder_lookup(table: DataFrame, source: str, fixed_confidence: float | None = None) -> Provider:
    """First rung of the query ladder found in ``table(query, lat, lon, importance, resolved_name)``."""
    good = F.col("importance").between(0, 1)
    confidence = (
        F.when(good, F.col("importance")).otherwise(F.lit(LADDER_CONFIDENCE))
        if fixed_confidence is None else F.lit(fixed_confidence)
    )

    def resolve(places: DataFrame) -> DataFrame:
        hits = query_candidates(places).withColumn("query", F.lower("query")).join(table, "query")
        best = F.min_by(F.struct("lat", "lon", confidence.alias("confidence"), "resolved_name"), "rung").alias("hit")
        return hits.groupBy("place_key").agg(best).select(
            "place_key", "hit.lat", "hit.lon", F.lit(source).alias("source"),
            "hit.confidence", "hit.resolved_name",
        )

    return resolve


def resolve_places(
    places: DataFrame, cache: DataFrame, providers: list[Provider], available: list[bool] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cache first, then the providers in order; returns (resolved, new cache rows).

    A provider that is not available is skipped whole. Each provider only sees the
    places still open, so every place is looked up once per provider at most.
    """
    found = static_lookup(cache)(places).select(*RESOLVED)
    fresh: DataFrame | None = None
    todo, _ = cut(places.join(cache.select("place_key"), "place_key", "left_anti"))
    for n, provider in enumerate(providers):
        if available is not None and not available[n]:
            continue
        hits, _ = cut(provider(todo).select(*RESOLVED))
        fresh = hits if fresh is None else fresh.unionByName(hits)
        todo = todo.join(hits.select("place_key"), "place_key", "left_anti")
    if fresh is None:
        fresh = found.where(F.lit(False))
    write_back = fresh.select("place_key", "lat", "lon", "confidence", "resolved_name")
    return found.unionByName(fresh), write_back
