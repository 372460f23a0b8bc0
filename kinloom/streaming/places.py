"""Place resolution with a growing cache over a stream of located events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.operators.geo import Provider, distinct_places, new_places, resolve_places

CACHE_SCHEMA = "place_key string, lat double, lon double, confidence double, resolved_name string"


def read_cache(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Cached coordinates, with ``before`` only those of earlier batches; an empty table before the first batch.

    A batch that is run again must not see what its first run has cached: it would find nothing to do and
    then replace that part by nothing.
    """
    parts = spark.read.schema(CACHE_SCHEMA + ", batch_id bigint").option("ignoreMissingFiles", "true").parquet(path)
    known = parts if before is None else parts.where(parts["batch_id"] < before)
    return known.drop("batch_id").dropDuplicates(["place_key"])


def resolve_batch(batch: DataFrame, batch_id: int, cache_path: str, providers: list[Provider]) -> None:
    """Resolve the new places of one batch into its part of the cache; running it again gives the same part."""
    cache = read_cache(batch.sparkSession, cache_path, batch_id).persist()
    todo = new_places(distinct_places(batch), cache)
    _, found = resolve_places(todo, cache, providers)
    found.write.mode("overwrite").parquet(f"{cache_path}/batch_id={batch_id}")
    cache.unpersist()


def resolve_stream(places: DataFrame, cache_path: str, checkpoint: str, providers: list[Provider], seed: DataFrame):
    """Resolve each new place once. ``places(place_key, raw, parts)``; the seed is batch -1."""
    spark = places.sparkSession
    seed.select("place_key", "lat", "lon", "confidence", "resolved_name").write.mode("overwrite").parquet(
        f"{cache_path}/batch_id=-1"
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        resolve_batch(batch, batch_id, cache_path, providers)

    return (
        places.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
