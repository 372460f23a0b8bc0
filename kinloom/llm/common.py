"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_fields(df: DataFrame, value: Column, fields: dict[str, str]) -> DataFrame:
    """``df`` plus fields of a struct column; a column of ``df`` that has such a name gives way to the new one."""
    (held,) = fresh(df, "__found")
    out = df.withColumn(held, value)
    new = {f.lower() for f in fields}
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in new],
        *[F.col(f"{held}.{f}").cast(kind).alias(f) for f, kind in fields.items()],
    )
