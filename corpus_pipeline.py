"""From raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontam, langid, mixing, neardup, pii
from kinloom.llm.common import fold, fresh, table
from kinloom.operators.lineage import cut, scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language; null texts and texts without a letter are rejected. Short texts stay, however low their cosine."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    prototypes = langid.learn_prototypes(docs.where(~held), "text", "lang")
    whole = docs.select("text", F.struct("*").alias("row"))
    found = langid.predict_language(whole, prototypes)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    A document is an id and its text: rows that repeat both become one, the first
    by its other columns. Where an id has several texts, they are documents of
    their own, and all but one of them stand behind all other ids. Rows without
    an id stay.
    """
    key, print_, ahead = fresh(docs, "__key", "__print", "__ahead")
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(print_, F.xxhash64(F.length("text"), "text"))
    clash = named.groupBy("doc_id").agg(F.min(print_).alias(ahead), F.max(print_).alias(print_)).where(F.col(ahead) != F.col(print_))
    more = named.select("doc_id", print_).join(clash.select("doc_id", ahead), "doc_id").where(F.col(print_) != F.col(ahead))
    last = docs.agg(F.max("doc_id").cast("long")).first()[0] or 0
    more, _ = cut(more.select("doc_id", print_).distinct().orderBy("doc_id", print_).select(
        "doc_id", print_, (F.lit(last + 1) + F.monotonically_increasing_id()).alias(key)))
    keyed = named.join(more, ["doc_id", print_], "left").withColumn(key, F.coalesce(key, F.col("doc_id").cast("long")))
    found = neardup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = found.where("kept").select(F.col("doc_id").alias(key)).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    first = keyed.join(kept, key, "left_semi").groupBy(key).agg(F.min_by(row, others).alias(key + "row")).select(key + "row.*")
    return first.unionByName(docs.where(F.col("doc_id").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and revealing terms taken out; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, numbered in ``copy``."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    docs, root = table(spark, sf_dir, "documents"), f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
