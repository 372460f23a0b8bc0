"""Project manifests, document vault and file identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_FORMAT = "kinloom/project"

_PROJECT = (
    "format string, version int, name string, sourceFile string, sourceFileName string, sourceHash string, "
    "focalPersonId string, ops array<string>, checklists array<string>, settings struct<orientation:string>, updatedAt string"
)

# Accepted document types and their extension.
ACCEPTED = {
    "application/pdf": ("application/pdf", "pdf"),
    "image/jpeg": ("image/jpeg", "jpg"),
    "image/jpg": ("image/jpeg", "jpg"),
    "image/png": ("image/png", "png"),
}
BY_EXTENSION = {
    "pdf": ("application/pdf", "pdf"),
    "jpg": ("image/jpeg", "jpg"),
    "jpeg": ("image/jpeg", "jpg"),
    "png": ("image/png", "png"),
}


def read_projects(spark: SparkSession, path: str, accepted_format: str = MANIFEST_FORMAT) -> DataFrame:
    """One row per project manifest; missing fields get defaults, foreign files are dropped.

    Operations and checklists stay JSON texts, one array element each.
    """
    texts = spark.read.text(path, wholetext=True)
    return parse_projects(texts.select(F.col("_metadata.file_path").alias("file"), F.col("value")), accepted_format)


def parse_projects(texts: DataFrame, accepted_format: str = MANIFEST_FORMAT) -> DataFrame:
    """``texts(file, value)`` -> project rows."""
    p = texts.select("file", F.from_json("value", _PROJECT).alias("p")).where(F.col("p.format") == accepted_format)
    none = F.array().cast("array<string>")
    return p.select(
        "file", F.coalesce("p.name", F.lit("Untitled")).alias("name"),
        F.coalesce("p.sourceFile", F.lit("source.ged")).alias("source_file"),
        F.coalesce("p.sourceFileName", F.lit("source.ged")).alias("source_file_name"),
        F.coalesce("p.sourceHash", F.lit("")).alias("source_hash"), F.col("p.focalPersonId").alias("focal_person_id"),
        F.coalesce("p.ops", none).alias("ops"), F.coalesce("p.checklists", none).alias("checklists"),
        F.when(F.col("p.settings.orientation") == "horizontal", "horizontal").otherwise("vertical").alias("orientation"),
        F.col("p.updatedAt").alias("updated_at"),
    )


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, hash) of every file; the bytes never leave the scan."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash")
    )


def new_sources(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """First file of each content not yet in ``catalogue(hash)``."""
    first = files.groupBy("hash").agg(F.min("path").alias("path"))
    return first.join(catalogue.select("hash"), "hash", "left_anti")


def document_kind(mimetype: Column, filename: Column) -> Column:
    """``struct<mime, ext>`` by mime type, else by file extension, else null."""
    kind = lambda mime, ext: F.struct(F.lit(mime).alias("mime"), F.lit(ext).alias("ext"))
    out = None
    for key, (mime, ext) in ACCEPTED.items():
        hit = F.lower(mimetype) == key
        out = F.when(hit, kind(mime, ext)) if out is None else out.when(hit, kind(mime, ext))
    suffix = F.element_at(F.split(F.lower(filename), "\\."), -1)
    for key, (mime, ext) in BY_EXTENSION.items():
        out = out.when(suffix == key, kind(mime, ext))
    return out


def vault_documents(uploads: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Accepted documents, one per content: first upload wins, known contents are dropped.

    ``uploads(seq, original_name, mimetype, size, hash)``.
    """
    typed = uploads.withColumn("kind", document_kind(F.coalesce("mimetype", F.lit("")), F.col("original_name"))).where(
        F.col("kind").isNotNull()
    )
    cols = ["original_name", "kind", "size"]
    docs = typed.groupBy("hash").agg(F.min_by(F.struct(*cols), "seq").alias("d"))
    if known is not None:
        docs = docs.join(known.select("hash"), "hash", "left_anti")
    return docs.select(
        F.col("hash").alias("doc_id"), F.concat_ws(".", "hash", "d.kind.ext").alias("filename"),
        F.col("d.original_name").alias("original_name"), F.col("d.kind.mime").alias("mimetype"),
        F.col("d.size").alias("size"),
    )


def document_links(proofs: DataFrame) -> DataFrame:
    """Distinct citation references per document, in order of first use.

    ``proofs(doc_id, seq, checklist_id, link_key)`` -> (doc_id, ref, first_seq).
    """
    ref = F.concat_ws(":", F.lit("sar"), "checklist_id", "link_key")
    return proofs.where(F.col("doc_id").isNotNull()).select("doc_id", "seq", ref.alias("ref")).groupBy("doc_id", "ref").agg(
        F.min("seq").alias("first_seq")
    )
