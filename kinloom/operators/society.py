"""Lineage-society proof checklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.dates import society_date
from kinloom.functions.places import society_place
from kinloom.functions.text import blank_to_null

SERVICE_KEY = "service"
_LINE = ["tree_id", "focal_id", "ancestor_id"]

# Rules of the one society that is configured.
SOCIETY_RULES = [
    {
        "society_id": "sar",
        "name": "Sons of the American Revolution",
        "abbreviation": "SAR",
        "service_start": 1775,
        "service_end": 1783,
        "record_copy_cutoff": 1985,
        "service_label": "Patriot Revolutionary War service (1775–1783)",
    },
]


def society_rules(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """Rule rows; pass further dicts to add societies."""
    schema = (
        "society_id string, name string, abbreviation string, service_start int, service_end int, "
        "record_copy_cutoff int, service_label string"
    )
    return spark.createDataFrame([tuple(r.values()) for r in rules or SOCIETY_RULES], schema)


def checklist_links(parents: DataFrame, on_line: DataFrame) -> DataFrame:
    """Child -> parent links between people of a line, nearest first.

    (tree_id, focal_id, ancestor_id, link_key, child_id, parent_id, generation, link_no)
    """
    child = on_line.select(*_LINE, F.col("person_id").alias("child_id"), (F.col("depth") + 1).alias("generation"))
    parent = on_line.select(*_LINE, F.col("person_id").alias("parent_id"))
    links = child.join(parents.select("tree_id", "child_id", "parent_id").distinct(), ["tree_id", "child_id"]).join(
        parent, [*_LINE, "parent_id"]).select(*_LINE, "child_id", "parent_id", "generation")
    links = links.withColumn("link_key", F.concat("child_id", F.lit("->"), "parent_id"))
    order = Window.partitionBy(*_LINE).orderBy("generation", "link_key")
    return links.withColumn("link_no", F.row_number().over(order))


def reachability(lines: DataFrame, on_line: DataFrame) -> DataFrame:
    """Whether each line's ancestor is above its focal."""
    found = on_line.where((F.col("person_id") == F.col("ancestor_id")) & (F.col("depth") > 0)).select(*_LINE, F.lit(True).alias("found"))
    return lines.select(*_LINE).distinct().join(found, _LINE, "left").select(*_LINE, F.col("found").isNotNull().alias("reachable"))


def service_citation(society: Column, number: Column, cited: Column) -> Column:
    head = F.concat(society, F.lit("# "), number)
    cite = blank_to_null(cited)
    return F.when(cite.isNotNull(), F.concat(head, F.lit(" cites "), cite)).otherwise(head)


def checklist_items(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Links of each checklist and its service item."""
    service = lines.select(*_LINE).distinct().select(
        *_LINE, F.lit(SERVICE_KEY).alias("link_key"), F.lit(None).cast("int").alias("link_no")
    )
    return links.select(*_LINE, "link_key", F.col("link_no").cast("int").alias("link_no")).unionByName(service)


def evaluate_items(
    items: DataFrame, proofs: DataFrame, rules: list[dict] | None = None, society_id: str = "sar"
) -> DataFrame:
    """Proof status of every checklist item.

    ``proofs(line keys, seq, kind, doc_id, covered_keys, society, national_number,
    approved_year, service_proof_cited)``. The best proof is a partial aggregate
    over (priority, seq): first document, else first sufficient record copy, else
    first older copy.
    """
    # the rules are configuration on the driver, so the one that applies is a literal
    cutoff = {r["society_id"]: r["record_copy_cutoff"] for r in rules or SOCIETY_RULES}[society_id]
    return _evaluate(items, proofs.withColumn("cutoff", F.lit(cutoff)), _LINE)


def evaluate_applications(items: DataFrame, proofs: DataFrame, applications: DataFrame, rules: DataFrame) -> DataFrame:
    """Proof status of every checklist item for each society a line applies to.

    ``applications(line keys, society_id)``; ``rules(society_id, record_copy_cutoff)`` as
    ``society_rules`` gives them. A society without a rule, or without a cutoff, takes
    documents only.
    """
    keys = [*_LINE, "society_id"]
    cutoffs = rules.select("society_id", F.col("record_copy_cutoff").alias("cutoff"))
    asked = applications.select(*keys).distinct().join(cutoffs, "society_id", "left").select(*keys, "cutoff")
    return _evaluate(items.join(asked.drop("cutoff"), _LINE), proofs.join(asked, _LINE), keys)


def _evaluate(items: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    is_doc = F.col("kind") == "document"
    per_key = (
        proofs.withColumn("link_key", F.explode(F.array_distinct("covered_keys")))
        .withColumn("sufficient", F.when(~is_doc, F.col("approved_year") >= F.coalesce("cutoff", F.lit(2**31 - 1))))
        .withColumn("priority", F.when(is_doc, 0).when(F.col("sufficient"), 1).otherwise(2))
        .groupBy(*keys, "link_key")
        .agg(
            F.min_by(
                F.struct("kind", "doc_id", "society", "national_number", "approved_year", "sufficient",
                         "service_proof_cited"),
                F.struct("priority", "seq"),
            ).alias("best")
        )
    )
    best = F.col("best")
    status = (
        F.when(best["kind"] == "document", "sourced-by-document")
        .when(best["sufficient"], "proven-by-record-copy").otherwise("unproven")
    )
    copy = best["kind"] == "record-copy"
    cite = service_citation(best["society"], best["national_number"], best["service_proof_cited"])
    return items.join(per_key, [*keys, "link_key"], "left").select(
        *keys, "link_key", "link_no", status.alias("status"), best["doc_id"].alias("doc_id"),
        F.when(copy, best["national_number"]).alias("record_copy"),
        F.coalesce(copy & ~best["sufficient"], F.lit(False)).alias("insufficient"),
        F.when(copy & (F.col("link_key") == SERVICE_KEY), cite).alias("citation"),
    )


def checklist_summary(evaluated: DataFrame, by_society: bool = False) -> DataFrame:
    """Totals per checklist; completeness is proven / total."""
    keys = [*_LINE, "society_id"] if by_society else _LINE
    proven = F.col("status") != "unproven"
    service = F.col("link_key") == SERVICE_KEY
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(proven, 1)).alias("proven"),
        F.count(F.when(~proven & ~service, 1)).alias("unproven_links"),
        F.max(~proven & service).alias("service_unproven"),
    ).withColumn("completeness", F.col("proven") / F.col("total"))


def record_copy_span(links: DataFrame, spans: DataFrame) -> DataFrame:
    """Link keys covered by a record copy over n consecutive links.

    ``spans(line keys, start_key, generations)``; a start that is not on the line
    covers nothing, the service item covers only itself.
    """
    start = spans.join(
        links.select(*_LINE, F.col("link_key").alias("start_key"), F.col("link_no").alias("from_no")),
        [*_LINE, "start_key"],
    )
    last = F.col("from_no") + F.col("generations") - 1
    numbers = start.where(F.col("generations") > 0).select(
        *_LINE, "start_key", "generations", F.explode(F.sequence(F.col("from_no").cast("bigint"), last.cast("bigint"))).alias("link_no"))
    covered = numbers.join(links.select(*_LINE, "link_key", F.col("link_no").cast("bigint").alias("link_no")), [*_LINE, "link_no"]).select(
        *_LINE, "start_key", "generations", "link_key", "link_no")
    own = spans.where(F.col("start_key") == SERVICE_KEY).select(
        *_LINE, "start_key", "generations", F.lit(SERVICE_KEY).alias("link_key"), F.lit(0).cast("bigint").alias("link_no")
    )
    return covered.unionByName(own)


def vitals_lines(vitals: DataFrame) -> DataFrame:
    """Society-formatted birth date and place, joined with a middle dot."""
    date = society_date(F.col("birth.date.year"), F.col("birth.date.month"), F.col("birth.date.day"))
    place = society_place(F.col("birth.place.raw"))
    return vitals.select(
        "tree_id", "person_id",
        F.concat_ws(" · ", blank_to_null(date), blank_to_null(place)).alias("vitals"),
    )
