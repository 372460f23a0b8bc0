"""Queries over the edit log, the readers and the writers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import edits, guard
from kinloom.operators.lineage import scratch_root
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, joined, query
from kinloom.sources import files, gedcom, projects, sinks
from kinloom.streaming.oplog import OP_KEY, dedup_ops


def _run(b: Bridge, *kinds: str) -> edits.Replay:
    op = b.ops().where(F.col("kind").isin(*kinds)) if kinds else b.ops()
    return edits.Replay(b.tree(), op)


def _people(df: DataFrame) -> DataFrame:
    return df.select(
        "tree_id", "person_id", F.array_join(F.transform("names", lambda n: n["full"]), "|").alias("names"), "sex",
        joined("notes", "|"), "user_supplied",
    )


@query
def op_descriptions(b: Bridge) -> DataFrame:
    return edits.describe_ops(b.ops(), b.names())


@query
def people_added(b: Bridge) -> DataFrame:
    return _people(_run(b, "addPerson").people)


@query
def people_edited(b: Bridge) -> DataFrame:
    return _people(_run(b, "editPerson").people)


@query
def events_added(b: Bridge) -> DataFrame:
    event, person_event, family_event, _ = _run(b, "addEvent").events
    own = person_event.select("tree_id", F.col("person_id").alias("owner"), "event_id")
    fam = family_event.select("tree_id", F.col("family_id").alias("owner"), "event_id")
    cols = event.select("tree_id", "event_id", "type", "raw_tag", F.col("date.raw").alias("date_raw"),
                        F.col("place.normalized").alias("place_key"), "description", "user_supplied")
    return own.unionByName(fam).join(cols, ["tree_id", "event_id"])


@query
def events_edited(b: Bridge) -> DataFrame:
    return _run(b, "editEvent").events[0].select(
        "tree_id", "event_id", "type", "raw_tag", F.col("date.raw").alias("date_raw"),
        F.col("place.normalized").alias("place_key"), "description", "user_supplied",
    )


def _membership(run: edits.Replay) -> DataFrame:
    tag = lambda df, role: df.select("tree_id", "family_id", "person_id", F.lit(role).alias("role"))
    return (
        tag(edits._members(run.spouse_spans), "spouse").unionByName(tag(edits._members(run.child_spans), "child"))
        .unionByName(tag(run.fams, "record"))
        .unionByName(tag(run.famc.withColumnRenamed("id", "person_id"), "pointer"))
    )


@query
def relationships_linked(b: Bridge) -> DataFrame:
    return _membership(_run(b, "linkRelationship"))


@query
def relationships_unlinked(b: Bridge) -> DataFrame:
    return _membership(_run(b, "unlinkRelationship"))


@query
def people_merged(b: Bridge) -> DataFrame:
    run = _run(b, "merge")
    return _people(run.people).join(
        run.people.select("tree_id", "person_id", joined("merged_from_ids", "|")), ["tree_id", "person_id"]
    )


@query
def replayed_people(b: Bridge) -> DataFrame:
    run = _run(b)
    return _people(run.people).join(
        run.people.select("tree_id", "person_id", joined("merged_from_ids", "|")), ["tree_id", "person_id"]
    )


@query
def replayed_relationships(b: Bridge) -> DataFrame:
    return _membership(_run(b))


@query
def replayed_events(b: Bridge) -> DataFrame:
    event, person_event, family_event, people = _run(b).events
    counts = people.groupBy("tree_id", "event_id").agg(F.count(F.lit(1)).alias("people"))
    return event.join(counts, ["tree_id", "event_id"], "left").select(
        "tree_id", "event_id", "type", F.col("date.raw").alias("date_raw"), "description", "user_supplied", "people"
    )


@query
def undo_last_edits(b: Bridge) -> DataFrame:
    """People after taking back the last edit of every tree."""
    last = b.ops().groupBy("tree_id").agg(F.max("seq").alias("seq"))
    return _people(edits.Replay(b.tree(), edits.without_op(b.ops(), last)).people)


@query
def effective_merges(b: Bridge) -> DataFrame:
    """Merges that count: both people exist at that moment."""
    return edits._moves(_run(b, "merge").life).select("tree_id", "id", "merge_seq", "keep_id")


@query
def merge_survivors(b: Bridge) -> DataFrame:
    merges = edits.kind(b.ops(), "merge")
    life = _run(b, "merge").life
    alive = life.where(F.col("to_seq") == edits.FAR).select("tree_id", F.col("id").alias("person_id"))
    return edits.survivors(merges, alive, b.person_raw().select("tree_id", F.col("person_id").alias("id")))


def _link_log(b: Bridge) -> DataFrame:
    """The edits that decide which links stand, and the names in the refusals."""
    return b.ops().where(F.col("kind").isin("addPerson", "editPerson", "merge", "linkRelationship", "unlinkRelationship"))


@query
def blocked_links(b: Bridge) -> DataFrame:
    """Link edits that are refused, each checked in the tree as the edits before it have left it."""
    return guard.blocked_links(b.tree(), _link_log(b))


@query
def links_let_through(b: Bridge) -> DataFrame:
    return edits.kind(guard.lawful_log(b.tree(), _link_log(b)), "linkRelationship").select("tree_id", "seq", "family_id")


@query
def guarded_families(b: Bridge) -> DataFrame:
    """Who belongs to which family after the whole log, refused links left out."""
    run = guard.lawful_replay(b.tree(), _link_log(b))
    tag = lambda df, role: df.select("tree_id", "family_id", "person_id", F.lit(role).alias("role"))
    return tag(edits._members(run.spouse_spans), "spouse").unionByName(tag(edits._members(run.child_spans), "child"))


@query
def merged_event_lists(b: Bridge) -> DataFrame:
    """Ordered union of the event lists of people who become one."""
    return _run(b, "merge").person_event.groupBy("tree_id", "person_id").agg(F.count(F.lit(1)).alias("events"))


@query
def merged_event_rows(b: Bridge) -> DataFrame:
    """The lists themselves: the events of each person left, their own first, then those of the merged in the order of the merges."""
    listed = edits.as_list(_run(b, "merge").person_event, "person_id", "event_id")
    return listed.select("tree_id", "person_id", "event_id", big("ord", "position"))


@query
def merged_sources(b: Bridge) -> DataFrame:
    return _run(b, "merge").people.select("tree_id", "person_id", F.size("sources").cast("bigint").alias("sources"))


@query
def redelivered_ops(b: Bridge) -> DataFrame:
    """A log delivered twice counts once."""
    return dedup_ops(b.ops().unionByName(b.ops())).select(*OP_KEY, "kind")


@query
def gedcom_header(b: Bridge) -> DataFrame:
    return b.reread().header.select("tree_id", "source_system", "gedcom_version", "charset")


def _read_people(c: Corpus) -> DataFrame:
    return c.person.select(
        "tree_id", "person_id", F.array_join(F.transform("names", lambda n: n["full"]), "|").alias("names"), "sex",
        "family_id_as_child", joined("notes", "|"), F.size("sources").cast("bigint").alias("sources"),
    )


@query
def gedcom_people(b: Bridge) -> DataFrame:
    return _read_people(b.reread())


@query
def bundled_people(b: Bridge) -> DataFrame:
    """People of trees that share files."""
    return _read_people(b.reread_bundles())


@query
def gedcom_families(b: Bridge) -> DataFrame:
    c = b.reread()
    tag = lambda df, role: df.select("tree_id", "family_id", "person_id", F.lit(role).alias("role"))
    return tag(c.family_spouse, "spouse").unionByName(tag(c.family_child, "child")).unionByName(tag(c.person_fams, "record"))


@query
def gedcom_events(b: Bridge) -> DataFrame:
    return b.reread().event.select(
        "tree_id", "event_id", "type", "raw_tag", F.col("date.raw").alias("date_raw"), big("date.year", "year"),
        F.col("place.raw").alias("place_raw"), "description", "cited",
    )


@query
def gedcom_warnings(b: Bridge) -> DataFrame:
    return b.reread().warning.select("tree_id", "severity", "message", "context")


@query
def warning_summary(b: Bridge) -> DataFrame:
    return gedcom.warning_summary(b.reread().warning)


@query
def gedcom_text(b: Bridge) -> DataFrame:
    return sinks.gedcom_lines(b.texts()).select("tree_id", big("section"), "seq", "text")


@query
def model_json(b: Bridge) -> DataFrame:
    """People read back from the JSON dump."""
    folder = f"{scratch_root(b.spark)}/kinloom-json-{uuid.uuid4().hex}"
    sinks.write_model_json(b.corpus(), folder)
    schema = b.corpus().person.schema.add("format", "string").add("version", "integer")
    return b.spark.read.schema(schema).json(f"{folder}/person").select(
        "tree_id", "person_id", F.array_join(F.transform("names", lambda n: n["raw"]), "|").alias("raws"), "sex", "format",
        big("version"),
    )


@query
def model_json_rows(b: Bridge) -> DataFrame:
    """Every row of all tables read back from the JSON dump: what it joins, and its order or year."""
    folder = f"{scratch_root(b.spark)}/kinloom-json-{uuid.uuid4().hex}"
    sinks.write_model_json(b.corpus(), folder)
    tables = sinks.read_model_json(b.spark, folder)
    none = F.lit(None).cast("string")
    shown = {
        "header": ("source_system", "root_person_id", none), "person": ("person_id", "sex", "seq"), "person_fams": ("person_id", "family_id", "ord"),
        "family": ("family_id", none, "seq"), "family_spouse": ("family_id", "person_id", "ord"), "family_child": ("family_id", "person_id", "ord"),
        "event": ("event_id", "type", F.col("date.year")), "person_event": ("person_id", "event_id", "ord"),
        "family_event": ("family_id", "event_id", "ord"), "event_participant": ("event_id", "person_id", "pord"),
    }
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = [
        tables[name].select(F.lit(name).alias("table_name"), "tree_id", as_column(one).alias("a"), as_column(two).alias("b"),
                            as_column(number).cast("bigint").alias("n"))
        for name, (one, two, number) in shown.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _uploads(b: Bridge) -> DataFrame:
    n = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("PDF", "jpg", "jpeg", "png", "txt")]), (n % 5 + 1).cast("int"))
    mime = F.when(n % 4 == 0, "application/PDF").when(n % 4 == 1, "image/png").otherwise("application/octet-stream")
    return b.source("documents").select(
        n.alias("seq"), F.concat(F.lit("doc"), n.cast("string"), F.lit("."), ext).alias("original_name"),
        mime.alias("mimetype"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("hash"),
    )


@query
def vault_documents(b: Bridge) -> DataFrame:
    return files.vault_documents(_uploads(b))


@query
def new_source_files(b: Bridge) -> DataFrame:
    known = b.source("documents").join(b.source("labels"), "doc_id").select(F.sha2("text", 256).alias("hash"))
    sources = _uploads(b).select("hash", F.col("original_name").alias("path"))
    return files.new_sources(sources, known)


@query
def document_links(b: Bridge) -> DataFrame:
    p = b.proofs().select(
        "doc_id", "seq", F.concat_ws("-", "focal_id", "ancestor_id").alias("checklist_id"),
        F.explode("covered_keys").alias("link_key"),
    )
    return files.document_links(p)


@query
def project_manifests(b: Bridge) -> DataFrame:
    s = b.source("supplier")
    n = F.col("s_suppkey")
    text = F.to_json(
        F.struct(
            F.when(n % 7 == 0, "other/project").otherwise(files.MANIFEST_FORMAT).alias("format"),
            F.when(n % 3 != 0, F.col("s_name")).alias("name"), F.when(n % 2 == 0, F.lit("tree.ged")).alias("sourceFileName"),
            F.when(n % 5 == 0, F.sha2("s_name", 256)).alias("sourceHash"),
            F.when(n % 4 == 0, F.concat(F.lit("I"), n.cast("string"))).alias("focalPersonId"),
            F.struct(F.when(n % 2 == 1, F.lit("horizontal")).otherwise("sideways").alias("orientation")).alias("settings"),
        )
    )
    texts = s.select(n.cast("string").alias("file"), text.alias("value"))
    return files.parse_projects(texts).select(
        "file", "name", "source_file", "source_file_name", "source_hash", "focal_person_id", "orientation"
    )


def _saved_projects(b: Bridge) -> DataFrame:
    """Every tree with its edits and checklists, saved as a manifest and read again."""
    proofs = b.proofs().withColumn("checklist_id", F.concat_ws("-", "focal_id", "ancestor_id"))
    lists = proofs.select("tree_id", "checklist_id", F.lit("SAR").alias("society_id"), F.col("ancestor_id").alias("patriot_id"),
                          F.lit("2020-01-01").alias("created_at")).distinct()
    null = F.lit(None).cast("string")
    heads = b.person_raw().select("tree_id").distinct().select(
        "tree_id", F.col("tree_id").alias("name"), F.lit("source.ged").alias("source_file"), F.lit("tree.ged").alias("source_file_name"),
        F.lit("").alias("source_hash"), null.alias("focal_person_id"), F.lit("vertical").alias("orientation"), F.lit("2020-01-02").alias("updated_at"))
    return files.parse_projects(projects.project_texts(heads, b.ops(), lists, proofs))


@query
def project_ops(b: Bridge) -> DataFrame:
    """The edits of saved projects, as a log again."""
    return projects.project_ops(_saved_projects(b)).select(
        "tree_id", "seq", "kind", "person_id", "keep_id", "merge_id", joined("name_raws", "|"), "sex", joined("notes", "|"), "event_id",
        "event_type", joined("participant_ids"), "date_raw", "date_set", "place_raw", "place_set", "description", "description_set", "family_id",
        "relation", "parent_id", "child_id", "spouse_a", "spouse_b",
    )


@query
def project_checklists(b: Bridge) -> DataFrame:
    return projects.project_checklists(_saved_projects(b)).select("file", "checklist_no", "checklist_id", "society_id", "patriot_id", "proofs")


@query
def project_proofs(b: Bridge) -> DataFrame:
    return projects.project_proofs(_saved_projects(b)).select(
        "file", "checklist_id", "seq", "kind", "doc_id", joined("covered_keys"), "society", "national_number", big("approved_year"),
        "service_proof_cited",
    )
