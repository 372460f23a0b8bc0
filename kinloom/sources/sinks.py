"""Write entity tables as family-tree text or JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinloom.functions.text import trim
from kinloom.operators.lineage import cut

FORMAT = "kinloom/model"
SOURCE_SYSTEM = "kinloom"
VERSION = 1
_MARK, _HEAD, _PERSON, _FAMILY, _TAIL = -1, 0, 1, 2, 3


def _clean(value: Column) -> Column:
    return trim(F.regexp_replace(value, "\\r?\\n", " "))


def _line(level: int, tag: Column | str, value: Column | None = None) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    head = F.concat(F.lit(f"{level} "), tag)
    if value is None:
        return head
    return F.when(value != "", F.concat(head, F.lit(" "), _clean(value))).otherwise(head)


def _opt(value: Column, line: Column) -> Column:
    return F.when(value != "", line)


def _at(col: Column) -> Column:
    return F.concat(F.lit("@"), col, F.lit("@"))


def _source_lines(level: int, sources: Column) -> Column:
    def one(s: Column) -> Column:
        shown = F.when(s["source_id"] != "", _at(s["source_id"])).when(s["raw"] != "", s["raw"])
        page = _opt(s["page"], _line(level + 1, "PAGE", s["page"]))
        return F.when(shown.isNotNull(), F.array(_line(level, "SOUR", shown), page)).otherwise(
            F.array().cast("array<string>")
        )

    return F.flatten(F.transform(sources, one))


def event_lines(event: DataFrame) -> DataFrame:
    """(tree_id, event_id, lines) of every event."""
    tag = F.when(F.col("raw_tag") != "", F.col("raw_tag")).otherwise("EVEN")
    lines = F.concat(
        F.array(
            _line(1, tag, F.coalesce("description", F.lit(""))),
            _opt(F.col("date.raw"), _line(2, "DATE", F.col("date.raw"))),
            _opt(F.col("place.raw"), _line(2, "PLAC", F.col("place.raw"))),
        ),
        _source_lines(2, F.col("sources")),
    )
    return event.select("tree_id", "event_id", F.array_compact(lines).alias("lines"))


def gedcom_lines(corpus, source_system: str = SOURCE_SYSTEM) -> DataFrame:
    """(tree_id, section, seq, block, ord, pos, text): sortable lines of every tree.

    Lines stay separate rows, so a tree of any size is never held in one value.
    """
    ev = event_lines(corpus.event)
    blocks: list[DataFrame] = []

    def emit(df: DataFrame, section: int, seq, block: int, ord_, lines) -> None:
        blocks.append(
            df.select(
                "tree_id", F.lit(section).alias("section"), seq.cast("bigint").alias("seq"), F.lit(block).alias("block"),
                ord_.cast("bigint").alias("ord"), F.posexplode(F.array_compact(lines)).alias("pos", "text"),
            )
        )

    zero = F.lit(0)
    trees = corpus.person.select("tree_id").unionByName(corpus.family.select("tree_id")).distinct()
    named = trees.join(corpus.header.select("tree_id", "source_system"), "tree_id", "left")
    emit(
        named, _HEAD, zero, 0, zero,
        F.array(
            F.lit("0 HEAD"), _line(1, "SOUR", F.coalesce("source_system", F.lit(source_system))), F.lit("1 GEDC"),
            F.lit("2 VERS 5.5.1"), F.lit("2 FORM LINEAGE-LINKED"), F.lit("1 CHAR UTF-8"),
        ),
    )
    emit(trees, _TAIL, zero, 0, zero, F.array(F.lit("0 TRLR")))

    p = corpus.person
    pseq = p.select("tree_id", "person_id", "seq")
    shown = lambda n: F.when(n["raw"] != "", n["raw"]).otherwise(n["full"])
    sex = F.when(F.col("sex") == "male", "1 SEX M").when(F.col("sex") == "female", "1 SEX F")
    emit(
        p, _PERSON, F.col("seq"), 0, zero,
        F.concat(
            F.array(F.concat(F.lit("0 "), _at(F.col("person_id")), F.lit(" INDI"))),
            F.transform("names", lambda n: _line(1, "NAME", shown(n))), F.array(sex),
        ),
    )
    own = corpus.person_event.join(ev, ["tree_id", "event_id"]).join(pseq, ["tree_id", "person_id"])
    emit(own, _PERSON, F.col("seq"), 1, F.col("ord"), F.col("lines"))
    emit(
        p, _PERSON, F.col("seq"), 2, zero,
        F.array(_opt(F.col("family_id_as_child"), _line(1, "FAMC", _at(F.col("family_id_as_child"))))),
    )
    emit(
        corpus.person_fams.join(pseq, ["tree_id", "person_id"]), _PERSON, F.col("seq"), 3, F.col("ord"),
        F.array(_line(1, "FAMS", _at(F.col("family_id")))),
    )
    notes = F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: _line(1, "NOTE", n))
    emit(p, _PERSON, F.col("seq"), 4, zero, F.concat(notes, _source_lines(1, F.col("sources"))))

    f = corpus.family
    fseq = f.select("tree_id", "family_id", "seq")
    emit(f, _FAMILY, F.col("seq"), 0, zero, F.array(F.concat(F.lit("0 "), _at(F.col("family_id")), F.lit(" FAM"))))
    emit(_spouse_roles(corpus).join(fseq, ["tree_id", "family_id"]), _FAMILY, F.col("seq"), 1, F.col("ord"),
         F.array(_line(1, F.col("role"), _at(F.col("person_id")))))
    emit(corpus.family_child.join(fseq, ["tree_id", "family_id"]), _FAMILY, F.col("seq"), 2, F.col("ord"),
         F.array(_line(1, "CHIL", _at(F.col("person_id")))))
    emit(corpus.family_event.join(ev, ["tree_id", "event_id"]).join(fseq, ["tree_id", "family_id"]), _FAMILY,
         F.col("seq"), 3, F.col("ord"), F.col("lines"))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def _spouse_roles(corpus) -> DataFrame:
    """HUSB or WIFE by sex, else by position: the first one without a husband before it is HUSB."""
    sexed = corpus.family_spouse.join(
        corpus.person.select("tree_id", "person_id", "sex"), ["tree_id", "person_id"], "left"
    )
    # First position at which a husband is written: a man, or anyone of unknown sex.
    first = sexed.where(F.coalesce("sex", F.lit("unknown")) != "female").groupBy("tree_id", "family_id").agg(
        F.min("ord").alias("first_husband")
    )
    role = (
        F.when(F.col("sex") == "female", "WIFE").when(F.col("sex") == "male", "HUSB")
        .when(F.col("ord") <= F.col("first_husband"), "HUSB").otherwise("WIFE")
    )
    return sexed.join(first, ["tree_id", "family_id"], "left").withColumn("role", role)


def write_gedcom(corpus, path: str) -> None:
    """Write all trees under ``path/tree_id=<id>/``, lines in order.

    Rows are range-partitioned by tree and record: a large tree becomes several
    part files that follow each other in name order, each record in one of them.
    """
    order = ["tree_id", "section", "seq", "block", "ord", "pos"]
    (
        gedcom_lines(corpus).repartitionByRange(*order[:3]).sortWithinPartitions(*order)
        .select("tree_id", "text").write.partitionBy("tree_id").text(path)
    )


def write_bundles(corpus, path: str, files: int = 256) -> None:
    """Write all trees into at most ``files`` files, each tree after a ``0 _TREE <id>`` record.

    The files follow each other by name; small trees share one, a large tree goes on in
    the next ones. ``parse_corpus(..., bundled=True)`` reads them.
    """
    write_marked(gedcom_lines(corpus), path, files)


def write_marked(lines: DataFrame, path: str, files: int = 256) -> None:
    """Write ``lines(tree_id, section, seq, block, ord, pos, text)`` as ``write_bundles`` does."""
    lines, _ = cut(lines)  # the range bounds and the markers are taken from the rows, not from another run of what makes them
    zero = F.lit(0)
    marks = lines.select("tree_id").distinct().select(
        "tree_id", F.lit(_MARK).alias("section"), zero.cast("bigint").alias("seq"), zero.alias("block"), zero.cast("bigint").alias("ord"),
        zero.alias("pos"), F.concat(F.lit("0 _TREE "), F.url_encode("tree_id")).alias("text"))
    order = ["tree_id", "section", "seq", "block", "ord", "pos"]
    lines.unionByName(marks).repartitionByRange(files, *order[:3]).sortWithinPartitions(*order).select("text").write.text(path)


TABLES = ["header", "person", "person_fams", "family", "family_spouse", "family_child", "event", "person_event", "family_event",
          "event_participant"]


def write_model_json(corpus, path: str) -> None:
    """Lossless dump: one folder of gzipped JSON lines per entity, stamped with format and version, and the layout of each."""
    layouts = []
    for name in TABLES:
        table = getattr(corpus, name)
        layouts.append((name, table.schema.json(), FORMAT, VERSION))
        table.withColumn("format", F.lit(FORMAT)).withColumn("version", F.lit(VERSION)).write.option("compression", "gzip").json(f"{path}/{name}")
    corpus.person.sparkSession.createDataFrame(layouts, "name string, layout string, format string, version int").coalesce(1).write.json(
        f"{path}/layouts")


def read_model_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump by name; a dump of another format or version is an error."""
    layouts = spark.read.schema("name string, layout string, format string, version int").json(f"{path}/layouts").collect()  # one row per table
    odd = [r["name"] for r in layouts if (r["format"], r["version"]) != (FORMAT, VERSION)]
    if odd or {r["name"] for r in layouts} != set(TABLES):
        raise ValueError(f"{path} is not a dump of format {FORMAT} {VERSION}: {odd or 'tables are missing'}")
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["layout"]))).json(f"{path}/{r['name']}") for r in layouts}
