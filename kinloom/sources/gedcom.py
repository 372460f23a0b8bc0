"""Read family-tree text files into entity tables.

One file is one tree. Records start at a line ``0 ...``; the reader uses that as
line separator, so a file of any size is split over tasks and no task needs a
whole tree. A record is a person or a family, small by nature; lines inside it
are numbered within the record only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.dates import parse_date
from kinloom.functions.names import parse_names, parse_sex
from kinloom.operators.events import with_places
from kinloom.operators.lineage import cut

# Individual event tags and their types, tags that are never events,
# top-level records that are known but not modelled.
EVENT_TAGS = {
    "BIRT": "birth", "DEAT": "death", "BURI": "burial", "BAPM": "baptism", "CHR": "baptism",
    "CHRA": "baptism", "BAPL": "baptism", "CENS": "census", "RESI": "residence",
    "IMMI": "immigration", "EMIG": "emigration", "OCCU": "occupation", "MILI": "military",
    "_MILT": "military",
}
FAMILY_EVENT_TAGS = {"MARR": "marriage"}
NOT_EVENTS = [
    "NAME", "SEX", "FAMS", "FAMC", "SOUR", "NOTE", "OBJE", "RIN", "REFN", "RFN", "AFN", "UID",
    "_UID", "CHAN", "ADDR", "TITL",
]
KNOWN_RECORDS = ["HEAD", "INDI", "FAM", "TRLR", "SOUR", "REPO", "OBJE", "NOTE", "SUBM", "SUBN"]

LINE = "^\\s*(\\d+)\\s+(?:(@[^@]+@)\\s+)?([A-Za-z0-9_]+)(?: (.*))?$"
_REC = ["tree_id", "rec"]


@dataclass
class Corpus:
    """Entity tables of many trees."""

    header: DataFrame
    person: DataFrame
    person_fams: DataFrame
    family: DataFrame
    family_spouse: DataFrame
    family_child: DataFrame
    event: DataFrame
    person_event: DataFrame
    family_event: DataFrame
    event_participant: DataFrame
    warning: DataFrame


def strip_xref(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "^@", ""), "@$", "")


def _decoded(column: Column) -> Column:
    return F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))


def tree_name(file: Column, path: str, tree_from_folder: bool) -> Column:
    """Tree id of a file: its path below ``path`` (or below the folder before the first wildcard), without extension.

    Files of the same name in different folders are different trees. With
    ``tree_from_folder`` it is the value of the ``tree_id=<id>`` folder, whose
    files are the parts of one tree.
    """
    if tree_from_folder:
        return _decoded(_decoded(F.regexp_extract(file, "tree_id=([^/]*)/", 1)))
    stem, *wild = re.split(r"[*?\[{]", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path), maxsplit=1)
    base = stem[:stem.rfind("/") + 1] if wild else stem.rstrip("/")
    whole = _decoded(file)
    at = F.locate(base, whole)
    below = F.ltrim(F.when(at > 0, F.substring(whole, at + len(base), F.length(whole))).otherwise(F.lit("")), F.lit("/"))
    own = F.when(below == "", F.element_at(F.split(whole, "/"), -1)).otherwise(below)
    return F.regexp_replace(own, "\\.[^./]*$", "")


def _wide_files(spark: SparkSession, raw: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """UTF-16 files among the scanned ones, and their contents decoded; such a file is read whole."""
    odd, seen = cut(
        raw.where(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).isin("FFFE", "FEFF"))
        .select("file", _decoded(F.col("file")).alias("name")).distinct())
    if not seen["rows"]:
        return odd, None
    out, names = None, []

    def load(some: list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").load(some)
        return files.select(
            F.col("_metadata.file_path").alias("file"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("_id"),
            F.decode("content", "UTF-16").alias("value"))

    for row in odd.toLocalIterator():  # names only, some at a time
        names.append(row["name"])
        if len(names) == 1000:
            out, names = load(names) if out is None else out.unionByName(load(names)), []
    if names:
        out = load(names) if out is None else out.unionByName(load(names))
    return odd, out


def _trees_by_marker(raw: DataFrame, path: str) -> DataFrame:
    """Records with the tree named by the last ``0 _TREE <id>`` record before them, in files that follow each other by name.

    Inside a scan split the marker is looked up among the split's own records; across
    splits and files only the last marker of each split travels. Records before the
    first marker of a folder keep the name of their file.
    """
    line = F.regexp_replace("value", "^\ufeff?(0 )?", "")
    marked = raw.withColumn("mark", F.when(line.startswith("_TREE "), F.url_decode(F.regexp_extract(line, "^_TREE (\\S*)", 1))))
    upto = Window.partitionBy("file", "block").orderBy("_id", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    inside = marked.withColumn("own", F.last("mark", ignorenulls=True).over(upto))
    ends = marked.groupBy("file", "block").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("_id", "_sub"))).alias("mark"))
    # one row per split, as for the record numbers
    earlier = Window.partitionBy(F.regexp_extract("file", "^(.*)/", 1)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("mark", ignorenulls=True).over(earlier)).drop("mark")
    named = F.coalesce("own", "carried", tree_name(F.col("file"), path, False))
    return inside.join(carried, ["file", "block"]).where("mark is null").select(
        named.alias("tree_id"), "file", "block", "_id", "_sub", "value")


def read_records(spark: SparkSession, path: str, tree_from_folder: bool = False, bundled: bool = False) -> DataFrame:
    """(tree_id, rec, text): one row per level-0 record, ``rec`` counts through the files of a tree.

    Lines may end in LF, CR LF or CR; files are UTF-8, or UTF-16 with a byte
    order mark. Row ids grow with the position inside a scan task; a record's
    number is the number of records of its tree in earlier splits plus its place
    in the split, so no task has to hold a file. (A file with bare CR is one
    piece for the scan.) With ``bundled`` a file holds any number of trees, see
    ``sinks.write_bundles``.
    """
    raw = (
        spark.read.option("lineSep", "\n0 ").option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_id"), F.col("value"),
        )
    )
    raw, _ = cut(raw)
    odd, wide = _wide_files(spark, raw)
    if wide is not None:
        raw = raw.join(odd.select("file"), "file", "left_anti").unionByName(wide)
    pieces = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n0 ")
    rows = raw.select("file", "block", "_id", F.posexplode(pieces).alias("_sub", "value"))
    if bundled:
        rows, _ = cut(_trees_by_marker(rows, path))
    else:
        rows = rows.withColumn("tree_id", tree_name(F.col("file"), path, tree_from_folder))
    splits = rows.groupBy("tree_id", "file", "block").agg(F.count(F.lit(1)).alias("_n"))
    # One row per split: far smaller than the data, and ordered per tree.
    before = Window.partitionBy("tree_id").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("tree_id", "file", "block").orderBy("_id", "_sub"))
    text = F.regexp_replace("value", "^\ufeff?(0 )?", "0 ")
    return rows.withColumn("_at", place).join(starts, ["tree_id", "file", "block"]).select(
        "tree_id", (F.col("_base") + F.col("_at") - 1).alias("rec"), text.alias("text"))


def empty_files(spark: SparkSession, path: str, tree_from_folder: bool, heads: DataFrame, bundled: bool = False) -> DataFrame:
    """A warning for each tree whose files hold neither a person nor a family; ``heads(tree_id, tag)``.

    Files of no bytes are passed over by every scan and get none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("_metadata.file_path").alias("file"))
    named = heads.select("tree_id") if bundled else files.select(tree_name(F.col("file"), path, tree_from_folder).alias("tree_id"))
    trees = named.where(F.col("tree_id") != "").distinct()
    filled = heads.where(F.col("tag").isin("INDI", "FAM")).select("tree_id").distinct()
    return trees.join(filled, "tree_id", "left_anti").select(
        "tree_id", F.lit("warning").alias("severity"), F.lit("The file holds no individual and no family record.").alias("message"),
        F.lit(None).cast("string").alias("context"))


def _split_lines(records: DataFrame) -> DataFrame:
    """(tree_id, rec, pos, level, xref, tag, value) of every line."""
    lines = records.select(*_REC, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(
        F.trim("line") != ""
    )
    part = lambda n: F.regexp_extract("line", LINE, n)
    parts = lines.select(*_REC, "pos", *[part(n).alias(f"_{n}") for n in range(1, 5)])
    # A value is absent unless something follows the tag and a space.
    filled = lambda n: F.when(F.col(f"_{n}") != "", F.col(f"_{n}"))
    return parts.select(
        *_REC, "pos", filled(1).cast("int").alias("level"), filled(2).alias("xref"), F.upper("_3").alias("tag"), filled(4).alias("value"),
    ).where(F.col("level").isNotNull())


def read_lines(records: DataFrame) -> DataFrame:
    """(tree_id, rec, pos, level, xref, tag, value) with continuation lines folded in.

    Only records that may have some are folded.
    """
    may = F.col("text").rlike("(?im)^\\s*\\d+\\s+(?:@[^@]+@\\s+)?CON[CT]\\b")
    return _split_lines(records.where(~may)).unionByName(_fold_lines(_split_lines(records.where(may))))


def _fold_lines(parsed: DataFrame) -> DataFrame:
    cont = F.col("tag").isin("CONT", "CONC")
    run = Window.partitionBy(*_REC).orderBy("pos")
    grouped = parsed.withColumn("_head", F.sum(F.when(cont, 0).otherwise(1)).over(run))
    glue = F.when(F.col("tag") == "CONT", F.concat(F.lit("\n"), F.coalesce("value", F.lit(""))))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"])
    return (
        grouped.withColumn("_t", glue.otherwise(F.coalesce("value", F.lit(""))))
        .groupBy(*_REC, "_head")
        .agg(
            F.min("pos").alias("pos"), F.min_by("level", "pos").alias("level"), F.min_by("xref", "pos").alias("xref"),
            F.min_by("tag", "pos").alias("tag"), F.min_by(F.col("value").isNull(), "pos").alias("_none"),
            F.count(F.lit(1)).alias("_lines"), F.array_join(pieces, "").alias("_v"),
        )
        .select(
            *_REC, "pos", "level", "xref", "tag",
            F.when(F.col("_none") & (F.col("_lines") == 1), None).otherwise(F.col("_v")).alias("value"),
        )
    )


def _with_parents(lines: DataFrame) -> DataFrame:
    """Add the position of the level-1 line (``top``) and level-2 line above each line."""
    run = Window.partitionBy(*_REC).orderBy("pos")
    at = lambda level: F.last(F.when(F.col("level") == level, F.col("pos")), ignorenulls=True).over(run)
    return lines.withColumn("top", at(1)).withColumn("mid", at(2))


def _sources(own: DataFrame, pages: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Source citations of ``own`` lines with the first PAGE below each."""
    page = pages.groupBy(*_REC, F.col("up").alias(at)).agg(F.min_by("value", "pos").alias("page"))
    text = F.coalesce("value", F.lit(""))
    cite = F.struct(
        text.alias("raw"), F.when(text.startswith("@"), strip_xref(text)).alias("source_id"), F.col("page").alias("page"),
    )
    ordered = F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), cite.alias("c"))))
    return own.withColumn(at, F.col("pos")).join(page, [*_REC, at], "left").groupBy(*keys).agg(
        F.transform(ordered, lambda x: x["c"]).alias("sources")
    )


def parse_corpus(spark: SparkSession, path: str, tree_from_folder: bool = False, bundled: bool = False) -> Corpus:
    """Parse all files under ``path``; ``tree_name`` says what a file's tree is called.

    ``tree_from_folder`` takes it from a ``tree_id=<id>`` folder instead, whose files follow each other by name.
    ``bundled`` takes it from the marker before each tree. The lines are read at once, each table when first asked for.
    """
    return ParsedCorpus(spark, path, tree_from_folder, bundled)


def _first(cond: Column, name: str) -> Column:
    return F.min_by(F.when(cond, F.col("value")), F.when(cond, F.col("pos"))).alias(name)


class ParsedCorpus(Corpus):
    """Tables of parsed files, each made from the lines when it is first asked for: who asks for people parses no events."""

    def __init__(self, spark: SparkSession, path: str, tree_from_folder: bool, bundled: bool) -> None:
        self._spark, self._path, self._tree_from_folder, self._bundled = spark, path, tree_from_folder, bundled
        records, _ = cut(read_records(spark, path, tree_from_folder, bundled))
        self._lines, _ = cut(_with_parents(read_lines(records)))
        self._heads = self._lines.where("level = 0")
        self._sub = self._lines.where("level = 1")
        self._deep = self._lines.where("level = 2").withColumn("up", F.col("top"))

    def _records(self, tag: str) -> DataFrame:
        own = self._heads.where(F.col("tag") == tag).select(
            *_REC, F.col("xref").alias("external_id"), strip_xref(F.col("xref")).alias("id")
        )
        return own.where("id <> ''")

    def _live(self, tag: str) -> DataFrame:
        """The last record of each id; its place is that of the first."""
        return self._records(tag).groupBy("tree_id", "id").agg(
            F.max("rec").alias("rec"), F.min("rec").alias("seq"), F.max_by("external_id", "rec").alias("external_id")
        )

    @cached_property
    def _indi(self) -> DataFrame:
        return cut(self._live("INDI"))[0]

    @cached_property
    def _fam(self) -> DataFrame:
        return cut(self._live("FAM"))[0]

    def _of_person(self, lines: DataFrame) -> DataFrame:
        return lines.join(self._indi.select("tree_id", "rec", "id"), _REC)

    def _of_family(self, lines: DataFrame) -> DataFrame:
        return lines.join(self._fam.select("tree_id", "rec", "id"), _REC)

    @cached_property
    def header(self) -> DataFrame:
        lines = self._lines
        head = lines.join(self._heads.where("tag = 'HEAD'").select(*_REC), _REC, "left_semi")
        lvl1 = F.col("level") == 1
        gedc = head.where("level = 1 and tag = 'GEDC'").groupBy(*_REC).agg(F.min("pos").alias("_g"))
        return (
            head.join(gedc, _REC, "left").groupBy("tree_id").agg(
                _first(lvl1 & (F.col("tag") == "SOUR"), "source_system"),
                _first((F.col("level") == 2) & (F.col("tag") == "VERS") & (F.col("top") == F.col("_g")), "gedcom_version"),
                _first(lvl1 & (F.col("tag") == "CHAR"), "charset"),
                _first(lvl1 & (F.col("tag") == "_ROOT"), "root"),
            )
            .withColumn("root_person_id", F.when(F.col("root").isNotNull(), strip_xref(F.col("root")))).drop("root")
        )

    @cached_property
    def person(self) -> DataFrame:
        tagged = lambda t: F.when(F.col("tag") == t, F.struct(F.col("pos").alias("p"), F.col("value").alias("v")))
        listed = lambda t: F.sort_array(F.collect_list(tagged(t)))
        vals = lambda c: F.transform(F.col(c), lambda x: x["v"])
        facts = self._of_person(self._sub.where(F.col("tag").isin("NAME", "SEX", "FAMC", "NOTE"))).groupBy("tree_id", "id").agg(
            listed("NAME").alias("names"), listed("FAMC").alias("famc"), listed("NOTE").alias("notes"),
            F.min_by(F.when(F.col("tag") == "SEX", F.col("value")), F.when(F.col("tag") == "SEX", F.col("pos"))).alias("sex"),
        )
        cited = _sources(
            self._of_person(self._sub.where("tag = 'SOUR'")), self._deep.where("tag = 'PAGE'"), ["tree_id", "id"], "spos"
        )
        raw_names = F.transform(vals("names"), lambda v: F.coalesce(v, F.lit("")))
        person = self._indi.join(facts, ["tree_id", "id"], "left").join(cited, ["tree_id", "id"], "left").select(
            "tree_id", F.col("id").alias("person_id"), "external_id", "seq",
            parse_names(F.coalesce(raw_names, F.array().cast("array<string>"))).alias("names"),
            parse_sex(F.col("sex")).alias("sex"),
            F.when(F.size("famc") > 0, strip_xref(F.col("famc")[0]["v"])).alias("family_id_as_child"),
            F.coalesce("sources", _no_sources()).alias("sources"), F.filter(vals("notes"), lambda v: v.isNotNull()).alias("notes"),
            F.coalesce(F.size("famc"), F.lit(0)).alias("famc_count"),
        )
        return cut(person)[0]

    @cached_property
    def person_fams(self) -> DataFrame:
        return self._of_person(self._sub.where("tag = 'FAMS'")).select(
            "tree_id", F.col("id").alias("person_id"), F.col("pos").alias("ord"), strip_xref(F.col("value")).alias("family_id")
        )

    @cached_property
    def family(self) -> DataFrame:
        return self._fam.select("tree_id", F.col("id").alias("family_id"), "external_id", "seq")

    def _members(self, tags: list[str], key: Column) -> DataFrame:
        return self._of_family(self._sub.where(F.col("tag").isin(tags))).select(
            "tree_id", F.col("id").alias("family_id"), key.alias("ord"), strip_xref(F.col("value")).alias("person_id")
        ).where("person_id <> ''")

    @cached_property
    def family_spouse(self) -> DataFrame:
        # Husbands come before wives whatever the line order.
        return self._members(["HUSB", "WIFE"], F.col("pos") + F.when(F.col("tag") == "WIFE", 1 << 24).otherwise(0))

    @cached_property
    def family_child(self) -> DataFrame:
        return self._members(["CHIL"], F.col("pos"))

    @cached_property
    def _hints(self) -> DataFrame:
        return self._deep.where(F.col("tag").isin("DATE", "PLAC", "TYPE")).groupBy(*_REC, F.col("up").alias("pos")).agg(
            _first(F.col("tag") == "DATE", "date_raw"), _first(F.col("tag") == "PLAC", "place_raw"),
            _first(F.col("tag") == "TYPE", "type_text"), F.max(F.col("tag").isin("DATE", "PLAC")).alias("has_hint"),
        )

    @cached_property
    def event(self) -> DataFrame:
        pages3 = self._lines.where("level = 3 and tag = 'PAGE'").withColumn("up", F.col("mid"))
        ev_sources = _sources(
            self._deep.where("tag = 'SOUR'").withColumn("epos", F.col("up")), pages3, [*_REC, "epos"], "spos"
        ).withColumnRenamed("epos", "pos")
        hinted = self._of_person(self._sub).join(self._hints, [*_REC, "pos"], "left").withColumn(
            "looks", F.coalesce("has_hint", F.lit(False)) | (F.col("tag") == "EVEN")
        )
        own_events = hinted.withColumn(
            "type", F.when(_known().isNotNull(), _known()).when(~_structural() & F.col("looks"), "other")
        ).where("type is not null")
        fam_kind = F.create_map(*[F.lit(x) for kv in FAMILY_EVENT_TAGS.items() for x in kv])
        fam_events = self._of_family(self._sub).join(self._hints, [*_REC, "pos"], "left").withColumn(
            "type", F.try_element_at(fam_kind, F.col("tag"))
        ).where("type is not null")
        columns = ["tree_id", "rec", "id", "pos", "tag", "value", "type", "date_raw", "place_raw", "type_text"]
        every = own_events.select(*columns, F.lit(True).alias("own")).unionByName(
            fam_events.select(*columns, F.lit(False).alias("own"))
        )
        nth = Window.partitionBy("tree_id", "own", "id", "tag").orderBy("pos")
        # First spelling order over the file: record number, then line.
        seq = F.col("rec") * F.lit(1 << 22).cast("bigint") + F.col("pos")
        text = F.coalesce("value", "type_text")
        event = (
            every.withColumn("n", F.row_number().over(nth) - 1).join(ev_sources, [*_REC, "pos"], "left")
            .select(
                "tree_id", F.concat_ws("-", "id", "tag", F.col("n").cast("string")).alias("event_id"), seq.alias("seq"),
                "type", F.col("tag").alias("raw_tag"), parse_date(F.col("date_raw")).alias("date"), "place_raw",
                F.when(text != "", text).alias("description"),
                F.coalesce("sources", _no_sources()).alias("sources"), (F.size(F.coalesce("sources", _no_sources())) > 0).alias("cited"),
                F.when(F.col("own"), F.col("id")).alias("owner_id"), F.when(~F.col("own"), F.col("id")).alias("family_id"),
                F.col("pos").cast("bigint").alias("ord"),
            )
        )
        return cut(with_places(cut(event)[0]).drop("place_raw"))[0]

    @cached_property
    def person_event(self) -> DataFrame:
        return self.event.where("owner_id is not null").select("tree_id", F.col("owner_id").alias("person_id"), "ord", "event_id")

    @cached_property
    def family_event(self) -> DataFrame:
        return self.event.where("family_id is not null").select("tree_id", "family_id", "ord", "event_id")

    @cached_property
    def event_participant(self) -> DataFrame:
        return self.event.where("owner_id is not null").select(
            "tree_id", "event_id", F.col("owner_id").alias("person_id"), F.lit(0).alias("pord")
        ).unionByName(
            self.family_event.join(self.family_spouse.withColumnRenamed("ord", "pord"), ["tree_id", "family_id"]).select(
                "tree_id", "event_id", "person_id", "pord"
            )
        )

    @cached_property
    def warning(self) -> DataFrame:
        # Notes come from few lines; the others are left out before any join.
        indi = self._records("INDI")
        named = of_person_all(self._sub.where(F.col("tag").isin("NAME", "FAMC")), indi)
        notes = _parse_notes(self._heads, named, of_person_all(self._sub, indi), self._hints, _known(), _structural())
        dangling = reference_warnings(self.person, self.person_fams, self.family, self.family_spouse, self.family_child).unionByName(
            empty_files(self._spark, self._path, self._tree_from_folder, self._heads.select("tree_id", "tag"), self._bundled))
        return notes.unionByName(dangling)


def _no_sources() -> Column:
    return F.array().cast("array<struct<raw:string,source_id:string,page:string>>")


def _known() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_TAGS.items() for x in kv]), F.col("tag"))


def _structural() -> Column:
    return F.col("tag").isin(NOT_EVENTS) | F.col("tag").startswith("_")


def of_person_all(sub: DataFrame, records: DataFrame) -> DataFrame:
    """Level-1 lines of every individual record, repeated ids included."""
    return records.select("tree_id", "rec", "id").join(sub, _REC, "left")


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# The wording of all notes and warnings below.
def _parse_notes(
    heads: DataFrame, named: DataFrame, person_lines: DataFrame, hints: DataFrame, known: Column, structural: Column
) -> DataFrame:
    """Info rows: what was skipped or ignored while reading."""
    row = lambda df, message, context: df.select(
        "tree_id", F.lit("info").alias("severity"), message.alias("message"), context.alias("context")
    )
    at_id = F.concat(F.lit("@"), F.col("id"), F.lit("@"))
    null = F.lit(None).cast("string")
    blank = heads.where(strip_xref(F.col("xref")) == "")
    no_ref = row(
        blank.where(F.col("tag").isin("INDI", "FAM")),
        F.when(F.col("tag") == "INDI", "Skipped an INDI record with no xref pointer.")
        .otherwise("Skipped a FAM record with no xref pointer."), null,
    )
    unknown = row(
        heads.where(~F.col("tag").isin(KNOWN_RECORDS)),
        _say("Unrecognized top-level record ", F.col("tag"), " was ignored."), F.col("xref"),
    )
    has = named.groupBy("tree_id", "rec", "id").agg(
        F.count(F.when(F.col("tag") == "NAME", 1)).alias("names"), F.count(F.when(F.col("tag") == "FAMC", 1)).alias("famc")
    )
    nameless = row(has.where("names = 0"), _say("Individual ", at_id, " has no NAME record."), at_id)
    many = row(
        has.where("famc > 1"), _say("Individual ", at_id, " has multiple FAMC pointers; using the first."), at_id
    )
    other = person_lines.where(F.col("tag").isNotNull() & known.isNull())
    vendor = row(
        other.where(F.col("tag").startswith("_")),
        _say("Vendor-specific tag ", F.col("tag"), " on ", at_id, " was not mapped."), at_id,
    )
    plain = other.where(~structural & (F.col("tag") != "EVEN")).join(hints.where("has_hint"), [*_REC, "pos"], "left_anti")
    ignored = row(
        plain, _say("Unrecognized tag ", F.col("tag"), " on ", at_id, " was ignored."), at_id
    )
    out = no_ref
    for more in (unknown, nameless, many, vendor, ignored):
        out = out.unionByName(more)
    return out


def reference_warnings(
    person: DataFrame, person_fams: DataFrame, family: DataFrame, family_spouse: DataFrame, family_child: DataFrame
) -> DataFrame:
    """Pointers to families or people that do not exist."""
    at = lambda c: F.concat(F.lit("@"), F.col(c), F.lit("@"))
    row = lambda df, message, context: df.select(
        "tree_id", F.lit("warning").alias("severity"), message.alias("message"), at(context).alias("context")
    )
    no_family = lambda df, tag: row(
        df.join(family.select("tree_id", "family_id"), ["tree_id", "family_id"], "left_anti"),
        _say("Individual ", at("person_id"), " references a missing family ", at("family_id"), f" ({tag})."), "family_id",
    )
    known = person.select("tree_id", "person_id")
    no_person = lambda df, role: row(
        df.join(known, ["tree_id", "person_id"], "left_anti"),
        _say("Family ", at("family_id"), f" references a missing {role} ", at("person_id"), "."), "person_id",
    )
    famc = person.where(F.col("family_id_as_child") != "").select(
        "tree_id", "person_id", F.col("family_id_as_child").alias("family_id")
    )
    return (
        no_family(person_fams.select("tree_id", "person_id", "family_id"), "FAMS").unionByName(no_family(famc, "FAMC"))
        .unionByName(no_person(family_spouse, "spouse")).unionByName(no_person(family_child, "child"))
    )


def warning_summary(warning: DataFrame) -> DataFrame:
    return warning.groupBy("tree_id", "severity").agg(F.count(F.lit(1)).alias("warnings"))
