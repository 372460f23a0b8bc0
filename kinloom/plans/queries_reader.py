"""Queries over files with everything a reader has to note: every event tag, dangling pointers, unknown lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.lineage import scratch_root
from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import big, query
from kinloom.sources.gedcom import EVENT_TAGS, Corpus, parse_corpus
from kinloom.sources.sinks import write_marked

TAGS = [*EVENT_TAGS, "GRAD", "EVEN"]
_parsed: dict[tuple[str, str], Corpus] = {}


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def odd_records(b: Bridge) -> DataFrame:
    """(tree_id, text): one record per customer, and per tree a family and records without a pointer."""
    k, t = F.col("k"), F.col("t")
    people = b.source("customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.expr("cast(c_custkey div 64 as bigint)").alias("t"))
    tag = F.element_at(F.array(*[F.lit(x) for x in TAGS]), (k % len(TAGS) + 1).cast("int"))
    when = lambda rest, line: F.when(k % 10 == rest, line)
    lines = F.array_compact(F.array(
        _line("0 @I", k, "@ INDI"), F.when(k % 10 != 1, _line("1 NAME G", k, " /S/")),
        F.when(k % 10 == 8, _line("1 FAMC @GONE", k, "@")).otherwise(_line("1 FAMC @F", t, "@")), when(2, _line("1 FAMC @F", t, "@")),
        when(3, _line("1 FAMS @NOT", k, "@")), when(4, F.lit("1 _VEND x")), when(5, F.lit("1 HOBBY fishing")),
        _line("1 ", tag), _line("2 DATE ", 1800 + k % 100), F.when(tag == "EVEN", F.lit("2 TYPE Honor")),
    ))
    trees = people.groupBy("t").agg(F.min("k").alias("k"))
    family = F.array(
        _line("0 @F", t, "@ FAM"), _line("1 HUSB @I", k, "@"), _line("1 WIFE @NOONE", t, "@"), _line("1 CHIL @LOST", t, "@"),
        _line("0 @Z", t, "@ WEIRD"), F.lit("0 INDI"), F.lit("1 NAME X /Y/"), F.lit("0 FAM"),
    )
    rows = people.select("t", F.array_join(lines, "\n").alias("text")).unionByName(trees.select("t", F.array_join(family, "\n").alias("text")))
    return rows.select(_line("T", t).alias("tree_id"), "text")


def odd_corpus(b: Bridge) -> Corpus:
    key = (b.spark.sparkContext.applicationId, b.sf_dir)
    if key not in _parsed:
        folder = f"{scratch_root(b.spark)}/kinloom-odd-{uuid.uuid4().hex}"
        zero = F.lit(0)
        placed = odd_records(b).select(
            "tree_id", zero.alias("section"), F.xxhash64("text").alias("seq"), zero.alias("block"), zero.cast("bigint").alias("ord"), zero.alias("pos"), "text")
        write_marked(placed, folder, 128)
        _parsed[key] = parse_corpus(b.spark, folder, bundled=True)
    return _parsed[key]


@query
def reader_notes(b: Bridge) -> DataFrame:
    """All that was skipped, ignored or found dangling, in words."""
    return odd_corpus(b).warning.select("tree_id", "severity", "message", "context")


@query
def reader_event_types(b: Bridge) -> DataFrame:
    """Events of every tag, with the text that an unnamed one takes from its type."""
    return odd_corpus(b).event.select("tree_id", "event_id", "type", "raw_tag", big("date.year", "year"), "description")
