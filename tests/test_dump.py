"""Written dumps and scratch tables are packed."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from kinloom.operators.lineage import cut
from kinloom.sources import sinks


def test_dumps_are_packed_and_read_back(spark, tmp_path):
    rows = spark.range(5000).select(F.lit("T").alias("tree_id"), F.concat(F.lit("I"), "id").alias("person_id"), F.lit("x" * 200).alias("text"))
    sinks.write_model_json(SimpleNamespace(**dict.fromkeys(sinks.TABLES, rows)), str(tmp_path / "dump"))
    parts = [p for p in (tmp_path / "dump" / "event").iterdir() if p.name.startswith("part-")]
    assert parts and all(p.name.endswith(".json.gz") for p in parts) and sum(p.stat().st_size for p in parts) < 5000 * 200 / 5
    back = sinks.read_model_json(spark, str(tmp_path / "dump"))
    assert all(t.select(*rows.columns).exceptAll(rows).count() == 0 and t.count() == 5000 for t in back.values())


def test_scratch_tables_are_packed(spark):
    table, _ = cut(spark.range(10))
    assert all(".zstd.parquet" in f for f in table.inputFiles()) and Path(table.inputFiles()[0].removeprefix("file://")).exists()
