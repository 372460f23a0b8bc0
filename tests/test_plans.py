"""Plans stay in the engine: no Python workers, no all-pairs joins, pruned scans."""

from __future__ import annotations

from pathlib import Path

import pytest

from kinloom.plans.bridge import Bridge
from kinloom.plans.catalog import load_all

FOLDER = "/root/testdata/sf0.001"
LAZY = [
    "graph_edges", "siblings", "neighbours", "names_parsed", "place_dimension", "service_records",
    "research_facts", "person_sketch", "spouse_checks", "data_richness", "vault_documents", "project_manifests",
    "research_person_facts", "unlink_spouse_impact", "gedcom_text",
]
WRITTEN = [
    "people_on_line", "locality_report", "research_gaps", "research_plan_lines", "checklist_links", "checklist_reach",
    "checklist_items", "checklist_summary", "record_copy_spans", "relationship_terms", "nearest_common_ancestors",
    "relationship_paths", "collapse_paths", "pedigree_collapse", "path_counts", "reader_notes", "next_ids",
    "name_search", "society_totals", "maintained_closure",
]
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonRDD"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", LAZY)
def test_no_banned_operator(spark, name):
    text = plan(load_all()[name](spark, FOLDER))
    assert not [b for b in BANNED if b in text]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", WRITTEN)
def test_no_banned_operator_in_written_steps(spark, name, monkeypatch):
    """The tables that a query writes on its way are looked at as well."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        seen.append(plan(DataFrame(self._df._jdf, self._df.sparkSession)))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    seen.append(plan(load_all()[name](spark, FOLDER)))
    assert not [b for b in BANNED for text in seen if b in text]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_scan_reads_only_what_is_used(spark):
    text = plan(Bridge(spark, FOLDER).person_raw().select("seq"))
    assert "c_custkey" in text and "c_acctbal" not in text and "c_name" not in text
    events = plan(Bridge(spark, FOLDER).event().where("type = 'military'").select("event_id"))
    assert "EqualTo(type,military)" in events and "description" not in events
