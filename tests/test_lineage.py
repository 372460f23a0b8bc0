"""Intermediate tables go to the shared folder only."""

from __future__ import annotations

import pytest

from kinloom.operators import lineage


class Conf:
    def __init__(self, **settings):
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.removeprefix("spark.").replace(".", "_"), default)


class Session:
    def __init__(self, **settings):
        self.conf = Conf(**settings)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://https://host", ""])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.scratch_root(Session(master=master))


def test_the_setting_of_the_session_is_used():
    assert lineage.scratch_root(Session(master="yarn", checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"


def test_written_tables_are_below_the_folder(spark):
    table, seen = lineage.cut(spark.range(5))
    assert seen["rows"] == 5 and all(lineage.scratch_root(spark) in f for f in table.inputFiles())
