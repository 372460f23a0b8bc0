"""Closures kept up to date while links come and go.

A focal's ancestors, or their distances, can only change if a changed link begins at the focal or at
one of the ancestors before the change: the first changed link of a line is reached over links
that stood before. Pairs of all other focals stand as they are. The lines of those touched are
walked again over the links after the change, block by block (``blocks.ancestors``), in as many jobs
as there are generations by four, however many rounds of changes lie on top of each other. Loops do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.blocks import ancestors
from kinloom.operators.lineage import cut

_LINK = ["tree_id", "parent_id", "child_id"]
_PAIR = ["tree_id", "focal_id", "person_id"]


def link_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (tree_id, parent_id, child_id) that only ``after`` has, and those that only ``before`` has."""
    old, new = before.select(*_LINK).distinct(), after.select(*_LINK).distinct()
    return new.join(old, _LINK, "left_anti"), old.join(new, _LINK, "left_anti")


def touched_focals(closed: DataFrame, changed: DataFrame) -> DataFrame:
    """(tree_id, focal_id) of those at or below the child of a changed link."""
    ends = changed.select("tree_id", F.col("child_id").alias("person_id")).where("tree_id is not null and person_id is not null").distinct()
    below = closed.join(ends, ["tree_id", "person_id"], "left_semi").select("tree_id", "focal_id")
    return below.unionByName(ends.withColumnRenamed("person_id", "focal_id")).distinct()


def maintained(closed: DataFrame, links: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The ancestor closure (tree_id, focal_id, person_id, min_depth) after a batch of changes.

    ``closed`` is the closure of everybody before, ``links`` the parent links after
    the batch, ``added`` and ``removed`` (tree_id, parent_id, child_id) what changed. The
    outcome is that of ``closure`` over ``links``.
    """
    closed = closed.select(*_PAIR, F.col("min_depth").cast("int").alias("min_depth"))
    touched, size = cut(touched_focals(closed, added.select(*_LINK).unionByName(removed.select(*_LINK))))
    if not size["rows"]:
        return closed
    standing = closed.join(touched, ["tree_id", "focal_id"], "left_anti").select(*closed.columns)
    return standing.unionByName(ancestors(links, touched))
