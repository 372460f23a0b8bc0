"""Cut the plan of an iterative job by writing a table to the shared folder.

Executors can be lost at any time, so intermediate results of loops are written
as Parquet under the folder the cluster names in ``spark.checkpoint.dir`` and
read back. On a cluster a missing setting is an error: a machine-local folder
would be seen by one executor only. A session that is one process
(``local[n]``) may do without and then gets a folder of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="kinloom-"))
    return _own_root[0]


def cut(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
    """Write ``df``, return the re-read table and its observed metrics.

    Tables pile up until the folder is cleaned, so they are packed tightly.
    ``rows`` is always measured as part of the write, so that loops need no
    extra job to learn whether they are done.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/kinloom-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get
