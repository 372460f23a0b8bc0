"""Edit logs that arrive as a stream.

Every micro-batch appends its edits to a log and brings the trees it touches up to
date. What a tree was after its last batch is kept as a snapshot, so a batch replays
its own edits on top of the snapshots of its trees, however long their history is.
Edits that come late, before the last one a snapshot holds, make their tree start
again from its base tables and the whole log; edits that come again are left out.
The outcome is that of one batch over the whole log.

Layout under one root, all tables Parquet by ``batch_id`` and ``bucket``, a hash of
the tree:

- ``log``: the edits as they came;
- ``state/<table>``: snapshots of the trees that a batch has touched;
- ``index``: for each bucket a batch has touched, the batch of every tree's latest
  snapshot and the last edit it holds;
- ``heads``: for each bucket, the batch of its latest index.

A batch reads the parts of earlier batches only and overwrites its own, so it may
run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.edits import OP_SCHEMA, Tree, as_base, replay
from kinloom.operators.lineage import cut

OP_KEY = ["tree_id", "seq"]
BUCKETS = 256
PART = ", batch_id bigint, bucket int"
INDEX = "tree_id string, version bigint, last_seq bigint"


def dedup_ops(op: DataFrame) -> DataFrame:
    return op.dropDuplicates(OP_KEY)


def bucket_of(tree_id) -> Column:
    return F.pmod(F.xxhash64(tree_id), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty before anything was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, root: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The log so far, or only some of its buckets, which are folders, or only earlier batches."""
    log = _read(spark, f"{root}/log", OP_SCHEMA + PART)
    log = log if buckets is None else log.where(F.col("bucket").isin(buckets))
    return (log if before is None else log.where(F.col("batch_id") < before)).drop("batch_id", "bucket")


def restrict(base: Tree, trees: DataFrame) -> Tree:
    """Rows of some trees only."""
    parts = {n: getattr(base, n).join(trees.select("tree_id"), "tree_id", "left_semi") for n in base.__dataclass_fields__}
    return Tree(**parts)


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("bucket", bucket_of("tree_id")).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


@dataclass
class Work:
    """What a batch had to do: edits read again from the log and replayed, trees taken from a snapshot or from their base."""

    replayed: int = 0
    from_log: int = 0
    continued: int = 0
    from_base: int = 0


class Snapshots:
    """The latest state of every tree."""

    def __init__(self, spark: SparkSession, root: str, layout: Tree) -> None:
        self.spark, self.root, self.layout = spark, root, layout

    def heads(self, batch_id: int) -> dict[int, int]:
        """Bucket -> batch of its latest index, as earlier batches have left it; at most BUCKETS entries."""
        known = _read(self.spark, f"{self.root}/heads", "bucket int, version bigint, batch_id bigint").where(F.col("batch_id") < batch_id)
        last = known.agg(F.max("batch_id")).first()[0]
        return {} if last is None else {r["bucket"]: r["version"] for r in known.where(F.col("batch_id") == last).collect()}

    def index(self, heads: dict[int, int], buckets: list[int]) -> DataFrame:
        """(tree_id, version, last_seq, bucket) of all trees of some buckets."""
        table = _read(self.spark, f"{self.root}/index", INDEX + PART)
        latest = F.lit(False)
        for bucket in buckets:
            if bucket in heads:
                latest = latest | ((F.col("batch_id") == heads[bucket]) & (F.col("bucket") == bucket))
        return table.where(latest).select("tree_id", "version", "last_seq", "bucket")

    def state(self, trees: DataFrame, buckets: list[int]) -> Tree:
        """The snapshots of some trees (tree_id, version)."""
        versions = [r["version"] for r in trees.select("version").distinct().collect()]  # at most one per earlier batch
        wanted = trees.select("tree_id", F.col("version").alias("batch_id"))

        def part(name: str) -> DataFrame:
            kind = getattr(self.layout, name).schema
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
            table = _read(self.spark, f"{self.root}/state/{name}", schema + PART).where(F.col("batch_id").isin(versions) & F.col("bucket").isin(buckets))
            return table.join(wanted, ["tree_id", "batch_id"], "left_semi").select(*kind.names)

        return Tree(**{f.name: part(f.name) for f in fields(Tree)})

    def put(self, tables: Tree, index: DataFrame, heads: dict[int, int], buckets: list[int], batch_id: int) -> None:
        """The heads come last: a part without a head is not read."""
        for f in fields(Tree):
            _put(getattr(tables, f.name), f"{self.root}/state/{f.name}", batch_id)
        _put(index, f"{self.root}/index", batch_id)
        now = heads | dict.fromkeys(buckets, batch_id)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/heads/batch_id={batch_id}")


def apply_batch(batch: DataFrame, batch_id: int, base: Tree, root: str, publish: Callable[[Tree, DataFrame, int], None]) -> Work:
    """Log one batch and bring its trees up to date; ``publish(tables, touched_trees, batch_id)`` stores the outcome."""
    spark, work = batch.sparkSession, Work()
    _put(dedup_ops(batch), f"{root}/log", batch_id)
    every = spark.read.schema(OP_SCHEMA + ", bucket int").parquet(f"{root}/log/batch_id={batch_id}")
    buckets = [r["bucket"] for r in every.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    if not buckets:
        return work
    layout = as_base(base)
    store = Snapshots(spark, root, layout)
    heads = store.heads(batch_id)
    known, _ = cut(store.index(heads, buckets))
    known_trees = known.select("tree_id", "version", "last_seq")

    came = every.drop("bucket").join(known_trees, "tree_id", "left").withColumn("late", F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False)))
    came, seen = cut(came, F.count_if("late").alias("late"))
    if seen["late"]:  # which of them are new, and what their trees had before
        late = came.where("late")
        log = read_log(spark, root, buckets, before=batch_id).join(late.select("tree_id").distinct(), "tree_id", "left_semi")
        log, read = cut(dedup_ops(log))
        work.from_log = read["rows"]
        again = late.select(*OP_KEY).join(log.select(*OP_KEY), OP_KEY, "left_semi")
        came, _ = cut(came.join(again, OP_KEY, "left_anti"))
    else:
        log = came.drop("version", "last_seq", "late").where(F.lit(False))
    trees, _ = cut(came.groupBy("tree_id").agg(F.max("seq").alias("last"), F.bool_or("late").alias("late"), F.max("version").alias("version"),
                                               F.max("last_seq").alias("last_seq")))
    afresh = trees.where(F.col("late") | F.col("version").isNull())
    onward = trees.where(~F.col("late") & F.col("version").isNotNull())
    old = log.join(trees.where("late"), "tree_id", "left_semi")
    ops, read = cut(came.drop("version", "last_seq", "late").unionByName(old))
    work.replayed, work.continued, work.from_base = read["rows"], onward.count(), afresh.count()
    if not work.replayed:
        return work
    start, kept = restrict(layout, afresh), store.state(onward, buckets)
    tables = replay(Tree(**{f.name: cut(getattr(start, f.name).unionByName(getattr(kept, f.name)))[0] for f in fields(Tree)}), ops)
    touched = trees.select("tree_id")
    publish(tables, touched, batch_id)
    index = known_trees.join(touched, "tree_id", "left_anti").unionByName(
        trees.select("tree_id", F.lit(batch_id).cast("bigint").alias("version"), F.greatest("last", "last_seq").alias("last_seq")))
    store.put(as_base(tables), index, heads, buckets, batch_id)
    return work


def apply_stream(
    ops: DataFrame, base: Tree, root: str, checkpoint: str, publish: Callable[[Tree, DataFrame, int], None]
):
    """Start the stream over the edits; see ``apply_batch``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, base, root, publish)

    return (
        ops.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_ops(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(OP_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
