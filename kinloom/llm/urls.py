"""URL filters as a sort-merge range join.

A rule is a host and a path prefix; it fits the host and its subdomains. With the
labels of a host in reverse order, each followed by a dot (``org.example.``), all
hosts under a rule's host are one interval of the sort order, and below one rule
host all paths with a prefix are one interval too. Such intervals are nested or
apart, so one sweep in sort order answers every url: a running count of open
intervals gives the height of the stack of active rules, and the rule at level
``n`` of the stack is the last one that was opened at that level.

Two sweeps run: the first, over hosts, gives every active rule host of a url;
the second, over (rule host, path), gives the longest path prefix below each.

The sweep is cut into ranges of about equal numbers of rows, whatever their keys:
rows of one hot host or url spread over ranges. What earlier ranges left open is
carried over as one count per range and one rule per range and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import fresh
from kinloom.operators.lineage import cut

ALLOW, BLOCK = "allow", "block"
START, POINT, END = 0, 1, 2  # order of events with equal keys
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    """``www.example.org`` -> ``org.example.www.``; the empty host, above all others, is empty."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(rules: DataFrame, points: DataFrame, whole_stack: bool) -> DataFrame:
    """Rows of ``points`` with the rules whose intervals they lie in: all of them, or the innermost.

    ``rules``: place, prefix (string), rule; distinct in place and prefix.
    ``points``: place, prefix (the text that starts with a rule's prefix), load.
    Points outside every interval are left out.
    """
    key = F.col("prefix").cast("binary")

    def events(rows: DataFrame, kind: int, at: Column) -> DataFrame:
        rule, load = F.col("rule") if kind == START else F.lit(None), F.col("load") if kind == POINT else F.lit(None)
        return rows.select(
            "place", at.alias("key"), F.lit(kind).alias("kind"),
            rule.cast(rules.schema["rule"].dataType).alias("rule"), load.cast(points.schema["load"].dataType).alias("load"))

    # no UTF-8 text holds the byte FF, so an interval ends behind everything that starts with its prefix
    line = events(rules, START, key).unionByName(events(rules, END, F.concat(key, F.lit(b"\xff")))).unionByName(events(points, POINT, key))
    line = line.withColumn("nth", F.monotonically_increasing_id())
    line = line.repartitionByRange("place", "key", "kind", "nth").drop("nth").withColumn("range", F.spark_partition_id())
    line, _ = cut(line)  # borders come from a sample; the written table fixes them
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    before = F.coalesce(F.sum("opened").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = line.groupBy("range").agg(F.sum(step).alias("opened")).select("range", before.alias("before"))  # one row per range
    order = ["place", "key", "kind"]
    so_far = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    height = line.withColumn("height", F.sum(step).over(so_far)).where(F.col("kind") != END).join(opened, "range").withColumn(
        "level", (F.col("before") + F.col("height")).cast("int"))
    if whole_stack:  # a point looks at every level of the stack, a rule stands at its own
        levels = F.when(F.col("kind") == START, F.array("level")).when(F.col("level") > 0, F.sequence(F.lit(1), F.col("level")))
        height = height.withColumn("level", F.explode(levels))
    height = height.where(F.col("level") > 0).select("range", "level", *order, "rule", "load")
    here = Window.partitionBy("range", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") == START, F.struct(*order, "rule")))["rule"]
    earlier = Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = height.groupBy("range", "level").agg(last.alias("last")).select(
        "range", "level", F.last("last", True).over(earlier).alias("carried"))
    found = height.withColumn("here", F.last("rule", True).over(here)).where(F.col("kind") == POINT)
    return found.join(carried, ["range", "level"]).select("load", F.coalesce("here", "carried").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` plus host, path, rule and verdict of each url.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the
    url's path starts with its path; the longest rule (host and path together,
    then the longer host) wins. A rule without a host fits every host, one with
    an empty path every path. Rules that repeat host and path count once, with
    the verdict last in code-point order, so block beats allow.

    ``rule`` is host and path of the rule, null where none fits; the verdict is
    then ``default``. A null url, or one without ``://``, has an empty host and
    path. Rows stay as they are, repeated ones too; columns named like the new
    ones give way. Urls are UTF-8. Every column of ``pages`` travels in one
    shuffle: select what is needed.
    """
    number, won = fresh(pages, "__number", "__won")
    new = {"host", "path", "rule", "verdict"}
    host, path = host_and_path(F.coalesce(F.col(url), F.lit("")))
    rows, _ = cut(pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c.lower() not in new], host.alias("host"), path.alias("path"),
        F.monotonically_increasing_id().alias(number)))
    listed, _ = cut(rules.groupBy(
        lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict")))

    hosts = listed.select("host").distinct().select(F.lit("").alias("place"), canonical(F.col("host")).alias("prefix"), F.col("host").alias("rule"))
    asked = rows.select(F.lit("").alias("place"), canonical(F.col("host")).alias("prefix"), F.struct(F.col(number).alias("number"), "path").alias("load"))
    under = sweep(hosts, asked, whole_stack=True)

    size = F.length("host") + F.length("path")
    told = F.struct(size.alias("size"), F.length("host").alias("of_host"), "verdict", F.concat("host", "path").alias("rule"))
    paths = listed.select(F.col("host").alias("place"), F.col("path").alias("prefix"), told.alias("rule"))
    asked = under.select(F.col("rule").alias("place"), F.col("load.path").alias("prefix"), F.col("load.number").alias("load"))
    best = sweep(paths, asked, whole_stack=False).groupBy(F.col("load").alias(number)).agg(F.max("rule").alias(won))

    return rows.join(best, number, "left").select(
        *[F.col(f"`{c}`") for c in rows.columns if c != number],
        F.col(f"{won}.rule").alias("rule"), F.coalesce(f"{won}.verdict", F.lit(default)).alias("verdict"))
