"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``limit`` copies. Among all rates that
give each source its target of words, the ones with the highest entropy (that of
``limit`` independent draws) are ``limit / (1 + exp(-lambda_s * size))``: the
documents of a source are tilted exponentially in their size. The lambdas solve
a convex dual, one for each source, by Newton steps whose sums Spark computes
over all documents. Documents of the same source and size have the same rate, so
the steps run on counts of (source, size), which are made once.

Rates are rounded along the running total of rates, documents ordered by size:
the copies of any stretch of that order differ from its rates by less than one.
What a source then misses, at most two of its longest documents, is made up by
single copies, of the largest size that fits each time. A group of one size
deals its copies out evenly. Rates are whole multiples of ``1 / UNIT``; all
totals are exact integers, so reruns agree however rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import WORD, fresh
from kinloom.operators.lineage import cut
from kinloom.operators.numbering import number_rows

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BITS = 20
UNIT = 1 << BITS
SLICES = 1024  # hash slices of a group of documents of one source and size
STEPS = 60
CLOSE = 1e-6


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(key, source_size, target) from (key, source_size).

    Sources in order of their key take the weights in turn. The total is
    ``share`` of all sizes; a target stops at ``limit`` times its source's size,
    and what is above goes to the others by weight. That is target = min(weight *
    level, limit * size), with the level found by raising it until the rest fits.
    """
    numbered = number_rows(sizes, [], ["key"], "nth")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed, _ = cut(numbered.select("key", "source_size", cycle[((F.col("nth") - 1) % len(weights)).cast("int")].alias("weight")))
    cap = F.lit(limit) * F.col("source_size")
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        rest = weighed.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not rest["open"]:
            break
        higher = (share * whole - rest["used"]) / rest["open"]
        if higher <= level:
            break
        level = higher
    return weighed.select("key", "source_size", F.least(F.col("weight") * F.lit(level), cap.cast("double")).alias("target"))


def _rate(tilt: Column, limit: int) -> Column:
    return F.lit(float(limit)) / (F.lit(1.0) + F.exp(-tilt))


def balance(groups: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, scale, tilt): the rate of a document of size x is limit / (1 + exp(-tilt * x / scale)).

    ``groups``: key, size (positive), n. A Newton step that leaves the bracket of
    the solution is replaced by its middle. Sources whose target is nothing or
    all they can give have an infinite tilt.
    """
    mean = groups.groupBy("key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    bound = F.lit(float("inf"))
    state = wanted.join(mean, "key").select(
        "key", "target", "scale",
        F.when(F.col("target") <= 0, -bound).when(F.col("target") >= limit * F.col("source_size"), bound).otherwise(0.0).alias("tilt"),
        F.lit(-float("inf")).alias("low"), bound.alias("high"))
    state, _ = cut(state)
    x = F.col("size") / F.col("scale")
    for _ in range(STEPS):
        moving = state.where(F.abs("tilt") < bound)
        rate = _rate(F.col("tilt") * x, limit)
        sums = groups.join(moving, "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / limit)).alias("slope"))
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.least("high", "tilt")).otherwise(F.col("high"))
        most = F.greatest(F.lit(4.0), F.abs("tilt"))
        step = F.col("tilt") + F.when(F.col("slope") > 0, F.greatest(-most, F.least(most, gap / F.col("slope")))).otherwise(F.signum(gap) * most)
        inside = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        done = F.abs(gap) <= CLOSE * F.col("target")
        after, seen = cut(
            state.join(sums, "key", "left").select(
                "key", "target", "scale", F.when(gap.isNull() | done, F.col("tilt")).otherwise(inside).alias("tilt"),
                F.when(gap.isNull(), F.col("low")).otherwise(low).alias("low"), F.when(gap.isNull(), F.col("high")).otherwise(high).alias("high"),
                (gap.isNotNull() & ~done).alias("open")),
            F.count_if("open").alias("open"))
        state = after.drop("open")
        if not seen["open"]:
            break
    return state.select("key", "scale", "tilt")


def copies_of_groups(groups: DataFrame, tilts: DataFrame, limit: int) -> DataFrame:
    """(key, size, n, copies): the rates of each group of one source and size, rounded along the order of size."""
    rate = (_rate(F.col("tilt") * F.col("size") / F.col("scale"), limit) * UNIT + 0.5).cast("long")
    rated = groups.join(tilts, "key").select("key", "size", "n", (F.col("n") * rate).alias("rates"))
    until = F.sum("rates").over(Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))

    def rounded(total: Column) -> Column:
        return F.shiftright(total + UNIT // 2, BITS)

    return rated.withColumn("until", until).select(
        "key", "size", "n", (rounded(F.col("until")) - rounded(F.col("until") - F.col("rates"))).alias("copies"))


def settle(dealt: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Bring each source nearer to its target, by copies of the largest size that fits what is missing or too much."""
    dealt, _ = cut(dealt)
    while True:
        gaps = dealt.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("got")).join(wanted, "key").select(
            "key", F.round(F.col("target") - F.col("got")).cast("long").alias("gap"))
        room = F.when(F.col("gap") > 0, limit * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = dealt.join(gaps.where("gap != 0"), "key").where((F.col("size") <= F.abs("gap")) & (room > 0))
        change = fits.groupBy("key").agg(F.max(F.struct("size", F.least(room, F.expr("abs(gap) DIV size")).alias("times"), F.signum("gap").cast("long").alias("sign"))).alias("m"))
        dealt, seen = cut(
            dealt.join(change, "key", "left").select(
                "key", "size", "n",
                (F.col("copies") + F.when(F.col("m.size") == F.col("size"), F.col("m.times") * F.col("m.sign")).otherwise(0)).alias("copies"),
                F.col("m").isNotNull().alias("open")),
            F.count_if("open").alias("open"))
        dealt = dealt.drop("open")
        if not seen["open"]:
            return dealt


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """doc_id, key, size, source_size, target, copies and taken of each row of ``docs``.

    Documents without words are not taken: 0 copies. A null source is a source of its own, the last one. Rows with
    equal id, source and size are alike: which of them is copied more often is
    open, how many are is not. ``how``: weights, share, limit.
    """
    limit = how.get("limit", LIMIT)
    sized, _ = cut(docs.select(F.col(doc_id).alias("id"), source_key(F.col(source)).alias("key"), word_count(F.col(text)).alias("size"))
                   .withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int")))
    slices, _ = cut(sized.groupBy("key", "size", "slice").agg(F.count(F.lit(1)).alias("n")))
    groups, _ = cut(slices.groupBy("key", "size").agg(F.sum("n").alias("n")))
    sums = groups.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted, _ = cut(targets(sums, **how))
    solid = groups.where(F.col("size") > 0)
    tilts = balance(solid, wanted, limit)
    dealt = settle(copies_of_groups(solid, tilts, limit), wanted, limit)
    by_slice = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slices.withColumn("ahead", F.coalesce(F.sum("n").over(by_slice), F.lit(0))).drop("n")
    offsets = ahead.join(dealt.select("key", "size", "n", "copies"), ["key", "size"])
    nth = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("id"))
    placed = sized.withColumn("nth", nth).join(offsets, ["key", "size", "slice"], "left").join(wanted, "key")
    own = F.expr("(ahead + nth) * copies DIV n - (ahead + nth - 1) * copies DIV n")
    return placed.select(
        F.col("id").alias(doc_id), "key", "size", "source_size", "target", F.coalesce(own, F.lit(0)).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, numbered from 1 in ``copy``.

    Documents without words go; a column named ``copy`` gives way. Rows that
    repeat an id within a source and size share their copies, the first ones by
    text get what does not divide evenly.
    """
    same, key, size, rows, total, nth = fresh(docs, "__same", "__key", "__size", "__rows", "__total", "__nth")

    def id_key(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("a"), F.col(column).cast("string")), F.lit("b"))

    plan = mix(docs, doc_id, text, source, **how).groupBy(
        id_key(doc_id).alias(same), F.col("key").alias(key), F.col("size").alias(size)
    ).agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(total)).where(F.col(total) > 0)
    alike = Window.partitionBy(same, key, size).orderBy(text)
    placed = docs.withColumns({same: id_key(doc_id), key: source_key(F.col(source)), size: word_count(F.col(text))}).withColumn(
        nth, F.row_number().over(alike)).join(plan, [same, key, size])
    copies = F.floor(F.col(total) / F.col(rows)) + (F.col(nth) <= F.col(total) % F.col(rows)).cast("long")
    kept = [c for c in docs.columns if c.lower() != "copy"]
    return placed.where(copies > 0).select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
