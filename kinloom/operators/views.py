"""Bounded neighbourhoods of focal persons, their flags and induced edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.names import name_matches
from kinloom.functions.text import trim
from kinloom.operators.closure import closure
from kinloom.operators.graph import all_edges, neighbours, siblings, spouse_links
from kinloom.operators.lineage import cut
from kinloom.operators.numbering import number_rows

# Default reach and size of a view.
UP, DOWN = 4, 0

CELLS = 16  # keys the list of one gram is dealt to
GRAMS = (1, 2, 3, 6)  # letters in a gram; a text is looked up by the longest that fit
SHORT_LIST = 10_000  # a list up to this long stays on one key
LONGER_LIST = 8  # a list so many times longer than the rarest one is not read
_VIEW = ["tree_id", "focal_id"]


def _blood(parents: DataFrame, focals: DataFrame, up: int, down: int) -> DataFrame:
    """Focal and blood relatives in the order a breadth-first walk finds them."""
    none = F.array().cast("array<bigint>")
    rows = focals.select(*_VIEW).distinct().select(
        *_VIEW, F.col("focal_id").alias("person_id"), F.lit(0).alias("generation"),
        F.struct(F.lit(0).alias("phase"), F.lit(0).alias("d"), none.alias("k")).alias("found"),
    )
    for direction, reach, phase, sign in (("up", up, 1, 1), ("down", down, 2, -1)):
        if reach > 0:
            walked = closure(parents, focals, direction, reach, ordered=True).select(
                *_VIEW, "person_id", (F.col("min_depth") * sign).alias("generation"),
                F.struct(F.lit(phase).alias("phase"), F.col("min_depth").alias("d"), F.col("walk_key").alias("k"))
                .alias("found"),
            )
            rows = rows.unionByName(walked)
    return rows.groupBy(*_VIEW, "person_id").agg(
        F.min_by("generation", "found").alias("generation"), F.min("found").alias("found")
    )


def ego_members(
    parents: DataFrame, spouses: DataFrame, person: DataFrame, focals: DataFrame,
    up: int = UP, down: int = DOWN, include_spouses: bool = True, *, budget: int | None,
) -> DataFrame:
    """(tree_id, focal_id, person_id, generation) kept by the node budget."""
    blood, _ = cut(_blood(parents, focals, up, down))
    rows = blood.select(*_VIEW, "person_id", "generation", F.lit(False).alias("spouse_only"))
    if include_spouses:
        wed = blood.join(spouse_links(spouses), ["tree_id", "person_id"]).select(
            *_VIEW, F.col("spouse_id").alias("person_id"), "generation", "found"
        )
        wed = wed.join(blood.select(*_VIEW, "person_id"), [*_VIEW, "person_id"], "left_anti")
        wed = wed.groupBy(*_VIEW, "person_id").agg(F.min_by("generation", "found").alias("generation"))
        rows = rows.unionByName(wed.withColumn("spouse_only", F.lit(True)))
    known = rows.join(person.select("tree_id", "person_id"), ["tree_id", "person_id"], "left_semi")
    order = Window.partitionBy(*_VIEW).orderBy(
        (F.col("person_id") != F.col("focal_id")), F.col("spouse_only"),
        F.when(~F.col("spouse_only"), F.abs("generation")).otherwise(0), F.col("person_id"),
    )
    return known.withColumn("_at", F.row_number().over(order)).where(F.lit(True) if budget is None else F.col("_at") <= budget).select(
        *_VIEW, "person_id", "generation"
    )


def unexpanded(nodes: DataFrame, around: DataFrame, parents: DataFrame, spouses: DataFrame) -> DataFrame:
    """Nodes with a neighbour outside ``around``: (tree_id, focal_id, person_id)."""
    beside = nodes.select(*_VIEW, "person_id").join(neighbours(parents, spouses), ["tree_id", "person_id"])
    inside = around.select(*_VIEW, F.col("person_id").alias("neighbour_id"))
    return beside.join(inside, [*_VIEW, "neighbour_id"], "left_anti").select(*_VIEW, "person_id").distinct()


def flag_nodes(
    nodes: DataFrame, around: DataFrame, parents: DataFrame, spouses: DataFrame, collapse: DataFrame
) -> DataFrame:
    """Add is_focal, is_collapse and has_unexpanded."""
    keys = [*_VIEW, "person_id"]
    open_ends = unexpanded(nodes, around, parents, spouses).withColumn("_open", F.lit(True))
    folded = collapse.select(
        *_VIEW, F.col("ancestor_id").alias("person_id"), F.lit(True).alias("_collapse")
    ).distinct()
    return nodes.join(open_ends, keys, "left").join(folded, keys, "left").select(
        *keys, "generation", (F.col("person_id") == F.col("focal_id")).alias("is_focal"),
        F.coalesce("_collapse", F.lit(False)).alias("is_collapse"),
        F.coalesce("_open", F.lit(False)).alias("has_unexpanded"),
    )


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in the same view."""
    start = nodes.select(*_VIEW, F.col("person_id").alias("from_id"))
    end = nodes.select(*_VIEW, F.col("person_id").alias("to_id"))
    return start.join(edges, ["tree_id", "from_id"]).join(end, [*_VIEW, "to_id"], "left_semi").select(
        *_VIEW, "type", "from_id", "to_id", "family_id"
    )


def blood_edges(view_edges: DataFrame, show_spouses: bool = False) -> DataFrame:
    return view_edges if show_spouses else view_edges.where(F.col("type") != "spouseOf")


def expand(
    view: DataFrame, asked: DataFrame, parents: DataFrame, spouses: DataFrame, collapse: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Neighbours revealed by expanding one person per view, and the edges they bring.

    ``view(tree_id, focal_id, person_id, generation)``;
    ``asked(tree_id, focal_id, person_id, direction)`` with direction
    ``ancestors``, ``descendants`` or ``all``.
    """
    anchor = asked.join(view, [*_VIEW, "person_id"], "left").select(
        *_VIEW, F.col("person_id").alias("anchor_id"), "direction",
        F.coalesce("generation", F.lit(0)).alias("g"),
    )
    hop = lambda kind, me, other, df: df.select(
        "tree_id", F.col(me).alias("anchor_id"), F.col(other).alias("person_id"), F.lit(kind).alias("kind")
    )
    hops = (
        hop(0, "child_id", "parent_id", parents).unionByName(hop(1, "parent_id", "child_id", parents))
        .unionByName(hop(2, "person_id", "spouse_id", spouse_links(spouses)))
    )
    wanted = (
        ((F.col("kind") == 0) & F.col("direction").isin("ancestors", "all"))
        | ((F.col("kind") == 1) & F.col("direction").isin("descendants", "all"))
        | ((F.col("kind") == 2) & (F.col("direction") == "all"))
    )
    generation = F.when(F.col("kind") == 0, F.col("g") + 1).when(F.col("kind") == 1, F.col("g") - 1)
    added = (
        anchor.join(hops, ["tree_id", "anchor_id"]).where(wanted)
        .join(view.select(*_VIEW, "person_id"), [*_VIEW, "person_id"], "left_anti")
        .withColumn("generation", generation.otherwise(F.col("g")))
        .groupBy(*_VIEW, "person_id").agg(F.min_by("generation", "kind").alias("generation"))
    )
    added, _ = cut(added)
    after = view.select(*_VIEW, "person_id").unionByName(added.select(*_VIEW, "person_id"))
    nodes = flag_nodes(added, after, parents, spouses, collapse)
    fresh = added.select(*_VIEW, F.col("person_id").alias("_new"))
    edges = induced_edges(after, all_edges(parents, spouses))
    one = edges.join(fresh.withColumnRenamed("_new", "from_id"), [*_VIEW, "from_id"], "left_semi")
    two = edges.join(fresh.withColumnRenamed("_new", "to_id"), [*_VIEW, "to_id"], "left_semi")
    columns = [*_VIEW, "type", "from_id", "to_id", "family_id"]
    return nodes, one.select(*columns).unionByName(two.select(*columns)).distinct()


def with_siblings(members: DataFrame, parents: DataFrame, budget: int | None) -> DataFrame:
    """Add siblings of the shown people, in view order, until the budget is used up."""
    members, _ = cut(members)
    shown = members.select("tree_id", "person_id").distinct()
    sibs = siblings(parents, shown)
    near = members.select(
        *_VIEW, "person_id",
        F.struct(
            (F.col("person_id") != F.col("focal_id")).alias("r"), (-F.col("generation")).alias("g"),
            F.col("person_id").alias("i"),
        ).alias("place"),
    )
    extra = (
        near.join(sibs, ["tree_id", "person_id"])
        .select(*_VIEW, F.col("sibling_id"), F.struct("place", "order_key").alias("at"))
        .groupBy(*_VIEW, "sibling_id").agg(F.min("at").alias("at"))
        .join(members.select(*_VIEW, F.col("person_id").alias("sibling_id")), [*_VIEW, "sibling_id"], "left_anti")
    )
    room = members.groupBy(*_VIEW).agg((F.lit(9223372036854775807 if budget is None else budget) - F.count(F.lit(1))).alias("room"))
    ranked = number_rows(extra, _VIEW, ["at"], "n").join(room, _VIEW)
    taken = ranked.where(F.col("n") <= F.col("room")).select(
        *_VIEW, F.col("sibling_id").alias("person_id"), F.lit(None).cast("int").alias("generation")
    )
    return members.select(*_VIEW, "person_id", "generation").unionByName(taken)


def default_focal(
    person: DataFrame, degrees: DataFrame, latest_year: DataFrame, roots: DataFrame | None = None
) -> DataFrame:
    """One focal person per tree: declared root, else youngest leaf, else best connected.

    A single ordered aggregate per tree; partial results combine before the shuffle.
    ``roots(tree_id, root_id)`` may be absent.
    """
    rows = person.select("tree_id", "person_id").join(degrees, ["tree_id", "person_id"]).join(
        latest_year, ["tree_id", "person_id"], "left"
    )
    if roots is not None:
        rows = rows.join(roots.select("tree_id", F.col("root_id").alias("person_id"), F.lit(True).alias("is_root")),
                         ["tree_id", "person_id"], "left")
    else:
        rows = rows.withColumn("is_root", F.lit(None).cast("boolean"))
    leaf = F.col("is_leaf")
    rank = F.struct(
        F.when(F.col("is_root"), 0).otherwise(1).alias("r"),
        F.when(leaf, 0).otherwise(1).alias("l"),
        F.when(leaf & F.col("latest_year").isNotNull(), 0).otherwise(1).alias("dated"),
        F.when(leaf, -F.coalesce("latest_year", F.lit(0))).otherwise(0).alias("y"),
        F.when(leaf, F.lit(0).cast("bigint")).otherwise(-F.col("degree")).alias("d"),
        F.col("person_id").alias("i"),
    )
    return rows.groupBy("tree_id").agg(F.min_by("person_id", rank).alias("focal_id"))


def latest_years(person_event: DataFrame, event: DataFrame) -> DataFrame:
    """Latest known year over a person's own events."""
    dated = event.where(F.col("date.year").isNotNull()).select(
        "tree_id", "event_id", F.col("date.year").alias("year")
    )
    return person_event.join(dated, ["tree_id", "event_id"]).groupBy("tree_id", "person_id").agg(
        F.max("year").alias("latest_year")
    )


def _grams(text: Column, size: int) -> Column:
    """All stretches of ``size`` letters."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: text.substr(i, F.lit(size)))
    return F.when(F.length(text) >= size, every).otherwise(F.array().cast("array<string>"))


def name_grams(person: DataFrame, cells: int = CELLS) -> DataFrame:
    """(gram, cell, tree_id, person_id): who has one to three, or six, letters in a row in any form of any name.

    The list of a frequent gram is dealt to ``cells`` keys by person.
    """
    forms = F.array_distinct(F.flatten(F.transform(
        "names", lambda n: F.array(*[F.lower(F.coalesce(n[f], F.lit(""))) for f in ("full", "given", "surname", "raw")]))))
    grams = F.flatten(F.transform(forms, lambda form: F.concat(*[_grams(form, size) for size in GRAMS])))
    return person.select(
        "tree_id", "person_id", F.pmod(F.xxhash64("tree_id", "person_id"), F.lit(cells)).cast("int").alias("cell"),
        F.explode(F.array_distinct(grams)).alias("gram")).select("gram", "cell", "tree_id", "person_id")


def search_people(person: DataFrame, grams: DataFrame, texts: DataFrame, lists: int = 3, cells: int = CELLS) -> DataFrame:
    """Matches of each search text ``texts(query)`` per tree, ranked in file order.

    Whoever matches a text has all its grams, so only people on the list of its rarest
    gram are looked at; further lists narrow them down where they are not much longer.
    The test itself is ``name_matches``. ``grams`` is ``name_grams(person, cells)``, as
    a table. Blank texts find nobody.
    """
    needle = F.lower(trim(F.col("query")))
    asked = texts.select("query").distinct().withColumn("needle", needle).where("needle <> ''")
    parts = F.when(F.length("needle") >= 6, _grams(F.col("needle"), 6)).when(F.length("needle") >= 3, _grams(F.col("needle"), 3)).otherwise(
        F.array("needle"))
    asked, _ = cut(asked.select("query", F.explode(F.array_distinct(parts)).alias("gram")))
    # counted before the lists meet anything: only a number per gram travels
    sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(asked.select("gram").distinct(), "gram", "left_semi")
    sized = asked.join(sizes, "gram", "left").fillna(0, ["n"])
    by_size = Window.partitionBy("query").orderBy("n", "gram")
    ranked = sized.withColumn("no", F.row_number().over(by_size)).withColumn("least", F.min("n").over(Window.partitionBy("query")))
    chosen = ranked.where((F.col("no") == 1) | ((F.col("no") <= lists) & (F.col("n") <= LONGER_LIST * F.col("least"))))
    chosen = chosen.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("query")))
    # written out row by row, so that the engine knows how many there are before it chooses a join
    spread = chosen.where("least > 0").withColumn("cell", F.explode(
        F.when(F.col("n") <= SHORT_LIST, F.array(F.lit(-1))).otherwise(F.array(*[F.lit(i) for i in range(cells)]))))
    spread, _ = cut(spread.select("query", "gram", "wanted", "cell"))
    listed = grams.join(spread.select("gram", (F.col("cell") >= 0).alias("dealt")).distinct(), "gram")
    listed = listed.withColumn("cell", F.when(F.col("dealt"), F.col("cell")).otherwise(F.lit(-1)))
    met = listed.hint("shuffle_merge").join(spread, ["gram", "cell"]).groupBy("query", "tree_id", "person_id").agg(
        F.count(F.lit(1)).alias("met"), F.max("wanted").alias("wanted")).where("met = wanted")
    hits = met.join(person.select("tree_id", "person_id", "seq", "names"), ["tree_id", "person_id"]).where(
        name_matches(F.col("names"), F.col("query"))).select("tree_id", "query", "person_id", "seq")
    return number_rows(hits, ["tree_id", "query"], ["seq", "person_id"], "rank").select("tree_id", "query", "person_id", "rank")


def list_people(person: DataFrame) -> DataFrame:
    """People of each tree, ranked in file order."""
    return number_rows(person.select("tree_id", "person_id", "seq"), ["tree_id"], ["seq", "person_id"], "rank").select(
        "tree_id", "person_id", "rank")


def pick_ancestors(ordered_ancestors: DataFrame, names: DataFrame, queries: DataFrame) -> DataFrame:
    """Ancestors of each focal whose display name contains the query text, ranked by nearness.

    ``queries(tree_id, focal_id, query)``: an empty text matches everyone.
    """
    q = F.lower(F.trim("query"))
    hits = (
        queries.join(ordered_ancestors, _VIEW).join(names, ["tree_id", "person_id"])
        .where((q == "") | F.contains(F.lower("name"), q))
    )
    order = Window.partitionBy(*_VIEW, "query").orderBy("min_depth", "walk_key")
    return hits.withColumn("rank", F.row_number().over(order)).select(*_VIEW, "query", "person_id", "rank")


def next_ids(ids: DataFrame, prefix: str, id_col: str) -> DataFrame:
    """Next free ``<prefix><n>`` per tree."""
    number = F.regexp_extract(F.col(id_col), f"^{prefix}(\\d+)$", 1)
    value = F.when(number != "", number).cast("bigint")
    return ids.groupBy("tree_id").agg(
        F.concat(F.lit(prefix), (F.coalesce(F.max(value), F.lit(0)) + 1).cast("string")).alias("next_id")
    )
