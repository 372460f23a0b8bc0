"""Links checked at the moment they are made.

A link edit is refused if it would make somebody their own ancestor, parent or
spouse, in the tree as all earlier edits have left it: earlier links that were let
through count, refused ones do not, unlinks and merges before it have happened.
So whether a link stands depends on earlier links, and, since a merge may turn a
child of a family into its parent, on what those links lead to.

The memberships of all links are followed once through removals and merges, each
with the link it comes from, and joined to parent-child edges with the time they
hold. Then two bounds close in on the truth:

- the wide one keeps every link not known to be refused, and ends a membership
  only where that is certain;
- the narrow one keeps links known to be lawful, and ends a membership wherever
  that is possible.

A link that closes no loop over the wide edges is lawful, one that closes a loop
over the narrow edges is refused. In every tree the earliest open question has only
settled ones before it, so each round settles it, and usually many others at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.names import parse_names
from kinloom.operators.edits import FAR, Replay, Tree, _moves, existing_at, follow_tokens, kind, without_op
from kinloom.operators.lineage import cut

BASE = -1  # origin of what the tree had before all edits
_LINK = ["tree_id", "seq"]
_TOKEN = ["tree_id", "family_id", "key"]
WIDE = 100_000  # frontier rows from which on each level is written


def proposals(op: DataFrame, life: DataFrame) -> DataFrame:
    """(tree_id, seq, relation, a_id, b_id) of links between two people who exist then; a parent and child, or two spouses."""
    links = kind(op, "linkRelationship")
    blood = links.where("relation = 'parent-child'").select(*_LINK, "relation", F.col("parent_id").alias("a_id"), F.col("child_id").alias("b_id"))
    wed = links.where("relation = 'spouse'").select(*_LINK, "relation", F.col("spouse_a").alias("a_id"), F.col("spouse_b").alias("b_id"))
    both = blood.unionByName(wed)
    for end in ("a_id", "b_id"):
        both = existing_at(both.withColumnRenamed(end, "id"), life).drop("from_seq").withColumnRenamed("id", end)
    return both.select(*_LINK, "relation", "a_id", "b_id")


def _origin(key: str) -> Column:
    return F.element_at(key, 1)


class Moments:
    """Memberships and edges of a tree over time, with the links they depend on."""

    def __init__(self, base: Tree, op: DataFrame) -> None:
        run = Replay(base, op)
        self.life = run.life
        self.spouse = follow_tokens(run._tokens(base.family_spouse, "spouse"), run._spouse_gone, run.moves, False)
        self.child = follow_tokens(run._tokens(base.family_child, "child"), run._child_gone, run.moves, False)
        self.edges = self._edges()
        self.ends = self._ends(_moves(run.life))

    def _edges(self) -> DataFrame:
        """(tree_id, parent_id, child_id, f, u, by_spouse, by_child, family_id, key): edges from f to u; key is the child's token."""
        one = self.spouse.select("tree_id", "family_id", F.col("id").alias("parent_id"), F.col("t").alias("f1"), F.col("e").alias("u1"), _origin("key").alias("by_spouse"))
        two = self.child.select("tree_id", "family_id", F.col("id").alias("child_id"), F.col("t").alias("f2"), F.col("e").alias("u2"), "key", _origin("key").alias("by_child"))
        met = one.join(two, ["tree_id", "family_id"]).where("parent_id != child_id")
        starts, stops = [F.col("f1"), F.col("f2")], [F.col("u1"), F.col("u2")]
        for n, end in enumerate(("parent_id", "child_id")):  # people who exist at that time
            met = met.join(self.life.select("tree_id", F.col("id").alias(end), F.col("from_seq").alias(f"lf{n}"), F.col("to_seq").alias(f"lu{n}")), ["tree_id", end])
            starts, stops = [*starts, F.col(f"lf{n}")], [*stops, F.col(f"lu{n}")]
        held = met.withColumn("f", F.greatest(*starts)).withColumn("u", F.least(*stops)).where("f < u")
        return cut(held.select("tree_id", "parent_id", "child_id", "f", "u", "by_spouse", "by_child", "family_id", "key"))[0]

    def _ends(self, moves: DataFrame) -> DataFrame:
        """(tree_id, family_id, key, m, by_spouse, need): the merge at m ends this child's token, if the spouse token of that origin is
        there, and, where ``need`` is given, the child token of that key."""
        into = moves.select("tree_id", "id", F.col("merge_seq").alias("e"), "keep_id")
        moved = lambda spans: spans.join(into, ["tree_id", "id", "e"]).select("tree_id", "family_id", F.col("keep_id").alias("id"), F.col("e").alias("m"), "key")
        wed = moved(self.spouse).select("tree_id", "family_id", "id", "m", _origin("key").alias("by_spouse"), F.lit(None).cast("array<bigint>").alias("need"))
        there = self.spouse.select("tree_id", "family_id", "id", "t", "e", _origin("key").alias("by_spouse"))
        born = moved(self.child).join(there, ["tree_id", "family_id", "id"]).where("t <= m AND m < e").select(
            "tree_id", "family_id", "id", "m", "by_spouse", F.col("key").alias("need"))
        hit = self.child.select("tree_id", "family_id", "id", "t", "e", "key").join(wed.unionByName(born), ["tree_id", "family_id", "id"])
        return cut(hit.where("t <= m AND m < e").select(*_TOKEN, "m", "by_spouse", "need").distinct())[0]

    def end_of(self, links: DataFrame, ended: DataFrame | None) -> DataFrame:
        """(tree_id, family_id, key, end): where tokens end, if the given links stand and tokens end at ``ended``."""
        able = _standing(self.ends, links, "by_spouse")
        alone = able.where(F.col("need").isNull()).select(*_TOKEN, "m")
        other = _standing(able.where(F.col("need").isNotNull()).withColumn("by_child", _origin("need")), links, "by_child")
        if ended is not None:
            theirs = ended.select("tree_id", "family_id", F.col("key").alias("need"), F.col("end").alias("gone"))
            other = other.join(theirs, ["tree_id", "family_id", "need"], "left").where(F.col("gone").isNull() | (F.col("gone") >= F.col("m")))
        return cut(alone.unionByName(other.select(*_TOKEN, "m")).groupBy(*_TOKEN).agg(F.min("m").alias("end")))[0]

    def edges_with(self, links: DataFrame, ended: DataFrame | None) -> DataFrame:
        """(tree_id, parent_id, child_id, f, u) if the given links stand and tokens end at ``ended``."""
        held = _standing(_standing(self.edges, links, "by_spouse"), links, "by_child")
        if ended is not None:
            held = held.join(ended, _TOKEN, "left").withColumn("u", F.least("u", F.coalesce("end", F.lit(FAR)))).where("f < u")
        return cut(held.select("tree_id", "parent_id", "child_id", "f", "u"))[0]


def _standing(rows: DataFrame, links: DataFrame, origin: str) -> DataFrame:
    """Rows whose origin is the base or one of the links."""
    good = links.select("tree_id", F.col("seq").alias(origin), F.lit(True).alias("_ok"))
    return rows.join(good, ["tree_id", origin], "left").where(F.col("_ok") | (F.col(origin) == BASE)).drop("_ok")


def loops(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(tree_id, seq) of asked (tree_id, seq, a_id, b_id) whose a_id lies below b_id over edges that hold at ``seq``."""
    keys = [*_LINK, "node"]
    frontier = asked.select(*_LINK, F.col("b_id").alias("goal"), F.col("a_id").alias("node"))
    frontier, metrics = cut(frontier)
    seen, found = frontier, None
    while metrics["rows"]:
        level = frontier
        for _ in range(1 if metrics["rows"] > WIDE else 2):  # the first of two levels is made twice
            step = level.join(edges.withColumnRenamed("child_id", "node"), ["tree_id", "node"]).where((F.col("f") < F.col("seq")) & (F.col("seq") < F.col("u")))
            up = step.select(*_LINK, "goal", F.col("parent_id").alias("node")).distinct()
            level = up if level is frontier else level.unionByName(up).distinct()
        fresh, metrics = cut(level.join(seen.select(*keys), keys, "left_anti"))
        seen = seen.unionByName(fresh)
        hits = fresh.where("node = goal").select(*_LINK)
        found = hits if found is None else found.unionByName(hits)
        frontier = fresh.join(hits, _LINK, "left_anti")
    return cut(asked.select(*_LINK).where(F.lit(False)) if found is None else found.distinct())[0]


def refused_links(base: Tree, op: DataFrame) -> DataFrame:
    """(tree_id, seq, relation, a_id, b_id, to_self) of the link edits that are refused."""
    return _refused(Moments(base, op), op)


def _refused(moments: Moments, op: DataFrame) -> DataFrame:
    asked, _ = cut(proposals(op, moments.life))
    to_self = asked.where("a_id = b_id")
    every = kind(op, "linkRelationship").select(*_LINK).join(to_self.select(*_LINK), _LINK, "left_anti")
    checked = asked.where("a_id != b_id AND relation = 'parent-child'")
    free = every.join(checked.select(*_LINK), _LINK, "left_anti")  # nothing to check
    wide, _ = cut(every)
    wide_end: DataFrame | None = None
    undecided, metrics = cut(checked)
    lawful, _ = cut(free)
    refused: DataFrame | None = None
    while metrics["rows"]:
        narrow_end = moments.end_of(wide, wide_end)
        doubtful = loops(moments.edges_with(wide, wide_end), undecided)
        lawful, _ = cut(lawful.unionByName(undecided.select(*_LINK).join(doubtful, _LINK, "left_anti")))
        wide_end = moments.end_of(lawful, narrow_end)
        undecided = undecided.join(doubtful, _LINK, "left_semi")
        bad = loops(moments.edges_with(lawful, narrow_end), undecided)
        refused = bad if refused is None else refused.unionByName(bad)
        wide, _ = cut(wide.join(bad, _LINK, "left_anti"))
        undecided, metrics = cut(undecided.join(bad, _LINK, "left_anti"))
    out = to_self.withColumn("to_self", F.lit(True))
    return out if refused is None else out.unionByName(checked.join(refused, _LINK, "left_semi").withColumn("to_self", F.lit(False)))


def names_at(base: Tree, op: DataFrame, life: DataFrame, asked: DataFrame) -> DataFrame:
    """(tree_id, seq, id, name) for asked (tree_id, seq, id): the first name someone has at that moment, else the id.

    Names that a person without any got by a merge are not looked at.
    """
    at = existing_at(asked.distinct(), life)
    keys = ["tree_id", "id", "from_seq"]
    begun = base.person.select("tree_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("from_seq"), F.col("names").alias("first")).unionByName(
        kind(op, "addPerson").select("tree_id", F.col("person_id").alias("id"), F.col("seq").alias("from_seq"), parse_names(F.col("name_raws")).alias("first")))
    later = existing_at(kind(op, "editPerson").where(F.col("name_raws").isNotNull()).select("tree_id", F.col("person_id").alias("id"), "seq", "name_raws"), life)
    later = later.select(*keys, F.col("seq").alias("edit_seq"), "name_raws").join(at, keys).where("edit_seq < seq").groupBy(*keys, "seq").agg(
        F.max_by("name_raws", "edit_seq").alias("name_raws"))
    full = at.join(begun, keys, "left").join(later, [*keys, "seq"], "left")
    now = F.when(F.col("name_raws").isNotNull(), parse_names(F.col("name_raws"))).otherwise(F.col("first"))
    return full.select("tree_id", "seq", "id", F.coalesce(F.try_element_at(now, F.lit(1))["full"], F.col("id")).alias("name"))


def blocked_links(base: Tree, op: DataFrame) -> DataFrame:
    """(tree_id, seq, message) of refused links, with the names people have at that moment."""
    op, _ = cut(op)
    moments = Moments(base, op)
    bad, _ = cut(_refused(moments, op))
    life = moments.life
    who = bad.select(*_LINK, F.col("a_id").alias("id")).unionByName(bad.select(*_LINK, F.col("b_id").alias("id")))
    names, _ = cut(names_at(base, op, life, who))
    name = lambda end, alias: names.select(*_LINK, F.col("id").alias(end), F.col("name").alias(alias))
    full = bad.join(name("a_id", "a"), [*_LINK, "a_id"]).join(name("b_id", "b"), [*_LINK, "b_id"])
    # The wording of the refusals.
    message = (
        F.when(F.col("to_self") & (F.col("relation") == "spouse"), F.concat("a", F.lit(" cannot be married to themselves.")))
        .when(F.col("to_self"), F.concat("a", F.lit(" cannot be their own parent.")))
        .otherwise(F.concat("a", F.lit(" is already a descendant of "), "b", F.lit(", so this would make "), "b", F.lit(" their own ancestor.")))
    )
    return full.select(*_LINK, message.alias("message"))


def lawful_replay(base: Tree, op: DataFrame) -> Replay:
    """The log replayed without the links that are refused; who exists when does not depend on links."""
    moments = Moments(base, op)
    return Replay(base, without_op(op, _refused(moments, op)), moments.life)


def lawful_log(base: Tree, op: DataFrame) -> DataFrame:
    """The log without the links that are refused."""
    return without_op(op, refused_links(base, op))
