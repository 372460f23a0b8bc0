"""Replay of an edit log over base tables, as set operations.

``op(tree_id, seq, kind, ...)`` holds one row per edit; ``seq`` is a total order
per tree, base facts count as ``seq = -1``. An edit takes effect only when the
people it names exist at that moment, so the replay first settles who exists
when, and then resolves everything else against these life intervals:

1. ``lifecycles``: intervals per person id, closed by effective merges;
2. ``fold_paths``: for every interval the person it ended up in, with the list of
   merge moments on the way, which is also the order of merged facts;
3. memberships as tokens that end by an unlink or move on by a merge;
4. fields by last-writer aggregates.

Every step is a join or an aggregate on ``(tree_id, id)``. Loops run over the
depth of merge chains only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.dates import parse_date
from kinloom.functions.names import parse_names
from kinloom.functions.places import parse_place
from kinloom.operators.events import intern_places
from kinloom.operators.lineage import cut

FAR = 1 << 62

OP_SCHEMA = (
    "tree_id string, seq bigint, kind string, person_id string, keep_id string, merge_id string, "
    "name_raws array<string>, sex string, notes array<string>, event_id string, event_type string, raw_tag string, "
    "participant_ids array<string>, date_raw string, date_set boolean, place_raw string, place_set boolean, "
    "description string, description_set boolean, family_id string, relation string, parent_id string, "
    "child_id string, spouse_a string, spouse_b string"
)

# Tag of an event type when an edit gives none.
DEFAULT_TAGS = {
    "birth": "BIRT", "death": "DEAT", "marriage": "MARR", "burial": "BURI", "baptism": "BAPM",
    "census": "CENS", "residence": "RESI", "immigration": "IMMI", "emigration": "EMIG",
    "military": "MILI", "occupation": "OCCU", "other": "EVEN",
}

_ID = ["tree_id", "id"]


@dataclass
class Tree:
    """Tables an edit log works on.

    ``person(tree_id, person_id, names, sex, notes, sources, family_id_as_child)``,
    ``event(tree_id, event_id, seq, type, raw_tag, date, place, description)`` and
    the link tables of the graph and event operators.
    """

    person: DataFrame
    person_fams: DataFrame
    family: DataFrame
    family_spouse: DataFrame
    family_child: DataFrame
    event: DataFrame
    person_event: DataFrame
    family_event: DataFrame
    event_participant: DataFrame

    @property
    def event_ids(self) -> DataFrame:
        return self.event.select("tree_id", "event_id")


def kind(op: DataFrame, name: str) -> DataFrame:
    return op.where(F.col("kind") == name)


def without_op(op: DataFrame, undone: DataFrame) -> DataFrame:
    """The log without some edits (undo): ``undone(tree_id, seq)``."""
    return op.join(undone.select("tree_id", "seq"), ["tree_id", "seq"], "left_anti")


def up_to(op: DataFrame, seq: int) -> DataFrame:
    """The log up to a moment."""
    return op.where(F.col("seq") <= seq)


def lifecycles(person: DataFrame, op: DataFrame) -> DataFrame:
    """(tree_id, id, from_seq, to_seq, into_id): when each person id exists.

    ``to_seq`` is FAR for people that still exist. A merge counts when both ids
    exist at its moment. Each round decides every merge not preceded by another
    undecided merge of the same people; the earliest one is always decided. It looks
    only at the people whom undecided merges name; the others are settled.
    """
    adds, _ = cut(
        person.select("tree_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("seq")).unionByName(
            kind(op, "addPerson").select("tree_id", F.col("person_id").alias("id"), "seq")
        )
    )
    merges = kind(op, "merge").where(F.col("keep_id") != F.col("merge_id")).select(
        "tree_id", "seq", "keep_id", "merge_id"
    )
    todo, metrics = cut(merges)
    later = adds.where("seq >= 0")
    alive = adds.groupBy(*_ID).agg(F.min("seq").alias("from_seq"))
    closed: DataFrame | None = None
    settled: list[DataFrame] = []
    while metrics["rows"]:
        asked = todo.select("tree_id", F.col("keep_id").alias("id")).unionByName(
            todo.select("tree_id", F.col("merge_id").alias("id"))
        ).distinct().withColumn("_asked", F.lit(True))
        alive, _ = cut(alive.join(asked, _ID, "left"))
        settled.append(alive.where(F.col("_asked").isNull()).drop("_asked"))
        alive = alive.where("_asked").drop("_asked")
        doomed = todo.withColumnRenamed("merge_id", "id").join(alive, _ID).where(
            F.col("seq") > F.col("from_seq")
        ).groupBy(*_ID).agg(F.min("seq").alias("first_end"))
        state, _ = cut(alive.join(doomed, _ID, "left").withColumn("first_end", F.coalesce("first_end", F.lit(FAR))))
        named = todo
        for end in ("keep_id", "merge_id"):
            look = state.select(
                "tree_id", F.col("id").alias(end), F.col("from_seq").alias("f"), F.col("first_end").alias("e")
            )
            named = named.join(look, ["tree_id", end], "left").withColumn(
                f"{end}_is",
                F.when(F.col("f").isNull() | (F.col("f") > F.col("seq")), "dead")
                .when(F.col("e") < F.col("seq"), "open").otherwise("alive"),
            ).drop("f", "e")
            if closed is not None:
                past = closed.select(
                    "tree_id", F.col("id").alias(end), F.col("from_seq").alias("f"), F.col("to_seq").alias("t")
                )
                was = todo.join(past, ["tree_id", end]).where(
                    (F.col("f") < F.col("seq")) & (F.col("seq") < F.col("t"))
                ).select("tree_id", "seq", F.lit(True).alias("was"))
                named = named.join(was, ["tree_id", "seq"], "left").withColumn(
                    f"{end}_is", F.when(F.col("was"), "alive").otherwise(F.col(f"{end}_is"))
                ).drop("was")
        named, _ = cut(named)
        dead = (F.col("keep_id_is") == "dead") | (F.col("merge_id_is") == "dead")
        both = (F.col("keep_id_is") == "alive") & (F.col("merge_id_is") == "alive")
        ended, _ = cut(
            named.where(both).select(
                "tree_id", F.col("merge_id").alias("id"), F.col("seq").alias("to_seq"), F.col("keep_id").alias("into_id")
            ).join(state.select(*_ID, "from_seq"), _ID)
        )
        closed = ended if closed is None else closed.unionByName(ended)
        again = ended.join(later, _ID).where(F.col("seq") > F.col("to_seq")).groupBy(*_ID).agg(
            F.min("seq").alias("from_seq")
        )
        alive = state.select(*_ID, "from_seq").join(ended.select(*_ID), _ID, "left_anti").unionByName(again)
        todo, metrics = cut(named.where(~dead & ~both).select("tree_id", "seq", "keep_id", "merge_id"))
    living = reduce(DataFrame.unionByName, settled, alive).select(
        *_ID, "from_seq", F.lit(FAR).cast("bigint").alias("to_seq"), F.lit(None).cast("string").alias("into_id")
    )
    return cut(living if closed is None else living.unionByName(closed.select(*living.columns)))[0]


def existing_at(refs: DataFrame, life: DataFrame) -> DataFrame:
    """Keep references ``(tree_id, id, seq, ...)`` to people existing then; adds from_seq."""
    return refs.join(life.select(*_ID, "from_seq", "to_seq"), _ID).where(
        (F.col("from_seq") < F.col("seq")) & (F.col("seq") < F.col("to_seq"))
    ).drop("to_seq")


def fold_paths(life: DataFrame, edited: DataFrame) -> DataFrame:
    """Where every life interval ended up.

    (tree_id, id, from_seq, root_id, path, names_ok, sex_ok, notes_ok); ``path``
    lists merge moments from the surviving person down. A field of a merged person
    still counts when no receiver on the way was edited afterwards.
    ``edited(tree_id, id, from_seq, names_at, sex_at, notes_at)``.
    """
    keys = [*_ID, "from_seq"]
    full, _ = cut(life.join(edited, keys, "left"))
    none = F.array().cast("array<bigint>")
    roots = full.where(F.col("to_seq") == FAR).select(
        *keys, F.col("id").alias("root_id"), none.alias("path"),
        *[F.lit(True).alias(f"{n}_ok") for n in ("names", "sex", "notes")], "names_at", "sex_at", "notes_at",
    )
    merged = full.where(F.col("to_seq") < FAR).select(
        *keys, "to_seq", "into_id", "names_at", "sex_at", "notes_at"
    )
    merged, metrics = cut(merged)
    out, frontier = roots, roots
    while metrics["rows"]:
        above = frontier.select(
            "tree_id", F.col("id").alias("into_id"), F.col("from_seq").alias("up_from"), "root_id", "path",
            *[F.col(f"{n}_ok").alias(f"up_{n}_ok") for n in ("names", "sex", "notes")],
            *[F.col(f"{n}_at").alias(f"up_{n}_at") for n in ("names", "sex", "notes")],
        )
        # The receiver's interval is the one that holds the merge moment.
        receivers = full.select(
            "tree_id", F.col("id").alias("into_id"), F.col("from_seq").alias("up_from"), F.col("to_seq").alias("up_to")
        )
        held = merged.join(receivers, ["tree_id", "into_id"]).where(
            (F.col("up_from") < F.col("to_seq")) & (F.col("to_seq") < F.col("up_to"))
        )
        ok = lambda n: (
            F.col(f"up_{n}_ok") & (F.coalesce(f"up_{n}_at", F.lit(-1)) < F.col("to_seq"))
        ).alias(f"{n}_ok")
        frontier, metrics = cut(
            held.join(above, ["tree_id", "into_id", "up_from"]).select(
                *keys, "root_id", F.concat("path", F.array("to_seq")).alias("path"),
                *[ok(n) for n in ("names", "sex", "notes")], "names_at", "sex_at", "notes_at",
            )
        )
        out = out.unionByName(frontier)
    return cut(out.drop("names_at", "sex_at", "notes_at"))[0]


def survivors(merges: DataFrame, alive: DataFrame, ids: DataFrame) -> DataFrame:
    """Follow merges from each id to an existing one; null when the chain ends or loops.

    ``merges(tree_id, seq, keep_id, merge_id)``: the last merge of an id counts.
    ``alive(tree_id, person_id)``, ``ids(tree_id, id)``.
    """
    link, _ = cut(
        merges.groupBy("tree_id", F.col("merge_id").alias("at")).agg(F.max_by("keep_id", "seq").alias("next"))
    )
    here = alive.select("tree_id", F.col("person_id").alias("at"), F.lit(True).alias("ok"))
    frontier, metrics = cut(ids.select(*_ID).distinct().select(*_ID, F.col("id").alias("at"), F.array("id").alias("seen")))
    done: DataFrame | None = None
    while metrics["rows"]:
        looked = frontier.join(here, ["tree_id", "at"], "left").join(link, ["tree_id", "at"], "left")
        stop = F.col("ok") | F.col("next").isNull() | F.array_contains("seen", F.col("next"))
        looked, _ = cut(looked.withColumn("stop", F.coalesce(stop, F.lit(False))))
        ended = looked.where("stop").select(*_ID, F.when(F.col("ok"), F.col("at")).alias("survivor_id"))
        done = ended if done is None else done.unionByName(ended)
        frontier, metrics = cut(
            looked.where("not stop").select(
                *_ID, F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen")
            )
        )
    return done


def _moves(life: DataFrame) -> DataFrame:
    """Effective merges: (tree_id, id, merge_seq, keep_id)."""
    return life.where(F.col("to_seq") < FAR).select(
        *_ID, F.col("to_seq").alias("merge_seq"), F.col("into_id").alias("keep_id")
    )


def follow_tokens(
    tokens: DataFrame, removals: DataFrame, moves: DataFrame, prefix_key: bool, clears: DataFrame | None = None
) -> DataFrame:
    """Presence intervals of memberships.

    ``tokens(tree_id, family_id, id, t, key)``; ``removals(tree_id, family_id, id,
    seq)`` end tokens older than them, ``clears`` also those of the same moment.
    A merge of the person moves the token on, with its key or, when
    ``prefix_key``, with the merge moment put in front.
    """
    where = ["tree_id", "family_id", "id"]
    numbered = lambda df: cut(df.withColumn("_n", F.monotonically_increasing_id()))
    cur, metrics = numbered(tokens)
    done: DataFrame | None = None
    while metrics["rows"]:
        ends = cur.select(*where, "_n", "t").join(removals, where).where(F.col("seq") > F.col("t")).select("_n", "seq")
        if clears is not None:
            ends = ends.unionByName(
                cur.select(*where, "_n", "t").join(clears, where).where(F.col("seq") >= F.col("t")).select("_n", "seq")
            )
        ends = ends.groupBy("_n").agg(F.min("seq").alias("removed"))
        moved = cur.select("tree_id", "id", "_n", "t").join(moves, _ID).where(
            F.col("merge_seq") > F.col("t")
        ).groupBy("_n").agg(F.min(F.struct("merge_seq", "keep_id")).alias("m"))
        full, _ = cut(cur.join(ends, "_n", "left").join(moved, "_n", "left").drop("_n"))
        removed = F.coalesce("removed", F.lit(FAR))
        merge_at = F.coalesce("m.merge_seq", F.lit(FAR))
        spans = full.select(*where, "t", F.least(removed, merge_at).alias("e"), "key")
        done = spans if done is None else done.unionByName(spans)
        key = F.concat(F.array("m.merge_seq"), "key") if prefix_key else F.col("key")
        cur, metrics = numbered(
            full.where((merge_at < FAR) & (merge_at < removed)).select(
                "tree_id", "family_id", F.col("m.keep_id").alias("id"), F.col("m.merge_seq").alias("t"), key.alias("key")
            )
        )
    # An interval that was cleared at its own first moment never existed.
    return tokens.select(*where, "t", F.lit(FAR).alias("e"), "key") if done is None else cut(done.where(F.col("e") > F.col("t")))[0]


def _present(spans: DataFrame) -> DataFrame:
    """Memberships that still hold: (tree_id, family_id, id, key)."""
    return spans.where(F.col("e") == FAR).groupBy("tree_id", "family_id", "id").agg(F.min("key").alias("key"))


def _unlinks(op: DataFrame, born: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """(tree_id, family_id, id, seq) removals of existing families; columns by relation."""
    ops = kind(op, "unlinkRelationship").join(born, ["tree_id", "family_id"]).where(F.col("seq") > F.col("born_seq"))
    parts = [
        ops.where(F.col("relation") == rel).select("tree_id", "family_id", F.col(c).alias("id"), "seq")
        for rel, cols in columns.items() for c in cols
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("id").isNotNull())


def _if_there(df: DataFrame, column: str, other):
    return F.coalesce(F.col(column), other) if column in df.columns else other


def _key(*parts):
    return F.array(*[p.cast("bigint") if hasattr(p, "cast") else F.lit(p).cast("bigint") for p in parts])


def _link_people(op: DataFrame, life: DataFrame) -> DataFrame:
    """People named by link edits and existing then: (tree_id, family_id, id, seq, role, at)."""
    ops = kind(op, "linkRelationship")
    pick = lambda rel, col, role, at: ops.where(F.col("relation") == rel).select(
        "tree_id", "family_id", F.col(col).alias("id"), "seq", F.lit(role).alias("role"), F.lit(at).alias("at")
    )
    named = (
        pick("parent-child", "parent_id", "spouse", 0).unionByName(pick("parent-child", "child_id", "child", 0))
        .unionByName(pick("spouse", "spouse_a", "spouse", 0)).unionByName(pick("spouse", "spouse_b", "spouse", 1))
    )
    return cut(existing_at(named, life))[0]


def _famc(base: Tree, links: DataFrame, unlinked: DataFrame, life: DataFrame, folds: DataFrame, spouse_spans: DataFrame) -> DataFrame:
    """Child-family pointer of every surviving person: (tree_id, id, family_id).

    Intervals are settled from the deepest merged ones up. The last set counts;
    afterwards a pointer is lost by an unlink or when the person becomes a spouse
    of that family at a merge, and an empty pointer takes the merged person's.
    """
    keys = [*_ID, "from_seq"]
    sets = base.person.where(F.col("family_id_as_child").isNotNull()).select(
        "tree_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("from_seq"),
        F.lit(-1).cast("bigint").alias("seq"), F.col("family_id_as_child").alias("family_id"),
    ).unionByName(links.where("role = 'child'").select(*keys, "seq", "family_id"))
    last = sets.groupBy(*keys).agg(F.max(F.struct("seq", "family_id")).alias("s"))
    state, _ = cut(
        life.join(folds.select(*keys, F.size("path").alias("depth")), keys).join(last, keys, "left").select(
            *keys, "to_seq", "into_id", "depth", F.coalesce("s.seq", "from_seq").alias("at"),
            F.col("s.family_id").alias("value"),
        ),
    )
    deepest = state.agg(F.max("depth")).first()[0] or 0
    offers: DataFrame | None = None
    out: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        todo, metrics = cut(state.where(F.col("depth") == depth))
        settled: DataFrame | None = None
        while metrics["rows"]:
            lost = todo.select(*keys, "at", "to_seq", F.col("value").alias("family_id")).join(
                unlinked, ["tree_id", "family_id", "id"]
            ).where((F.col("seq") > F.col("at")) & (F.col("seq") < F.col("to_seq"))).select(
                *keys, "seq", F.lit(None).cast("string").alias("new")
            )
            change = lost
            if offers is not None:
                own = spouse_spans.select("tree_id", "family_id", "id", F.col("t").alias("st"), F.col("e").alias("se"))
                into = offers.join(todo.select(*keys, "at", "to_seq", "value"), _ID).where(
                    (F.col("seq") > F.col("at")) & (F.col("seq") < F.col("to_seq"))
                )
                become = into.where(F.col("value").isNotNull()).withColumn("family_id", F.col("value"))
                become = become.join(own, ["tree_id", "family_id", "id"]).where(
                    (F.col("st") <= F.col("seq")) & (F.col("seq") < F.col("se"))
                ).select(*keys, "seq", F.lit(None).cast("string").alias("new"))
                take = into.where(F.col("value").isNull() & F.col("offer").isNotNull()).withColumn("family_id", F.col("offer"))
                barred = take.join(own, ["tree_id", "family_id", "id"]).where(
                    (F.col("st") <= F.col("seq")) & (F.col("seq") < F.col("se"))
                ).select(*keys, "seq")
                take = take.join(barred, [*keys, "seq"], "left_anti").select(*keys, "seq", F.col("offer").alias("new"))
                change = change.unionByName(become).unionByName(take)
            nxt = change.groupBy(*keys).agg(F.min(F.struct("seq", "new")).alias("c"))
            looked, _ = cut(todo.join(nxt, keys, "left"))
            still = looked.where(F.col("c").isNull()).drop("c")
            settled = still if settled is None else settled.unionByName(still)
            todo, metrics = cut(
                looked.where(F.col("c").isNotNull()).withColumn("at", F.col("c.seq")).withColumn("value", F.col("c.new"))
                .drop("c")
            )
        if settled is None:
            continue
        settled, _ = cut(settled)
        out = settled if out is None else out.unionByName(settled)
        given = settled.where(F.col("to_seq") < FAR).select(
            "tree_id", F.col("into_id").alias("id"), F.col("to_seq").alias("seq"), F.col("value").alias("offer")
        )
        offers = given if offers is None else offers.unionByName(given)
    return out.where((F.col("to_seq") == FAR) & F.col("value").isNotNull()).select(
        *_ID, F.col("value").alias("family_id")
    )


class Replay:
    """Parts of a replay, each computed once when first asked for."""

    def __init__(self, base: Tree, op: DataFrame, life: DataFrame | None = None) -> None:
        """``life``: the lifecycles, where they are known from a log with the same people and merges."""
        self.base = base
        self.op = cut(op)[0]
        if life is not None:
            self.life = life

    @cached_property
    def life(self) -> DataFrame:
        return lifecycles(self.base.person, self.op)

    @cached_property
    def _merges(self) -> tuple[DataFrame, dict]:
        return cut(_moves(self.life))

    @property
    def moves(self) -> DataFrame:
        return self._merges[0]

    @cached_property
    def edited(self) -> DataFrame:
        """Last edit of each field inside each life interval."""
        edits = existing_at(
            kind(self.op, "editPerson").select(
                "tree_id", F.col("person_id").alias("id"), "seq", "name_raws", "sex", "notes"
            ), self.life,
        )
        last = lambda c, n: [
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"{n}_new"),
            F.max(F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"{n}_at"),
        ]
        return cut(
            edits.groupBy(*_ID, "from_seq").agg(
                *last("name_raws", "names"), *last("sex", "sex"), *last("notes", "notes"), F.lit(True).alias("touched")
            )
        )[0]

    @cached_property
    def folds(self) -> DataFrame:
        return fold_paths(self.life, self.edited.select(*_ID, "from_seq", "names_at", "sex_at", "notes_at"))

    @cached_property
    def people(self) -> DataFrame:
        """Surviving people with folded fields, without the child-family pointer."""
        return cut(_fold_people(self.base, self.op, self.life, self.edited, self.folds))[0]

    @cached_property
    def links(self) -> DataFrame:
        return _link_people(self.op, self.life)

    @cached_property
    def born(self) -> DataFrame:
        """(tree_id, family_id, born_seq) of base families and of those made by a link."""
        made = self.links.groupBy("tree_id", "family_id").agg(F.min("seq").alias("born_seq"))
        known = self.base.family.select("tree_id", "family_id")
        return cut(
            known.withColumn("born_seq", F.lit(-1).cast("bigint")).unionByName(
                made.join(known, ["tree_id", "family_id"], "left_anti")
            )
        )[0]

    @cached_property
    def family(self) -> DataFrame:
        return self.base.family.select("tree_id", "family_id", "seq").unionByName(
            self.born.where("born_seq >= 0").select(
                "tree_id", "family_id", ((1 << 50) + F.col("born_seq")).alias("seq")
            )
        )

    @cached_property
    def _spouse_gone(self) -> DataFrame:
        return cut(_unlinks(self.op, self.born, {"parent-child": ["parent_id"], "spouse": ["spouse_a", "spouse_b"]}))[0]

    @cached_property
    def _child_gone(self) -> DataFrame:
        return cut(_unlinks(self.op, self.born, {"parent-child": ["child_id"]}))[0]

    def _tokens(self, links: DataFrame, role: str) -> DataFrame:
        start = links.select(
            "tree_id", "family_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("t"),
            _key(-1, F.col("ord")).alias("key"),
        )
        return start.unionByName(
            self.links.where(F.col("role") == role).select(
                "tree_id", "family_id", "id", F.col("seq").alias("t"), _key(F.col("seq"), F.col("at")).alias("key")
            )
        )

    @cached_property
    def spouse_spans(self) -> DataFrame:
        return follow_tokens(self._tokens(self.base.family_spouse, "spouse"), self._spouse_gone, self.moves, False)

    @cached_property
    def child_spans(self) -> DataFrame:
        tokens = self._tokens(self.base.family_child, "child")
        return _child_spans(tokens, self._child_gone, self.moves, self.spouse_spans, self._merges[1]["rows"])

    @cached_property
    def fams(self) -> DataFrame:
        """Spouse families on the record of each surviving person."""
        spans = follow_tokens(self._tokens(self.base.person_fams, "spouse"), self._spouse_gone, self.moves, True)
        alive = self.life.where(F.col("to_seq") == FAR).select("tree_id", F.col("id").alias("person_id"))
        return _members(spans).join(alive, ["tree_id", "person_id"], "left_semi")

    @cached_property
    def famc(self) -> DataFrame:
        return _famc(self.base, self.links, self._child_gone, self.life, self.folds, self.spouse_spans)

    @cached_property
    def events(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """event, person_event, family_event, event_participant."""
        return self.event, self.person_event, self.family_event, self.event_participant

    @cached_property
    def added(self) -> DataFrame:
        return _added_events(self.base, self.op)

    @cached_property
    def named(self) -> DataFrame:
        """People named by added events who exist then."""
        people = self.added.select("tree_id", "event_id", "seq", "family_id", F.posexplode("participant_ids").alias("at", "id"))
        return cut(existing_at(people, self.life))[0]

    @cached_property
    def event(self) -> DataFrame:
        return _replay_events(self.base, self.op, self.added)

    @cached_property
    def person_event(self) -> DataFrame:
        """Events on people's records; asks for no parsed event."""
        return _listed_events(self.base, self.named, self.folds)

    @cached_property
    def family_event(self) -> DataFrame:
        return _family_events(self.base, self.added, self.born)

    @cached_property
    def event_participant(self) -> DataFrame:
        return _participants(self.base, self.named, self.moves)


def _members(spans: DataFrame) -> DataFrame:
    return _present(spans).select("tree_id", "family_id", F.col("id").alias("person_id"), F.col("key").alias("ord"))


def replay(base: Tree, op: DataFrame) -> Tree:
    """Tables after applying the whole log."""
    run = Replay(base, op)
    pointer = run.famc.select(
        "tree_id", F.col("id").alias("person_id"), F.col("family_id").alias("family_id_as_child")
    )
    event, person_event, family_event, participant = run.events
    return Tree(
        cut(run.people.join(pointer, ["tree_id", "person_id"], "left"))[0], run.fams, run.family,
        _members(run.spouse_spans), _members(run.child_spans), event, person_event, family_event, participant,
    )


def as_list(links: DataFrame, owner: str, member: str) -> DataFrame:
    """(tree_id, owner, member, ord): the members of each owner, numbered from 0 in their order."""
    order = Window.partitionBy("tree_id", owner).orderBy("ord", member)
    return links.select("tree_id", owner, member, (F.row_number().over(order) - 1).cast("int").alias("ord"))


def as_base(tree: Tree) -> Tree:
    """A tree as the start of further edits: the same tables in one layout, whether they were read or are the outcome of a replay.

    Edits on top of it lead to what one replay of all edits leads to, if they come after the earlier ones.
    """
    no_text, p, e = F.array().cast("array<string>"), tree.person, tree.event
    person = p.select(
        "tree_id", "person_id", "names", "sex", "notes", "sources", "family_id_as_child",
        _if_there(p, "user_supplied", F.lit(False)).alias("user_supplied"), _if_there(p, "merged_from_ids", no_text).alias("merged_from_ids"))
    event = e.select(
        "tree_id", "event_id", F.col("seq").cast("bigint").alias("seq"), "type", "raw_tag", "date",
        _if_there(e, "own_place", F.col("place")).alias("place"), "description", _if_there(e, "user_supplied", F.lit(False)).alias("user_supplied"))
    return Tree(
        person, as_list(tree.person_fams, "person_id", "family_id"),
        tree.family.select("tree_id", "family_id", F.col("seq").cast("bigint").alias("seq")),
        as_list(tree.family_spouse, "family_id", "person_id"), as_list(tree.family_child, "family_id", "person_id"), event,
        as_list(tree.person_event, "person_id", "event_id"), as_list(tree.family_event, "family_id", "event_id"),
        tree.event_participant.select("tree_id", "event_id", "person_id", F.col("pord").cast("int").alias("pord")))


def _child_spans(tokens, gone, moves, spouse_spans, merges: int) -> DataFrame:
    """Child memberships; nobody stays a child of a family where a merge made them a parent."""
    if not merges:
        return follow_tokens(tokens, gone, moves, prefix_key=False)
    key = ["tree_id", "family_id", "id", "seq"]
    ended = lambda spans: spans.select("tree_id", "family_id", "id", F.col("e").alias("merge_seq")).join(
        moves, ["tree_id", "id", "merge_seq"]
    ).select("tree_id", "family_id", F.col("keep_id").alias("id"), F.col("merge_seq").alias("seq")).distinct()
    certain, _ = cut(ended(spouse_spans))
    wed = spouse_spans.select("tree_id", "family_id", "id", F.col("t").alias("st"), F.col("e").alias("se"))
    clears = certain
    while True:
        spans = follow_tokens(tokens, gone, moves, prefix_key=False, clears=clears)
        met = ended(spans).join(wed, ["tree_id", "family_id", "id"]).where(
            (F.col("st") <= F.col("seq")) & (F.col("seq") < F.col("se"))
        ).select(*key)
        found, _ = cut(certain.unionByName(met).distinct())
        fresh = found.join(clears, key, "left_anti").unionByName(clears.join(found, key, "left_anti"))
        if fresh.isEmpty():
            return spans
        clears = found


def _fold_people(base: Tree, op: DataFrame, life: DataFrame, edited: DataFrame, folds: DataFrame) -> DataFrame:
    """Fields of the surviving people, merged facts after their own."""
    keys = [*_ID, "from_seq"]
    no_text, no_source = F.array().cast("array<string>"), "array<struct<raw:string,source_id:string,page:string>>"
    first = base.person.select(
        "tree_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("from_seq"), "names", "sex",
        F.coalesce("notes", no_text).alias("notes"), "sources", _if_there(base.person, "user_supplied", F.lit(False)).alias("added"),
        _if_there(base.person, "merged_from_ids", no_text).alias("had"),
    ).unionByName(
        kind(op, "addPerson").select(
            "tree_id", F.col("person_id").alias("id"), F.col("seq").alias("from_seq"),
            parse_names(F.col("name_raws")).alias("names"), "sex", F.coalesce("notes", no_text).alias("notes"),
            F.array().cast(no_source).alias("sources"), F.lit(True).alias("added"), no_text.alias("had"),
        )
    )
    now = F.when(F.col("names_new").isNotNull(), parse_names(F.col("names_new"))).otherwise(F.col("names"))
    facts, _ = cut(
        folds.join(first, keys).join(edited, keys, "left").select(
            "tree_id", "id", "root_id", "path", "had", "names_ok", "sex_ok", "notes_ok", now.alias("names"),
            F.coalesce("sex_new", "sex").alias("sex"), F.coalesce("notes_new", "notes").alias("notes"), "sources",
            (F.col("added") | F.coalesce("touched", F.lit(False))).alias("user_supplied"),
        )
    )
    own = facts.where(F.size("path") == 0)
    root = ["tree_id", "root_id"]
    label = lambda n: F.when(n["full"] != "", n["full"]).otherwise(n["raw"])
    seen = own.select(*root, F.explode("names").alias("n")).select(*root, label(F.col("n")).alias("k")).distinct()
    more = facts.where((F.size("path") > 0) & F.col("names_ok")).select(
        *root, "path", F.posexplode("names").alias("pos", "n")
    ).withColumn("k", label(F.col("n")))
    more = more.join(seen, [*root, "k"], "left_anti").groupBy(*root, "k").agg(
        F.min_by("n", F.struct("path", "pos")).alias("n"), F.min(F.struct("path", "pos")).alias("o")
    )
    extra = lambda df, value: F.transform(F.sort_array(F.collect_list(F.struct("o", value))), lambda x: x[value])
    added_names = more.groupBy(*root).agg(
        F.transform(extra(more, "n"), lambda n: n.withField("is_primary", F.lit(False))).alias("more_names")
    )
    sex = facts.where(F.col("sex_ok") & (F.col("sex") != "unknown")).groupBy(*root).agg(
        F.min_by("sex", "path").alias("known_sex")
    )

    def union_of(value: str, ok) -> DataFrame:
        rows = facts.where(ok).select(*root, "path", F.posexplode(value).alias("pos", "v"))
        firsts = rows.groupBy(*root, "v").agg(F.min(F.struct("path", "pos")).alias("o"))
        return firsts.groupBy(*root).agg(extra(firsts, "v").alias(f"all_{value}"))

    folded = facts.where(F.size("path") > 0)
    has_notes = folded.groupBy(*root).agg(F.bool_or("notes_ok").alias("notes_folded"), F.lit(True).alias("folded"))
    gone = folded.select(*root, "path", F.lit(-1).alias("pos"), "id").unionByName(
        facts.select(*root, "path", F.posexplode("had").alias("pos", "id")))
    gone = gone.groupBy(*root, "id").agg(F.min(F.struct("path", "pos")).alias("o"))
    gone = gone.groupBy(*root).agg(extra(gone, "id").alias("merged_from_ids"))
    out = own.select(*root, "names", "notes", "sources", "user_supplied")
    for part in (added_names, sex, union_of("notes", F.col("notes_ok")), union_of("sources", F.lit(True)), has_notes, gone):
        out = out.join(part, root, "left")
    names = F.when(F.col("more_names").isNull(), F.col("names")).otherwise(F.concat("names", "more_names"))
    notes = F.when(F.col("notes_folded"), F.coalesce("all_notes", no_text)).otherwise(F.col("notes"))
    sources = F.when(F.col("folded"), F.coalesce("all_sources", F.array().cast(no_source)))
    return out.select(
        "tree_id", F.col("root_id").alias("person_id"), names.alias("names"),
        F.coalesce("known_sex", F.lit("unknown")).alias("sex"), notes.alias("notes"),
        sources.otherwise(F.col("sources")).alias("sources"), "user_supplied",
        F.coalesce("merged_from_ids", no_text).alias("merged_from_ids"),
    )


_EVENT = ["tree_id", "event_id"]


def _added_events(base: Tree, op: DataFrame) -> DataFrame:
    """The first addEvent of each new event."""
    return cut(
        kind(op, "addEvent").join(base.event_ids, _EVENT, "left_anti").groupBy(*_EVENT).agg(
            F.min_by(F.struct("seq", "event_type", "raw_tag", "participant_ids", "date_raw", "place_raw", "description",
                              "family_id"), "seq").alias("a")
        ).select(*_EVENT, "a.*")
    )[0]


def _replay_events(base: Tree, op: DataFrame, adds: DataFrame) -> DataFrame:
    ev = _EVENT
    cols = ["type", "raw_tag", "date", "place", "description"]
    tags = F.create_map(*[F.lit(x) for kv in DEFAULT_TAGS.items() for x in kv])
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    made = adds.select(
        *ev, F.col("seq").alias("born_seq"), F.col("event_type").alias("type"),
        F.coalesce("raw_tag", F.try_element_at(tags, F.col("event_type"))).alias("raw_tag"),
        parse_date(text("date_raw")).alias("date"), parse_place(text("place_raw")).alias("place"),
        text("description").alias("description"), F.lit(True).alias("user_supplied"),
    )
    first = base.event.withColumn("place", _if_there(base.event, "own_place", F.col("place"))).select(
        *ev, F.lit(-1).cast("bigint").alias("born_seq"), *cols, _if_there(base.event, "user_supplied", F.lit(False)).alias("user_supplied"))
    every, _ = cut(first.unionByName(made))
    edits = kind(op, "editEvent").join(every.select(*ev, "born_seq"), ev).where(F.col("seq") > F.col("born_seq"))
    newest = lambda value, on: F.max_by(value, F.when(on, F.col("seq")))
    last = edits.groupBy(*ev).agg(
        newest("event_type", F.col("event_type").isNotNull()).alias("new_type"),
        newest(F.struct("date_raw"), F.col("date_set")).alias("new_date"),
        newest(F.struct("place_raw"), F.col("place_set")).alias("new_place"),
        newest(F.struct("description"), F.col("description_set")).alias("new_text"), F.lit(True).alias("edited"),
    )
    now = every.join(last, ev, "left")
    patched = now.select(
        *ev, "born_seq", F.coalesce("new_type", "type").alias("type"),
        F.coalesce(F.try_element_at(tags, F.col("new_type")), F.col("raw_tag")).alias("raw_tag"),
        F.when(F.col("new_date").isNotNull(), parse_date(F.col("new_date.date_raw"))).otherwise(F.col("date")).alias("date"),
        F.when(F.col("new_place").isNotNull(), parse_place(F.col("new_place.place_raw"))).otherwise(F.col("place")).alias("place"),
        F.when(F.col("new_text").isNotNull(), F.col("new_text.description")).otherwise(F.col("description")).alias("description"),
        (F.col("user_supplied") | F.coalesce("edited", F.lit(False))).alias("user_supplied"),
    )
    # Spelling of a place: base spellings first, then edits in order.
    seq = base.event.select(*ev, "seq")
    patched = patched.join(seq, ev, "left").withColumn("seq", F.coalesce("seq", F.lit(1 << 60) + F.col("born_seq")))
    return cut(intern_places(cut(patched.withColumn("own_place", F.col("place")))[0]))[0]


def _listed_events(base: Tree, real: DataFrame, folds: DataFrame) -> DataFrame:
    """Events on people's records."""
    own = base.person_event.select(
        "tree_id", F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("from_seq"), "event_id",
        _key(-1, F.col("ord")).alias("k"),
    )
    fresh = real.where(F.col("family_id").isNull() | (F.col("family_id") == "")).select(
        "tree_id", "id", "from_seq", "event_id", _key(F.col("seq"), 0).alias("k")
    )
    listed = own.unionByName(fresh).join(folds.select(*_ID, "from_seq", "root_id", "path"), [*_ID, "from_seq"])
    return listed.groupBy("tree_id", F.col("root_id").alias("person_id"), "event_id").agg(
        F.min(F.concat("path", "k")).alias("ord")
    )


def _family_events(base: Tree, adds: DataFrame, born: DataFrame) -> DataFrame:
    return base.family_event.select("tree_id", "family_id", "event_id", _key(-1, F.col("ord")).alias("ord")).unionByName(
        adds.join(born, ["tree_id", "family_id"]).where(F.col("seq") > F.col("born_seq")).select(
            "tree_id", "family_id", "event_id", _key(F.col("seq"), 0).alias("ord")
        )
    )


def _participants(base: Tree, real: DataFrame, moves: DataFrame) -> DataFrame:
    """Participants follow the first merge of their id after they were named."""
    ev = _EVENT
    at = base.event_participant.select(
        *ev, F.col("person_id").alias("id"), F.lit(-1).cast("bigint").alias("t"), F.col("pord").cast("int").alias("pord")
    ).unionByName(real.select(*ev, "id", F.col("seq").alias("t"), F.col("at").cast("int").alias("pord")))
    at, metrics = cut(at)
    final: DataFrame | None = None
    while metrics["rows"]:
        nxt = at.join(moves, _ID).where(F.col("merge_seq") > F.col("t")).groupBy(*ev, "id", "t", "pord").agg(
            F.min(F.struct("merge_seq", "keep_id")).alias("m")
        )
        looked, _ = cut(at.join(nxt, [*ev, "id", "t", "pord"], "left"))
        stay = looked.where(F.col("m.merge_seq").isNull()).select(*ev, "id", "pord")
        final = stay if final is None else final.unionByName(stay)
        at, metrics = cut(
            looked.where(F.col("m.merge_seq").isNotNull()).select(
                *ev, F.col("m.keep_id").alias("id"), F.col("m.merge_seq").alias("t"), "pord"
            )
        )
    return (final if final is not None else at.select(*ev, "id", "pord")).groupBy(
        *ev, F.col("id").alias("person_id")
    ).agg(F.min("pord").alias("pord"))


def merge_only(base: Tree, op: DataFrame) -> Tree:
    return replay(base, kind(op, "merge"))


def describe_ops(op: DataFrame, names: DataFrame) -> DataFrame:
    """History line of every edit: (tree_id, seq, text)."""
    nm = lambda who, alias: names.select("tree_id", F.col("person_id").alias(who), F.col("name").alias(alias))
    full = op.join(nm("keep_id", "k"), ["tree_id", "keep_id"], "left").join(
        nm("merge_id", "m"), ["tree_id", "merge_id"], "left"
    ).join(nm("person_id", "p"), ["tree_id", "person_id"], "left")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    or_id = lambda a, i: F.coalesce(a, F.col(i))
    pair = F.when(F.col("relation") == "spouse", "spouses").otherwise("parent–child")
    given = F.replace(F.try_element_at("name_raws", F.lit(1)), F.lit("/"), F.lit(""))
    k = F.col("kind")
    return full.select(
        "tree_id", "seq",
        F.when(k == "merge", say("Merged ", or_id(F.col("k"), "keep_id"), " ← ", or_id(F.col("m"), "merge_id")))
        .when(k == "addPerson", say("Added person ", F.coalesce(given, F.lit("(unnamed)"))))
        .when(k == "editPerson", say("Edited ", or_id(F.col("p"), "person_id")))
        .when(k == "addEvent", say("Added ", F.col("event_type"), " event"))
        .when(k == "editEvent", F.lit("Edited an event"))
        .when(k == "linkRelationship", say("Linked ", pair))
        .when(k == "unlinkRelationship", say("Unlinked ", pair)).alias("text"),
    )
