"""Checks of proposed and existing links, and where a new link could go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.closure import closure
from kinloom.operators.graph import spouse_links
from kinloom.operators.kinship import closes_loop
from kinloom.operators.lineage import cut
from kinloom.operators.paths import looping_people

# Youngest plausible parent, years allowed after a parent's death.
MIN_PARENT_AGE = 13
POSTHUMOUS_YEARS = 1


def _years(vitals: DataFrame, who: str, tag: str) -> DataFrame:
    return vitals.select(
        "tree_id", F.col("person_id").alias(who), F.col("birth.date.year").alias(f"{tag}_birth"),
        F.col("death.date.year").alias(f"{tag}_death"),
    )


def _named(person: DataFrame, who: str, alias: str) -> DataFrame:
    first = F.try_element_at("names", F.lit(1))
    return person.select(
        "tree_id", F.col("person_id").alias(who), F.coalesce(first["full"], F.col("person_id")).alias(alias)
    )


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _issue(severity: str, when, message):
    return F.when(when, F.struct(F.lit(severity).alias("severity"), message.alias("message")))


def _spread(df: DataFrame, keys: list[str], blocks: list, warnings: list) -> DataFrame:
    """Explode the issues; a block hides everything else."""
    block = F.coalesce(*blocks)
    found = F.when(block.isNotNull(), F.array(block)).otherwise(F.array_compact(F.array(*warnings)))
    return df.select(*keys, F.posexplode(found).alias("issue_no", "issue")).select(
        *keys, "issue_no", "issue.severity", "issue.message"
    )


# The wording of all issues and consequences in this module.
def _date_warnings(p, c):
    pb, cb, pd = F.col("p_birth"), F.col("c_birth"), F.col("p_death")
    text = lambda col: col.cast("string")
    return [
        _issue("warn", pb > cb, _say(p, " was born in ", text(pb), ", after ", c, " in ", text(cb), ".")),
        _issue(
            "warn", (pb <= cb) & (cb - pb < MIN_PARENT_AGE),
            _say(p, " would have been ", text(cb - pb), " at ", c, "'s birth."),
        ),
        _issue(
            "warn", cb > pd + POSTHUMOUS_YEARS,
            _say(c, " was born in ", text(cb), ", after ", p, " died in ", text(pd), "."),
        ),
    ]


def check_parent_child(
    person: DataFrame, parents: DataFrame, vitals: DataFrame, proposals: DataFrame
) -> DataFrame:
    """Issues of proposed (parent_id, child_id) links; none for unknown people."""
    keys = ["tree_id", "parent_id", "child_id"]
    asked, _ = cut(
        proposals.select(*keys).distinct()
        .join(_named(person, "parent_id", "p"), ["tree_id", "parent_id"])
        .join(_named(person, "child_id", "c"), ["tree_id", "child_id"])
    )
    loops = closes_loop(parents, asked).withColumn("loop", F.lit(True))
    known = parents.select(*keys, F.lit(True).alias("known"))
    recorded = (
        parents.join(asked.select("tree_id", "child_id").distinct(), ["tree_id", "child_id"], "left_semi")
        .join(_named(person, "parent_id", "pname"), ["tree_id", "parent_id"])
        .groupBy("tree_id", "child_id")
        .agg(F.sort_array(F.collect_list(F.struct("fseq", "pord", "pname"))).alias("ps"))
        .select("tree_id", "child_id",
                F.array_join(F.transform("ps", lambda x: x["pname"]), " and ").alias("parent_names"))
    )
    full = (
        asked.join(loops, keys, "left").join(known, keys, "left")
        .join(recorded, ["tree_id", "child_id"], "left")
        .join(_years(vitals, "parent_id", "p"), ["tree_id", "parent_id"], "left")
        .join(_years(vitals, "child_id", "c"), ["tree_id", "child_id"], "left")
    )
    p, c = F.col("p"), F.col("c")
    blocks = [
        _issue("block", F.col("parent_id") == F.col("child_id"), _say(p, " cannot be their own parent.")),
        _issue(
            "block", F.col("loop"),
            _say(p, " is already a descendant of ", c, ", so this would make ", c, " their own ancestor."),
        ),
    ]
    warnings = [
        _issue("warn", F.col("known"), _say(p, " is already recorded as a parent of ", c, ".")),
        _issue(
            "warn", F.col("known").isNull() & F.col("parent_names").isNotNull(),
            _say(c, " already has recorded parents (", F.col("parent_names"),
                 "). This family will be the one exported as their parentage."),
        ),
        *_date_warnings(p, c),
    ]
    return _spread(full, keys, blocks, warnings)


def check_spouses(
    person: DataFrame, parents: DataFrame, spouses: DataFrame, proposals: DataFrame
) -> DataFrame:
    """Issues of proposed (a_id, b_id) marriages; none for unknown people."""
    keys = ["tree_id", "a_id", "b_id"]
    wed = spouse_links(spouses).select(
        "tree_id", F.col("person_id").alias("a_id"), F.col("spouse_id").alias("b_id"), F.lit(True).alias("wed")
    )
    blood = parents.select(
        "tree_id", F.col("parent_id").alias("a_id"), F.col("child_id").alias("b_id")
    ).unionByName(
        parents.select("tree_id", F.col("child_id").alias("a_id"), F.col("parent_id").alias("b_id"))
    ).distinct().withColumn("blood", F.lit(True))
    full = (
        proposals.select(*keys).distinct()
        .join(_named(person, "a_id", "a"), ["tree_id", "a_id"])
        .join(_named(person, "b_id", "b"), ["tree_id", "b_id"])
        .join(wed, keys, "left").join(blood, keys, "left")
    )
    a, b = F.col("a"), F.col("b")
    blocks = [
        _issue("block", F.col("a_id") == F.col("b_id"), _say(a, " cannot be married to themselves.")),
    ]
    warnings = [
        _issue("warn", F.col("wed"), _say(a, " and ", b, " are already recorded as spouses.")),
        _issue("warn", F.col("blood"), _say(a, " and ", b, " are already recorded as parent and child.")),
    ]
    return _spread(full, keys, blocks, warnings)


def audit_links(person: DataFrame, parents: DataFrame, vitals: DataFrame) -> DataFrame:
    """Date and loop rules over every existing parent-child link.

    Only links between people left over by the loop search can close a loop, so
    the closure runs on those alone (usually none).
    """
    keys = ["tree_id", "parent_id", "child_id"]
    core, metrics = cut(looping_people(parents))
    full = (
        parents.select(*keys)
        .join(_named(person, "parent_id", "p"), ["tree_id", "parent_id"])
        .join(_named(person, "child_id", "c"), ["tree_id", "child_id"])
        .join(_years(vitals, "parent_id", "p"), ["tree_id", "parent_id"], "left")
        .join(_years(vitals, "child_id", "c"), ["tree_id", "child_id"], "left")
    )
    if metrics["rows"]:
        inside = parents.join(
            core.withColumnRenamed("person_id", "parent_id"), ["tree_id", "parent_id"], "left_semi"
        ).join(core.withColumnRenamed("person_id", "child_id"), ["tree_id", "child_id"], "left_semi")
        above = closure(inside, core.withColumnRenamed("person_id", "focal_id"))
        loops = inside.select(*keys).join(
            above.select("tree_id", F.col("focal_id").alias("parent_id"), F.col("person_id").alias("child_id")),
            keys, "left_semi",
        ).withColumn("loop", F.lit(True))
        full = full.join(loops, keys, "left")
    else:
        full = full.withColumn("loop", F.lit(None).cast("boolean"))
    p, c = F.col("p"), F.col("c")
    blocks = [
        _issue(
            "block", F.col("loop"),
            _say(p, " is already a descendant of ", c, ", so this would make ", c, " their own ancestor."),
        ),
    ]
    return _spread(full, keys, blocks, _date_warnings(p, c))


def candidate_families(
    family: DataFrame, family_spouse: DataFrame, family_child: DataFrame, people: DataFrame, role: str
) -> DataFrame:
    """Families a new child, parent or spouse of each person could join, in file order.

    (tree_id, person_id, family_id, seq, spouses, children)
    """
    mine = (family_child if role == "parent" else family_spouse).select(
        "tree_id", "person_id", "family_id"
    ).distinct()
    size = lambda links, name: links.groupBy("tree_id", "family_id").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = (
        people.select("tree_id", "person_id").distinct().join(mine, ["tree_id", "person_id"])
        .join(family.select("tree_id", "family_id", "seq"), ["tree_id", "family_id"])
        .join(size(family_spouse, "spouses"), ["tree_id", "family_id"], "left")
        .join(size(family_child, "children"), ["tree_id", "family_id"], "left")
        .select("tree_id", "person_id", "family_id", "seq", zero("spouses"), zero("children"))
    )
    return out.where(F.col("spouses") < 2) if role == "spouse" else out


def unlink_parent_impact(
    person: DataFrame, family_spouse: DataFrame, parents: DataFrame, names: DataFrame
) -> DataFrame:
    """What removing each parent-child link would say."""
    from kinloom.operators.graph import co_parents

    asked = parents.select("tree_id", "parent_id", "child_id", "family_id")
    others = (
        co_parents(person, family_spouse, asked.select("tree_id", "family_id", "parent_id").distinct())
        .join(names.select("tree_id", F.col("person_id").alias("co_parent_id"), F.col("name").alias("co")),
              ["tree_id", "co_parent_id"])
        .groupBy("tree_id", "family_id", "parent_id")
        .agg(F.sort_array(F.collect_list(F.struct("ord", "co"))).alias("cs"))
        .select("tree_id", "family_id", "parent_id",
                F.array_join(F.transform("cs", lambda x: x["co"]), " and ").alias("also"))
    )
    nm = lambda who, alias: names.select("tree_id", F.col("person_id").alias(who), F.col("name").alias(alias))
    base = _say("Remove ", F.col("p"), " as a parent of ", F.col("c"), "?")
    return (
        asked.join(others, ["tree_id", "family_id", "parent_id"], "left")
        .join(nm("parent_id", "p"), ["tree_id", "parent_id"]).join(nm("child_id", "c"), ["tree_id", "child_id"])
        .select(
            "tree_id", "parent_id", "child_id", "family_id",
            F.when(
                F.col("also").isNotNull(),
                _say(base, " This also removes ", F.col("also"), ", because GEDCOM records them as one couple."),
            ).otherwise(base).alias("consequence"),
        )
    )


def unlink_spouse_impact(spouses: DataFrame, family_child: DataFrame, names: DataFrame) -> DataFrame:
    """What removing each spouse (``row_id``) from a person would say."""
    kids = family_child.groupBy("tree_id", "family_id").agg(F.count(F.lit(1)).alias("kids"))
    nm = lambda who, alias: names.select("tree_id", F.col("person_id").alias(who), F.col("name").alias(alias))
    base = _say("Remove ", F.col("r"), " as a spouse of ", F.col("p"), "?")
    which = F.when(F.col("kids") == 1, "their child").otherwise(
        F.concat(F.lit("their "), F.col("kids").cast("string"), F.lit(" children"))
    )
    return (
        spouse_links(spouses).select("tree_id", "person_id", F.col("spouse_id").alias("row_id"), "family_id")
        .join(kids, ["tree_id", "family_id"], "left")
        .join(nm("person_id", "p"), ["tree_id", "person_id"]).join(nm("row_id", "r"), ["tree_id", "row_id"])
        .select(
            "tree_id", "person_id", "row_id", "family_id",
            F.when(
                F.col("kids") > 0,
                _say(base, " They also stop being recorded as a parent of ", which,
                     ", because GEDCOM stores the marriage and the children as one family."),
            ).otherwise(base).alias("consequence"),
        )
    )
