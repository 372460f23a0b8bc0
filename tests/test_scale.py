"""Operators that add up before they shuffle: same results as the plain aggregate, and less on the way."""

from __future__ import annotations

import glob
import random

from pyspark.sql import functions as F

from kinloom.functions.names import parse_names
from kinloom.operators import events, first_paths, paths, research, views
from kinloom.operators.lineage import scratch_root
from kinloom.plans import bridge, queries_reader
from kinloom.plans.catalog import load_all

LINE = ["tree_id", "focal_id", "ancestor_id"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stops_tables(spark):
    rnd = random.Random(5)
    touched = [("T", f"p{p}", f"e{p}-{i}") for p in range(9) for i in range(3)] + [("T", f"p{p}", f"m{p // 2}") for p in range(9)]
    told = [(t, p, e, "x", 1800, rnd.choice([1, 2, 3, 9]), rnd.choice(["a", "b", "c"]), "raw") for t, p, e in touched]
    told = [(*r[:5], hash(r[2]) % 7, *r[6:]) if r[2].startswith("m") else r for r in told]
    told.append(told[0])
    located = spark.createDataFrame(told, "tree_id string, person_id string, event_id string, type string, year int, sort_key bigint, place_key string, place_raw string")
    some = [("T", s, f"p{p}", p * 7 % 9) for s in ("s1", "s2", "s3") for p in rnd.sample(range(9), 6)]
    members = spark.createDataFrame([*some, ("T", "s1", some[0][2], 99)], "tree_id string, set_id string, person_id string, pos int")
    return members, located


def test_stops_of_one_person_are_not_compared(spark):
    members, located = stops_tables(spark)
    met = members.join(located, ["tree_id", "person_id"]).groupBy("tree_id", "set_id", "event_id").agg(
        F.min_by("person_id", "pos").alias("person_id"), F.first("sort_key").alias("sort_key"))
    got = events.stops_of_people(members, located).select("tree_id", "set_id", "event_id", "person_id", "sort_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect()))
    assert "LeftAnti" in plan(got)


def test_stop_totals_equal_an_aggregate_over_the_stops(spark):
    members, located = stops_tables(spark)
    key = F.struct("sort_key", "event_id")
    want = events.stops_of_people(members, located).groupBy("tree_id", "set_id").agg(
        F.count(F.lit(1)).alias("stops"), F.countDistinct("person_id").alias("owners"), F.countDistinct("place_key").alias("places"),
        F.min_by("event_id", key).alias("first_event"), F.min_by("person_id", key).alias("first_owner"), F.max_by("event_id", key).alias("last_event"))
    got = events.stop_totals(members, located)
    assert got.columns == want.columns
    # the place of a shared event is that of its first member
    fixed = [c for c in want.columns if c != "places"]
    assert sorted(map(tuple, got.select(fixed).collect())) == sorted(map(tuple, want.select(fixed).collect())) and want.count() == 3
    one_place = located.withColumn("place_key", F.concat(F.lit("k"), F.substring("event_id", 2, 1)))
    place = lambda df: sorted((r.set_id, r.places) for r in df.collect())
    assert place(events.stop_totals(members, one_place)) == place(events.stops_of_people(members, one_place).groupBy("set_id").agg(
        F.countDistinct("place_key").alias("places")))


def line_tables(spark):
    on = [("T", f"f{f}", f"a{a}", f"p{p}", 1) for f in range(2) for a in range(3) for p in range(6) if (f + a + p) % 3]
    on_line = spark.createDataFrame(on, "tree_id string, focal_id string, ancestor_id string, person_id string, depth int")
    told = [("T", f"p{p}", f"N{p % 2}", f"e{p}-{i}", "birth", None, 1800 - i if i % 2 else None, "" if i == 3 else f"k{(p + i) % 3}",
             f"L{p}-{i}", "sourced" if i == p else "unsourced") for p in range(6) for i in range(4)]
    facts = spark.createDataFrame(told, "tree_id string, person_id string, person_name string, event_id string, type string, date_raw string, "
                                        "year int, place_key string, place_label string, status string")
    return on_line, facts


def test_locality_rows_travel_once_per_focal(spark):
    on_line, facts = line_tables(spark)
    first = F.min(F.struct(research._fact_order().alias("o"), F.col("place_label").alias("label")))["label"]
    want = on_line.join(facts, ["tree_id", "person_id"]).groupBy(*LINE, "place_key").agg(
        first.alias("place_label"), F.count(F.lit(1)).alias("facts"), F.countDistinct("person_id").alias("people"),
        (F.count_if(F.col("status") == "sourced") == 0).alias("is_target"))
    got = research.locality_rows(on_line, facts)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "hashpartitioning(tree_id" in plan(got) and "SortAggregate" not in plan(got)


def test_plan_items_are_numbered_in_the_task_of_their_place(spark):
    on_line, facts = line_tables(spark)
    titles = on_line.select(*LINE).distinct().withColumn("title", F.lit("t"))
    got = research.markdown_lines(on_line, facts, titles)
    rows = got.where("item > 0 and section > 0 and text <> ''").collect()
    by = {}
    for r in on_line.join(facts, ["tree_id", "person_id"]).collect():
        by.setdefault((r.focal_id, r.ancestor_id, r.place_key), []).append(
            (r.year if r.year is not None else 1 << 53, r.person_name, r.type, r.person_id, r.event_id, f"- {r.person_name} · {r.type} · {r.year or '—'} · **{r.status}**"))
    place = {(r.focal_id, r.ancestor_id, r.place_key): r.place_no for r in research.locality_rows(on_line, facts).collect()}
    want = [(*k[:2], place[k], i, x[-1]) for k, xs in by.items() for i, x in enumerate(sorted(xs), 1)]
    assert sorted((r.focal_id, r.ancestor_id, r.section, r["item"], r.text) for r in rows) == sorted(want)
    assert plan(got).count("hashpartitioning(tree_id") and "place_key" in plan(got)


def test_long_texts_are_looked_up_by_six_letters(spark, monkeypatch):
    raws = [f"Ann /Lee#{i:06d}/" for i in range(60)] + ["", "Bob /Lee#000001 and more/"]
    person = spark.createDataFrame([("T", f"I{i}", i, [raw]) for i, raw in enumerate(raws)], "tree_id string, person_id string, seq bigint, raws array<string>")
    person = person.withColumn("names", parse_names(F.col("raws")))
    texts = ["lee#000001", "#00005", "ann", "0", "lee#0", "nobody here", "#000001 and", "  ", "Ann /Lee#00003"]
    asked = spark.createDataFrame([(t,) for t in texts], "query string")
    grams = views.name_grams(person)
    assert grams.where("gram = '000001'").count() == 2
    forms = {f"I{i}": [raw.lower(), raw.replace("/", "").lower()] for i, raw in enumerate(raws)}
    want = sorted((t, who) for t in texts for who, f in forms.items() if t.strip() and any(t.strip().lower() in x for x in f))
    for short in (views.SHORT_LIST, 0):
        monkeypatch.setattr(views, "SHORT_LIST", short)
        got = views.search_people(person, grams, asked)
        assert sorted((r.query, r.person_id) for r in got.collect()) == want


def test_edits_of_people_parse_no_events(spark, tmp_path, monkeypatch):
    spark.range(128).selectExpr(
        "id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'BUILDING' as c_mktsegment"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(800).selectExpr(
        "id as event_id", "element_at(array('signup', 'click', 'error', 'purchase'), cast(id % 4 + 1 as int)) as event_type"
    ).write.parquet(f"{tmp_path}/events.parquet")
    made = []
    monkeypatch.setattr(bridge.Bridge, "event", lambda self: made.append(self) or spark.range(0))
    for name in ("people_added", "people_merged", "relationships_unlinked", "merge_survivors"):
        assert load_all()[name](spark, str(tmp_path)).count() and not made


def test_files_do_not_grow_with_the_trees(spark, tmp_path):
    spark.range(0, 64 * 300, 32).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    before = set(glob.glob(f"{scratch_root(spark)}/kinloom-odd-*"))
    got = queries_reader.odd_corpus(bridge.Bridge(spark, str(tmp_path))).person.select("tree_id").distinct().count()
    (folder,) = set(glob.glob(f"{scratch_root(spark)}/kinloom-odd-*")) - before
    files = [f for f in glob.glob(f"{folder}/**", recursive=True) if f.endswith(".txt")]
    assert got == 300 and len(files) <= 128


def test_first_paths_write_no_table_per_generation(spark, monkeypatch):
    written, cut = [], first_paths.cut
    monkeypatch.setattr(first_paths, "cut", lambda df, *metrics: written.append(1) or cut(df, *metrics))
    edges = [(f"{s}{i}", f"{s}{i + 1}" if i < 5 else "TOP", i) for s in "AB" for i in range(6)]
    parents = spark.createDataFrame(
        [("T", up, low, f"F{low}", i, 0, 0) for low, up, i in edges],
        "tree_id string, parent_id string, child_id string, family_id string, fseq bigint, pord int, cord int")
    pairs = spark.createDataFrame([("T", "A0", "B0")], "tree_id string, from_id string, to_id string")
    found, count = first_paths.first_paths(parents, pairs, 2)
    want = [f"A{i}" for i in range(6)] + ["TOP"] + [f"B{i}" for i in reversed(range(6))]
    assert [(r.path_no, r.length, r.steps, r.apex_id) for r in found.collect()] == [(1, 12, want, "TOP")]
    assert [r.path_count for r in count.collect()] == [1] and len(written) <= 30


def test_names_are_looked_up_once_per_pair_and_person(spark):
    rows = [("T", "a", "c", 1, 2, ["a", "b", "c"]), ("T", "a", "c", 2, 2, ["a", "d", "c"]), ("T", "x", "b", 1, 1, ["x", "b"])]
    listed = spark.createDataFrame(rows, "tree_id string, from_id string, to_id string, path_no int, length int, steps array<string>")
    names = spark.createDataFrame([("T", "a", "Ann"), ("T", "b", "Bob"), ("T", "b", "Abe"), ("T", "c", None)], "tree_id string, person_id string, name string")
    got = paths.path_listing(listed, names)
    assert sorted((r.from_id, r.path_no, r.listing) for r in got.collect()) == [
        ("a", 1, "#1 (2 steps): Ann → Abe → Bob → c"), ("a", 2, "#2 (2 steps): Ann → d → c"), ("x", 1, "#1 (1 step): x → Abe → Bob")]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in text and "explode(steps" in text


def test_the_closure_of_everybody_carries_no_order(spark, tmp_path):
    spark.range(128).selectExpr("id as c_custkey", "'n' as c_name", "0 as c_nationkey", "'BUILDING' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    b = bridge.Bridge(spark, str(tmp_path))
    assert b.ancestors().columns == ["tree_id", "focal_id", "person_id", "min_depth"]
    pairs = b.ancestors().select("tree_id", "focal_id", "person_id", "min_depth").collect()
    assert sorted(pairs) == sorted(b.ordered_ancestors().select("tree_id", "focal_id", "person_id", "min_depth").collect()) and pairs
