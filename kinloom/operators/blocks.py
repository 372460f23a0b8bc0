"""Paths of many pairs of people, found block by block.

Paths are many and long, the links they run over are few. Asked pairs are dealt into
blocks of neighbours in (tree, from, to) order; the links above the people of a block are
found by a walk of all blocks at once and sent to the task of the block with its pairs.
There the paths are made in their order and go straight to whoever reads them: no path is
sorted, grouped or written on the way, and a very large tree becomes many blocks.

In a task, a person's climbs are listed once as rows of numbers; a path is a climb of each
end that share their last person only. Where a person has very many climbs, or a loop of
ancestry above them, paths are walked one by one instead, so memory is bounded by the links of
a block. Counts, first paths and highlights of loop-free trees build no list: of two people the
one lower in the tree moves on to a parent (see ``first_paths``), and sums over
pairs of people are kept for all pairs of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.lineage import cut

PAIRS = 128  # pairs of a block, at most
FOCALS = 256  # focal people of a block, at most
LARGE = 2048  # people above a block from which on sums over pairs of them are left to joins
LEVELS = 4  # levels planned per job
CLIMBS = 1024  # climbs of a person that are listed at once
KEPT = 300_000  # pairs of people, or cells of climbs by the hundred, remembered between asked pairs
ROWS = 32_768  # paths of a batch
_PAIR = ["tree_id", "from_id", "to_id"]
_LINK, _NAME, _ASKED = 0, 1, 2
PATHS = "tree_id string, from_id string, to_id string, path_no int, length int, steps array<string>, apex_id string, path_count bigint"
FIRST = PATHS.replace("bigint", "decimal(38,0)")
CLIMB = "tree_id string, focal_id string, person_id string, min_depth int"
HOPS = "tree_id string, from_id string, to_id string, a string, b string"


def tied_trees(parents: DataFrame) -> DataFrame:
    """(tree_id) of trees where the order of somebody's parents, or children, is not told."""
    found = None
    for who, place in (("child_id", "pord"), ("parent_id", "cord")):
        same = parents.groupBy("tree_id", who, "fseq", place).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tree_id")
        found = same if found is None else found.unionByName(same)
    return found.distinct()


def dealt(asked: DataFrame, size: int = PAIRS) -> DataFrame:
    """Asked (tree_id, from_id, to_id, ...) with ``block``: at most ``size`` neighbours of a tree together."""
    at = asked.repartitionByRange(*_PAIR).sortWithinPartitions(*_PAIR).withColumn("_n", F.monotonically_increasing_id())
    return cut(at.withColumn("block", F.expr(f"_n div {size}")).drop("_n"))[0]


def _two(pairs: DataFrame) -> DataFrame:
    return pairs.select(*_PAIR).where("from_id != to_id").distinct()


def above(parents: DataFrame, asked: DataFrame, ends: list[str]) -> DataFrame:
    """(tree_id, block, node): the people of each block and all their ancestors."""
    key = ["tree_id", "block", "node"]
    step = parents.select("tree_id", F.col("child_id").alias("node"), F.col("parent_id").alias("next"))
    first = None
    for end in ends:
        some = asked.select("tree_id", "block", F.col(end).alias("node"))
        first = some if first is None else first.unionByName(some)
    frontier, size = cut(first.distinct())
    seen = frontier
    while size["rows"]:
        level, made = frontier.select(*key), None
        for depth in range(LEVELS):
            level = level.join(step, ["tree_id", "node"]).select("tree_id", "block", F.col("next").alias("node")).distinct()
            part = level.withColumn("depth", F.lit(depth))
            made = part if made is None else made.unionByName(part)
        fresh = made.groupBy(*key).agg(F.max("depth").alias("depth")).join(seen.select(*key), key, "left_anti")
        # people met before the last level have been gone on from
        fresh, size = cut(fresh, F.max("depth").alias("deepest"))
        seen = seen.select(*key).unionByName(fresh.select(*key))
        if not size["rows"] or size["deepest"] < LEVELS - 1:
            break
        frontier = fresh.where(F.col("depth") == LEVELS - 1)
    return cut(seen.select(*key))[0]


def _rows(asked: DataFrame, nodes: DataFrame, parents: DataFrame, names: DataFrame | None) -> DataFrame:
    """Links, names and pairs of every block, one after the other in the task of the block."""
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    links = nodes.withColumnRenamed("node", "child_id").join(parents, ["tree_id", "child_id"]).select(
        "tree_id", "block", F.lit(_LINK).alias("kind"), F.col("child_id").alias("a"), F.col("parent_id").alias("b"),
        *[F.col(c).cast("bigint").alias(c) for c in ("fseq", "pord", "cord")])
    rows = links.unionByName(asked.select(
        "tree_id", "block", F.lit(_ASKED).alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b"),
        none.alias("fseq"), none.alias("pord"), none.alias("cord")))
    if names is not None:
        called = nodes.join(names.select("tree_id", F.col("person_id").alias("node"), "name"), ["tree_id", "node"])
        rows = rows.unionByName(called.select(
            "tree_id", "block", F.lit(_NAME).alias("kind"), F.col("node").alias("a"), F.coalesce("name", "node", text).alias("b"),
            none.alias("fseq"), none.alias("pord"), none.alias("cord")))
    return rows


def tasks_of(df: DataFrame, blocks: int) -> int:
    """Tasks for so many blocks: what a block gives is much more than what it takes, so sizes say nothing."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(max(least, blocks // 32), 4000))


def _sent(asked: DataFrame, nodes: DataFrame, parents: DataFrame, names: DataFrame | None = None) -> DataFrame:
    blocks = asked.select("tree_id", "block").distinct().count()
    rows = _rows(asked, nodes, parents, names)
    return rows.repartition(tasks_of(rows, blocks), "tree_id", "block").sortWithinPartitions("tree_id", "block", "kind", "a", "b")


def _place(*at) -> tuple:
    return tuple((x is not None, x or 0) for x in at)


class Block:
    """The links above the pairs of one block. People are numbers."""

    def __init__(self) -> None:
        self.no: dict[str, int] = {}
        self.ids: list[str] = []
        self.links: list[tuple] = []
        self.names: dict[int, list[str]] = {}
        self._known: dict[int, tuple] = {}
        self._cells = 0
        self._sums: dict[tuple[int, int], tuple] = {}
        self._masks: dict[tuple[int, int], int] = {}

    def number(self, who: str) -> int:
        at = self.no.setdefault(who, len(self.ids))
        if at == len(self.ids):
            self.ids.append(who)
        return at

    def close(self) -> None:
        """All links are there: parents and children in order, and a rank that is higher for ancestors."""
        n = len(self.ids)
        self.up: list[list[tuple]] = [[] for _ in range(n)]
        self.down: list[list[tuple]] = [[] for _ in range(n)]
        for e, (child, parent, f, p, c) in enumerate(self.links):
            self.up[child].append((_place(f, p), _place(f, c), parent, e))
            self.down[parent].append((_place(f, c), child))
        for some in (*self.up, *self.down):
            some.sort()
        waits = [len(x) for x in self.down]
        free, self.rank = [x for x in range(n) if not waits[x]], [0] * n
        for at, who in enumerate(free):  # the list grows while it is read
            self.rank[who] = at
            for _, _, parent, _ in self.up[who]:
                waits[parent] -= 1
                if not waits[parent]:
                    free.append(parent)
        self.looped = len(free) < n
        self.order = free
        if not self.looped:
            climbs = [1] * n
            for who in reversed(free):
                climbs[who] = min(1 + sum(climbs[x[2]] for x in self.up[who]), CLIMBS + 1)
            self.climbs = climbs

    def shown(self) -> list[str]:
        return [" → ".join(sorted(self.names[i])) if i in self.names else who for i, who in enumerate(self.ids)]

    def ancestors(self, who: int) -> set[int]:
        seen, todo = {who}, [who]
        while todo:
            for _, _, parent, _ in self.up[todo.pop()]:
                if parent not in seen:
                    seen.add(parent)
                    todo.append(parent)
        return seen

    # -- all paths ---------------------------------------------------------

    def _listed(self, who: int, memo: dict) -> list[tuple]:
        """(people, places seen from above) of the climbs of somebody, in the order in which their paths come."""
        todo = [who]
        while todo:
            at = todo[-1]
            if at in memo:
                todo.pop()
                continue
            missing = [x[2] for x in self.up[at] if x[2] not in memo]
            if missing:
                todo.extend(missing)
                continue
            # who climbs on comes before who turns
            memo[at] = [((at, *steps), (*places, place)) for _, place, parent, _ in self.up[at] for steps, places in memo[parent]] + [((at,), ())]
            todo.pop()
        return memo[who]

    def _climbs_of(self, who: int):
        """Two tables of the climbs of somebody, as those who climb and as those who come down; each (people row by row, their number),
        and of those who climb (last person, the others as bits), of those who come down {last person: (row, the others as bits)}."""
        if who not in self._known:
            listed = self._listed(who, {})
            made, last = [], []
            for rows, turned in ((listed, False), (sorted(listed, key=lambda x: x[1]), True)):
                size = np.array([len(s) for s, _ in rows])
                steps = np.full((len(rows), size.max()), -1, dtype=np.int32)
                for i, (s, _) in enumerate(rows):
                    steps[i, :len(s)] = s[::-1] if turned else s
                made.append((steps, size))
                last.append([(s[-1], sum(1 << x for x in s[:-1])) for s, _ in rows])
            by_top: dict[int, list[tuple[int, int]]] = {}
            for j, (top, bits) in enumerate(last[1]):
                by_top.setdefault(top, []).append((j, bits))
            cells = sum(x[0].size for x in made) + 8 * len(listed)
            self._cells += cells
            if self._cells > KEPT * 100:
                self._known.clear()
                self._cells = cells
            self._known[who] = (made[0], last[0], made[1], by_top)
        return self._known[who]

    def paths(self, s: int, t: int) -> tuple[int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """How many paths lead from s to t, and pieces (size of each, people one after the other, apex of each) in their order."""
        if self.looped or self.climbs[s] > CLIMBS or self.climbs[t] > CLIMBS:
            number = sum(1 for _ in self.walks(s, t)) if self.looped else self.sums(s, t, 0)[0]
            return number, self._walked(s, t)
        (steps_s, size_s), climbing, _, _ = self._climbs_of(s)
        _, _, (steps_t, size_t), by_top = self._climbs_of(t)
        pairs = [(i, j, top) for i, (top, bits) in enumerate(climbing) if top in by_top for j, others in by_top[top] if not bits & others]

        def pieces():
            for low in range(0, len(pairs), ROWS):
                a, b, top = np.array(pairs[low:low + ROWS], dtype=np.int32).T
                # the apex stands at the end of the one and at the beginning of the other
                table = np.concatenate([steps_s[a], steps_t[b][:, 1:]], axis=1)
                yield size_s[a] + size_t[b] - 1, table[table >= 0], top

        return len(pairs), pieces()

    def _walked(self, s: int, t: int):
        walks = self.walks(s, t)
        while some := list(islice(walks, ROWS)):
            yield (np.array([len(p) for p, _ in some]), np.array([x for p, _ in some for x in p], dtype=np.int32),
                   np.array([top for _, top in some], dtype=np.int32))

    def walks(self, s: int, t: int) -> Iterator[tuple[list[int], int]]:
        """(people, apex) of the paths from s to t one by one, in their order; nobody comes twice on a path."""
        over_t = self.ancestors(t)
        over_s = self.ancestors(s)
        useful, todo = over_s & over_t, list(over_s & over_t)
        while todo:  # who can climb to somebody above t
            for _, child in self.down[todo.pop()]:
                if child in over_s and child not in useful:
                    useful.add(child)
                    todo.append(child)
        if s not in useful:
            return
        trail, on, open_ = [s], {s}, [iter(self.up[s]) if s != t else iter(())]
        while trail:
            step = next((x[2] for x in open_[-1] if x[2] in useful and x[2] not in on), None)
            if step is not None:
                trail.append(step)
                on.add(step)
                open_.append(iter(self.up[step]) if step != t else iter(()))
                continue
            if trail[-1] in over_t:
                yield from self._descents(trail, on, t, over_t)
            on.discard(trail.pop())
            open_.pop()

    def _descents(self, climb: list[int], taken: set[int], t: int, over_t: set[int]):
        top = climb[-1]
        if top == t:
            yield list(climb), top
            return
        trail, on, open_ = [], set(), [iter(self.down[top])]
        while open_:
            step = next((x[1] for x in open_[-1] if x[1] in over_t and x[1] not in taken and x[1] not in on), None)
            if step is None:
                open_.pop()
                if trail:
                    on.discard(trail.pop())
            elif step == t:
                yield [*climb, *trail, t], top
            else:
                trail.append(step)
                on.add(step)
                open_.append(iter(self.down[step]))

    # -- sums over pairs of people, for loop-free trees -----------------------

    def _settle(self, memo: dict, s: int, t: int, make) -> tuple | int:
        """``make(u, v, climbs, ways on)`` for (s, t), from those of the pairs further up."""
        if len(memo) > KEPT:
            memo.clear()
        todo, rank = [(s, t)], self.rank
        while todo:
            u, v = pair = todo[-1]
            if pair in memo:
                todo.pop()
                continue
            if u == v:
                memo[pair] = make(u, v, False, None)
                todo.pop()
                continue
            climbs = rank[u] < rank[v]
            on = [(x, (x[2], v)) for x in self.up[u]] if climbs else [(x, (u, x[2])) for x in self.up[v]]
            missing = [p for _, p in on if p not in memo]
            if missing:
                todo.extend(missing)
                continue
            memo[pair] = make(u, v, climbs, on)
            todo.pop()
        return memo[(s, t)]

    def sums(self, s: int, t: int, first: int) -> tuple[int, list]:
        """The number of paths from s to t, and (order, people) of the first ones."""
        memo = self._sums

        def make(u, v, climbs, on):
            if on is None:
                return 1, [((), (u,))] if first else []
            n, ways = 0, []
            for (up, down, _, _), pair in on:
                m, theirs = memo[pair]
                n += m
                if climbs:
                    ways += [(((0, *up), *key), (u, *steps)) for key, steps in theirs]
                else:
                    ways += [((*key, (1, *down)), (*steps, v)) for key, steps in theirs]
            if len(on) > 1 and len(ways) > 1:
                ways.sort()
            return n, ways[:first]

        return self._settle(memo, s, t, make)

    def mask(self, s: int, t: int) -> int:
        """The links on the paths from s to t as bits; -1 if there is none."""
        memo = self._masks

        def make(u, v, climbs, on):
            if on is None:
                return 0
            every, any_ = 0, False
            for (_, _, _, e), pair in on:
                if memo[pair] >= 0:
                    every, any_ = every | 1 << e | memo[pair], True
            return every if any_ else -1

        return self._settle(memo, s, t, make)

    def hops(self, s: int, t: int) -> list[int]:
        """The links on the paths from s to t."""
        if self.looped:
            seen = {frozenset(h) for p, _ in self.walks(s, t) for h in zip(p, p[1:])}
            return [e for e, x in enumerate(self.links) if frozenset(x[:2]) in seen]
        bits = self.mask(s, t)
        if bits <= 0:
            return []
        row = np.unpackbits(np.frombuffer(bits.to_bytes(-(-len(self.links) // 8), "little"), dtype=np.uint8), bitorder="little")
        return np.flatnonzero(row).tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block, Iterator[tuple[int, int]]]]:
    """Every block of a task with its pairs."""

    def close(tree: str, block: Block, asked: list):
        pairs = [(block.number(a), block.number(b)) for a, b in asked]
        block.close()
        return tree, block, pairs

    here, block, asked = None, Block(), []
    for batch in batches:
        for tree, no, kind, a, b, f, p, c in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if (tree, no) != here:
                if here is not None:
                    yield close(here[0], block, asked)
                here, block, asked = (tree, no), Block(), []
            if kind == _LINK:
                block.links.append((block.number(a), block.number(b), f, p, c))
            elif kind == _NAME:
                block.names.setdefault(block.number(a), []).append(b)
            else:
                asked.append((a, b))
    if here is not None:
        yield close(here[0], block, asked)


class _Sheet:
    """Paths of a block on their way out."""

    def __init__(self, tree: str, block: Block, count: pa.DataType) -> None:
        self.tree, self.count = tree, count
        self.ids, self.shown = pa.array(block.ids, pa.string()), pa.array(block.shown(), pa.string())
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, s: int, t: int, low: int, size: np.ndarray, people: np.ndarray, apex: np.ndarray, number: int) -> None:
        self.parts.append((s, t, low, size, people, apex, number))
        self.rows += len(size)

    def batch(self) -> pa.RecordBatch:
        n = [len(x[3]) for x in self.parts]
        each = lambda i, kind=np.int32: pa.array(np.repeat(np.array([x[i] for x in self.parts], dtype=kind), n))
        size = np.concatenate([x[3] for x in self.parts]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        no = np.concatenate([np.arange(x[2] + 1, x[2] + 1 + len(x[3]), dtype=np.int32) for x in self.parts])
        steps = pa.ListArray.from_arrays(pa.array(ends), self.shown.take(pa.array(np.concatenate([x[4] for x in self.parts]))))
        number = pa.array([x[6] for x in self.parts], self.count).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(self.tree, pa.string()), len(size)), self.ids.take(each(0)), self.ids.take(each(1)), pa.array(no), pa.array(size - 1),
             steps, self.ids.take(pa.array(np.concatenate([x[5] for x in self.parts]))), number],
            names=["tree_id", "from_id", "to_id", "path_no", "length", "steps", "apex_id", "path_count"])


def _list_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree, block, pairs in _blocks(batches):
        sheet = _Sheet(tree, block, pa.int64())
        for s, t in pairs:
            number, pieces = block.paths(s, t)
            low = 0
            for size, people, apex in pieces:
                sheet.add(s, t, low, size, people, apex, number)
                low += len(size)
                if sheet.rows >= ROWS:
                    yield sheet.batch()
                    sheet.clear()
        if sheet.rows:
            yield sheet.batch()


def _list_first(first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, pairs in _blocks(batches):
            sheet = _Sheet(tree, block, pa.decimal128(38, 0))
            for s, t in pairs:
                if block.looped:
                    number = sum(1 for _ in block.walks(s, t))
                    some = [(p, top) for p, top in islice(block.walks(s, t), first)]
                else:
                    number, ways = block.sums(s, t, first)
                    some = [(p, max(p, key=block.rank.__getitem__)) for _, p in ways]
                if some:
                    sheet.add(s, t, 0, np.array([len(p) for p, _ in some]), np.array([x for p, _ in some for x in p], dtype=np.int32),
                              np.array([top for _, top in some], dtype=np.int32), number)
                if sheet.rows >= ROWS:
                    yield sheet.batch()
                    sheet.clear()
            if sheet.rows:
                yield sheet.batch()

    return run


def _list_hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree, block, pairs in _blocks(batches):
        ids = pa.array(block.ids, pa.string())
        ends = np.array([x[:2] for x in block.links], dtype=np.int32).reshape(-1, 2)
        # a link that is told twice is one hop
        one = {}
        single = np.array([one.setdefault(tuple(sorted(x)), i) for i, x in enumerate(ends.tolist())], dtype=np.int32)
        found = [(s, t, np.unique(single[block.hops(s, t)])) for s, t in pairs]
        found = [x for x in found if len(x[2])]
        if not found:
            continue
        each = [len(x[2]) for x in found]
        hops = np.concatenate([x[2] for x in found])
        column = lambda values: ids.take(pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(tree, pa.string()), len(hops)), column(np.repeat([x[0] for x in found], each)),
             column(np.repeat([x[1] for x in found], each)), column(ends[hops, 0]), column(ends[hops, 1])],
            names=["tree_id", "from_id", "to_id", "a", "b"])


def every_path(parents: DataFrame, pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All paths of the asked pairs, numbered, with their count; with ``names`` the steps are names.

    ``parents`` of trees where the order of parents and children is told.
    """
    asked = dealt(_two(pairs))
    nodes = above(parents, asked, ["from_id", "to_id"])
    return _sent(asked, nodes, parents, names).mapInArrow(_list_paths, PATHS)


def parted(parents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Asked pairs in blocks, the people above those, the pairs of large blocks, and the number of such pairs."""
    asked = dealt(_two(pairs))
    nodes = above(parents, asked, ["from_id", "to_id"])
    large = nodes.groupBy("tree_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("tree_id", "block")
    wide, size = cut(asked.join(large, ["tree_id", "block"], "left_semi"))
    if size["rows"]:
        asked, _ = cut(asked.join(wide, [*_PAIR, "block"], "left_anti"))
        nodes = nodes.join(asked.select("tree_id", "block").distinct(), ["tree_id", "block"], "left_semi")
    return asked, nodes, wide.select(*_PAIR), size["rows"]


def some_paths(asked: DataFrame, nodes: DataFrame, parents: DataFrame, first: int) -> DataFrame:
    """The first paths of pairs in blocks, and how many there are."""
    return _sent(asked, nodes, parents).mapInArrow(_list_first(first), FIRST)


def hops_on_paths(asked: DataFrame, nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(tree_id, from_id, to_id, a, b): the links on the paths of pairs in blocks, each once."""
    return _sent(asked, nodes, parents).mapInArrow(_list_hops, HOPS)


def _list_ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree, block, pairs in _blocks(batches):
        ids, parts, rows = pa.array(block.ids, pa.string()), [], 0
        up = [[x[2] for x in some] for some in block.up]
        for n, (focal, _) in enumerate(pairs, 1):
            depth, level, far = {focal: 0}, [focal], 0
            while level:
                far, above_ = far + 1, []
                for who in level:
                    for parent in up[who]:
                        if parent not in depth:
                            depth[parent] = far
                            above_.append(parent)
                level = above_
            del depth[focal]
            parts.append((focal, list(depth), list(depth.values())))
            rows += len(depth)
            if rows and (rows >= ROWS or n == len(pairs)):
                flat = lambda i: pa.array(np.concatenate([np.array(p[i], dtype=np.int32) for p in parts]))
                focals = pa.array(np.repeat(np.array([p[0] for p in parts], dtype=np.int32), [len(p[1]) for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(tree, pa.string()), rows), ids.take(focals), ids.take(flat(1)), flat(2)],
                                                 names=["tree_id", "focal_id", "person_id", "min_depth"])
                parts, rows = [], 0


def ancestors(parents: DataFrame, focals: DataFrame) -> DataFrame:
    """The upward ``closure`` (tree_id, focal_id, person_id, min_depth) of focal people, block by block: what is joined level by
    level are the people above a block, not those above each focal."""
    links, zero = parents.select("tree_id", "parent_id", "child_id").distinct(), F.lit(0)
    who = F.col("focal_id")
    asked = focals.where("tree_id is not null and focal_id is not null").select("tree_id", who.alias("from_id"), who.alias("to_id")).distinct()
    asked = dealt(asked, FOCALS)
    nodes = above(links, asked, ["from_id"])
    return _sent(asked, nodes, links.select("*", zero.alias("fseq"), zero.alias("pord"), zero.alias("cord"))).mapInArrow(_list_ancestors, CLIMB)
