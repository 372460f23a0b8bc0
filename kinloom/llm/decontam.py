"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A window of a document as long as a benchmark item gets the 128-bit SimHash of
its word shingles. An item is a candidate if the fingerprints differ in at most
``RADIUS`` bits: cut into eight blocks of 16 bits, two such fingerprints differ in
at most ``RADIUS // 8`` bits in one block at least, so looking up every value that
near in each block's table finds all of them. Candidates are verified exactly: the
shingles, weighted by how often they occur, must have a similarity (sum of minima
over sum of maxima) of at least ``least``. Fingerprints of windows at 0.8 differ in
19 bits on average, with a deviation of 4, if no shingle repeats; items with
repeated shingles, whose bits depend on each other, are found by the number of
their shingles instead, and so are all with ``exact``.

Items of fewer than five words are one shingle of all their words. A document
shorter than an item has no window of its length; it is verified against the
items that have the needed share of their shingles in it.

Only documents in which enough shingles of items lie close together go further:
the tasks test that against a bitmap of all items' shingles, whose size is
bounded; a full bitmap lets more documents through, never fewer. These documents
and the items, in blocks of about ``BLOCK_WORDS`` words, meet in a grid, where the
tasks build the index of their block.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fresh
from kinloom.llm.neardup import Sketcher, mixed
from kinloom.operators.lineage import cut

SHINGLE = 5
RADIUS = 39  # bits of 128
BLOCKS = 8  # of 16 bits
BLOCK_WORDS = 400_000  # words of a block of items
CELL_CHARS = 1_000_000  # code points of a block of documents
MOST_BITS = 27  # the bitmap has at most 2^27 bits
WORD = re.compile(r"\w+")
MATCHES = "number long, item_id long, word_start long, n_words long, similarity double"
PROBES = np.array([x for x in range(1 << 16) if x.bit_count() <= RADIUS // BLOCKS], dtype=np.uint16)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def shingle_counts(words: list[str]) -> Counter:
    size = min(SHINGLE, len(words))
    return Counter(zip(*(words[i:] for i in range(size)), strict=False))


def needed(n: int, least: float) -> int:
    """Shingles of an item with ``n`` of them that a similar window has at least."""
    return int(np.ceil(least * n - 1e-9))


def fingerprints(value: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """SimHash (rows of 8 blocks) of the shingle hashes ``value[s:s + width]`` for each start; repeated shingles vote as often as they occur."""
    out = np.zeros((len(start), 2), dtype=np.uint64)
    both = np.stack([value, mixed(value ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    for low in range(0, len(start), 512):
        some = both[start[low:low + 512, None] + np.arange(width)]
        for b in range(64):
            votes = ((some >> np.uint64(b)) & np.uint64(1)).sum(axis=1)
            out[low:low + 512] |= (votes * 2 > width).astype(np.uint64) << np.uint64(b)
    return out.view(np.uint16)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of blocks."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def close_runs(hit: np.ndarray, width: int, enough: int) -> np.ndarray:
    """Positions in ``hit`` from which ``enough`` of its values lie within ``width``."""
    if len(hit) < enough:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(hit[enough - 1:] - hit[:len(hit) - enough + 1] < width)


def _by_value(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(value, kind="stable")
    return value[order], owner[order]


class Index:
    """A block of benchmark items, built in the task that searches it."""

    def __init__(self, items: list[tuple[int, str]], least: float, exact: bool = False):
        self.least, self.exact = least, exact
        known = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.ids, self.words = [i for i, _ in known], [w for _, w in known]
        self.counts: dict[int, Counter] = {}
        value, count = Sketcher(SHINGLE).shingles(self.words)
        at = np.cumsum(count) - count
        self.gram = np.fromiter((min(SHINGLE, len(w)) for w in self.words), dtype=np.int64, count=len(known))
        self.width, self.owned, self.repeating = count, {}, {}
        self.lengths_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # shingles of items, and the length of an item that has it
        self.prints = np.zeros((len(known), BLOCKS), dtype=np.uint16)
        for g, n in sorted(set(zip(self.gram.tolist(), count.tolist(), strict=True))):
            some = np.flatnonzero((self.gram == g) & (count == n))
            flat = value[(at[some, None] + np.arange(n)).ravel()]
            owner = np.repeat(some, n)
            repeats = np.array([len(np.unique(value[a:a + n])) < n for a in at[some].tolist()])
            self.owned[g, n] = _by_value(flat, owner)
            self.repeating[g, n] = _by_value(flat[np.repeat(repeats, n)], owner[np.repeat(repeats, n)])
            self.prints[some] = fingerprints(value, at[some], n)
            known = np.unique(flat)
            before = self.lengths_of.get(g, (flat[:0], owner[:0]))
            self.lengths_of[g] = _by_value(np.r_[before[0], known], np.r_[before[1], np.full(len(known), n)])

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: which values occur, items by the block's value, and where each value begins."""
        out = []
        for b in range(BLOCKS):
            order = np.argsort(self.prints[:, b], kind="stable")
            edge = np.searchsorted(self.prints[order, b], np.arange((1 << 16) + 1))
            out.append((edge[1:] > edge[:-1], order, edge))
        return out

    def within(self, prints: np.ndarray, gram: int, width: int) -> Iterator[tuple[int, int]]:
        """(row of ``prints``, item) for all items of that length whose fingerprint is within the radius."""
        size = len(self.ids)
        for low in range(0, len(prints), 64):
            some, pairs = prints[low:low + 64], []
            for b, (filled, order, edge) in enumerate(self.tables):
                near = some[:, b, None] ^ PROBES
                w, p = np.nonzero(filled[near])
                at = near[w, p].astype(np.int64)
                n = edge[at + 1] - edge[at]
                item = order[np.repeat(edge[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pairs.append(np.repeat(w, n) * size + item)
            pairs = np.unique(np.concatenate(pairs))
            w, item = pairs // size, pairs % size
            keep = (self.width[item] == width) & (self.gram[item] == gram)
            keep[keep] = apart(some[w[keep]], self.prints[item[keep]]) <= RADIUS
            yield from zip((w[keep] + low).tolist(), item[keep].tolist(), strict=True)

    @staticmethod
    def sharing(value: np.ndarray, held: tuple[np.ndarray, np.ndarray], enough: int) -> list[int]:
        """Items of ``held`` that have so many of their shingles, repeated ones counted, among ``value``."""
        sorted_, owner = held
        value = np.unique(value)
        low, high = np.searchsorted(sorted_, value), np.searchsorted(sorted_, value, side="right")
        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
        item, n = np.unique(owner[at], return_counts=True)
        return item[n >= enough].tolist()

    def matches(self, texts: list[str | None], makers: dict[int, Sketcher]) -> list[list[tuple[int, int, int, float]]]:
        """For each text: (item, first word, words, similarity) of each item's best window, the first of equals."""
        words = [words_of(t) for t in texts]
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in words]
        for gram, (sorted_, length) in self.lengths_of.items():
            long = [d for d, w in enumerate(words) if len(w) >= gram]
            value, count = makers.setdefault(gram, Sketcher(gram)).shingles([words[d] for d in long])
            edge = np.r_[0, np.cumsum(count)]
            low, high = np.searchsorted(sorted_, value), np.searchsorted(sorted_, value, side="right")
            hit = np.flatnonzero(high > low)
            first = np.searchsorted(hit, edge)
            for k in np.flatnonzero(first[1:] > first[:-1]).tolist():
                d, own = long[k], hit[first[k]:first[k + 1]]
                # the lengths of the items that each place has a shingle of
                n = (high - low)[own]
                lengths = length[np.repeat(low[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                places = np.repeat(own - edge[k], n)
                for size, there in zip(*np.unique(lengths, return_counts=True), strict=True):
                    if there >= needed(int(size), self.least):
                        self._windows(words[d], value[edge[k]:edge[k + 1]], places[lengths == size], gram, int(size), best[d])
        return [[(item, s, n, -similar) for item, (similar, s, n) in sorted(found.items())] for found in best]

    def _windows(self, words: list[str], value: np.ndarray, own: np.ndarray, gram: int, n: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Look at the windows of ``n`` shingles; ``own``: places of shingles that items of that length have."""
        width, enough = min(n, len(value)), needed(n, self.least)
        start = own[close_runs(own, width, enough)] if width >= enough else own[:0]
        if not len(start):
            return
        # a window that holds enough of them starts at most width - enough places before a run of them
        start = np.unique(start[:, None] - np.arange(width - enough + 1))
        start = start[(start >= 0) & (start + width <= len(value))]
        start = start[np.searchsorted(own, start + width) - np.searchsorted(own, start) >= enough]
        by_count = width < n or self.exact  # else only for items with repeated shingles
        held = (self.owned if by_count else self.repeating)[gram, n]
        near = [(w, i) for w, s in enumerate(start.tolist()) for i in self.sharing(value[s:s + width], held, enough)] if len(held[0]) else []
        if not by_count:
            near += self.within(fingerprints(value, start, width), gram, n)
        for w, i in near:
            s, item = int(start[w]), self.ids[i]
            if item in best and (best[item][0], best[item][1]) <= (-1.0, s):
                continue
            if i not in self.counts:
                self.counts[i] = shingle_counts(self.words[i])
            similar = weighted_similarity(shingle_counts(words[s:s + width + gram - 1]), self.counts[i])
            if similar >= self.least:
                best[item] = min(best.get(item, (0.0, 0, 0)), (-similar, s, width + gram - 1))


class Sieve:
    """A bitmap of the shingles of all items, and the lengths of items."""

    def __init__(self, bits: int, slots: dict[int, int], lengths: list[tuple[int, int]], least: float):
        self.bits, self.least = bits, least
        self.lengths = {g: sorted((needed(n, least), n) for h, n in lengths if h == g) for g in sorted({g for g, _ in lengths})}
        self.map = np.zeros(1 << max(bits - 6, 0), dtype=np.uint64)
        for slot, word in slots.items():
            self.map[slot] = word

    def passes(self, texts: list[str | None], makers: dict[int, Sketcher]) -> np.ndarray:
        """Could the text hold an item?"""
        out, words = np.zeros(len(texts), dtype=bool), [words_of(t) for t in texts]
        for gram, lengths in self.lengths.items():
            long = [d for d, w in enumerate(words) if len(w) >= gram]
            value, count = makers.setdefault(gram, Sketcher(gram)).shingles([words[d] for d in long])
            place = value >> np.uint64(64 - self.bits)
            hit = np.flatnonzero((self.map[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
            edge = np.r_[0, np.cumsum(count)]
            first = np.searchsorted(hit, edge)
            for k in np.flatnonzero(first[1:] - first[:-1] >= lengths[0][0]).tolist():
                own = hit[first[k]:first[k + 1]]
                out[long[k]] |= any(
                    len(close_runs(own, min(n, int(count[k])), enough)) for enough, n in lengths[:bisect_right(lengths, (len(own), float("inf")))])
        return out


def make_sieve(items: DataFrame, bits: int, least: float) -> Sieve:
    """``items``: id, text. At most 2^(bits - 6) numbers and the lengths of items reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(SHINGLE)
        for batch in batches:
            words = [w for w in map(words_of, batch.column("text").to_pylist()) if w]
            value, count = maker.shingles(words)
            place = np.unique(value >> np.uint64(64 - bits))
            slot, first = np.unique(place >> np.uint64(6), return_index=True)
            word = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(slot) else place
            size = sorted({(min(SHINGLE, len(w)), int(n)) for w, n in zip(words, count, strict=True)})
            gram = [0] * len(slot) + [g for g, _ in size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int32()), pa.array([*slot.tolist(), *(n for _, n in size)], pa.int64()),
                 pa.array([*word.view(np.int64).tolist(), *[0] * len(size)], pa.int64())], names=["gram", "slot", "word"])

    rows = items.select("text").mapInArrow(mark, "gram int, slot long, word long").groupBy("gram", "slot").agg(F.bit_or("word").alias("word")).collect()
    slots = {r["slot"]: r["word"] % (1 << 64) for r in rows if r["gram"] == 0}
    return Sieve(bits, slots, [(r["gram"], r["slot"]) for r in rows if r["gram"]], least)


class Benchmark:
    """The items as a table in blocks, and their sieve."""

    def __init__(self, items: DataFrame, item_id: str, text: str, least: float, exact: bool):
        self.least, self.exact = least, exact
        size = F.regexp_count(F.col(text), F.lit(r"[\p{L}\p{N}_]+")) + 1  # about the number of words
        self.items, seen = cut(
            items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")),
            F.coalesce(F.sum(size), F.lit(0)).alias("words"))
        self.blocks = max(1, -(-seen["words"] // BLOCK_WORDS))
        self.sieve = make_sieve(self.items, min(MOST_BITS, max(16, (64 * seen["words"]).bit_length())), least)

    def sift(self, docs: DataFrame, text: str, flag: str) -> DataFrame:
        """``docs`` plus ``flag``, a new column: could the row hold an item?"""
        sieve = self.sieve

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            makers: dict[int, Sketcher] = {}
            for batch in batches:
                texts = batch.column(text)
                passed = [sieve.passes(texts.slice(low, 128).to_pylist(), makers) for low in range(0, batch.num_rows, 128)]
                flags = pa.array(np.concatenate(passed) if passed else [], pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, flags], names=[*batch.schema.names, flag])

        return docs.mapInArrow(test, docs.select("*", F.lit(True).alias(flag)).schema)

    def search(self, rows: DataFrame, chars: int) -> DataFrame:
        """Matches of ``rows`` (number, text), a row per row and item: its best window."""
        least, exact, cells = self.least, self.exact, max(1, -(-chars // CELL_CHARS))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                index, makers = Index(list(zip(right["id"].to_pylist(), right["text"].to_pylist(), strict=True)), least, exact), {}
                for low in range(0, left.num_rows, 128):
                    some = left.slice(low, 128)
                    matches = index.matches(some["text"].to_pylist(), makers)
                    found += [(n, *m) for n, ms in zip(some["number"].to_pylist(), matches, strict=True) for m in ms]
            columns = list(zip(*found, strict=True)) or [()] * 5
            return pa.Table.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.float64()], strict=True)],
                names=["number", "item_id", "word_start", "n_words", "similarity"])

        def every(n: int):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        left = rows.select("number", "text", F.pmod(F.xxhash64("number"), F.lit(cells)).cast("int").alias("cell"), every(self.blocks).alias("block"))
        right = self.items.select("id", "text", every(cells).alias("cell"), F.pmod(F.xxhash64("id", "text"), F.lit(self.blocks)).cast("int").alias("block"))
        met = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(meet, MATCHES)
        best = F.min(F.struct((-F.col("similarity")).alias("s"), "word_start", "n_words")).alias("b")
        return met.groupBy("number", "item_id").agg(best).select(
            "number", "item_id", "b.word_start", "b.n_words", (-F.col("b.s")).alias("similarity"))


def find_contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", least: float = 0.8, exact: bool = False) -> DataFrame:
    """doc_id, item_id, word_start, n_words, similarity: each item that a document holds, at its best window.

    Texts and items are compared as words of letters, digits and underscores in
    lower case. Null items, items without words and without an id take no part;
    null and empty documents hold none. A document shorter than an item is one
    window. Each row of ``docs`` is answered, a row with a null id with a null
    id. Items with the same id count as one item, the best window of any of
    them. The radius is made for a ``least`` of 0.8 or more; below, ask for ``exact``.
    """
    bench = Benchmark(items, item_id, item_text, least, exact)
    rows = bench.sift(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), "text", "maybe")
    some, seen = cut(
        rows.where("maybe").select("id", "text", F.monotonically_increasing_id().alias("number")),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    found = bench.search(some.select("number", "text"), seen["chars"])
    return found.join(some.select("id", "number"), "number").select(
        F.col("id").alias(doc_id), "item_id", "word_start", "n_words", "similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      least: float = 0.8, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are."""
    bench = Benchmark(items, item_id, item_text, least, exact)
    number, maybe = fresh(docs, "__number", "__maybe")
    sifted = bench.sift(docs.withColumn(number, F.monotonically_increasing_id()), text, maybe)
    rows, seen = cut(sifted, F.coalesce(F.sum(F.when(F.col(maybe), F.length(text))), F.lit(0)).alias("chars"))
    some = rows.where(F.col(maybe)).select(F.col(number).alias("number"), F.col(text).alias("text"))
    held = bench.search(some, seen["chars"]).select(F.col("number").alias(number)).distinct()
    return rows.join(held, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
