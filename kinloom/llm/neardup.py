"""Near-duplicate documents by min-max hashing.

Each of ``HASHES`` permutations of the shingle hashes is evaluated once and
gives two signature values, its minimum and its maximum; each agrees between
two documents with the probability of their Jaccard similarity. ``ROWS`` values
make a band; documents that share a band are candidates. With 95 permutations
and 5 rows, 38 bands find a pair at 0.8 with probability 1 - 3e-7.

Links are confirmed on the full sets of shingles, as words, not hashes. A bucket
never yields all its pairs. Exact copies are one node from the start. Then every
node meets the smallest id of any of its buckets, and the confirmed links are
joined to components; nodes that are still apart from the smallest id of a
bucket meet it; and last, members of different components in a bucket meet,
which completes it. Members of one component need no further comparison,
whatever the size of the group. Before texts are fetched, pairs whose sizes or
signatures (four bits of each value) rule out the similarity are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.lineage import cut

HASHES, ROWS = 95, 5
BANDS = 2 * HASHES // ROWS
WORDS = -(-2 * HASHES // 16)
APART_MOST = 63  # differing four-bit values of the 190; five deviations more than a similarity of 0.8 gives
SURE_SIZE = 32  # smaller sets are not judged by their signatures
KNOWN_WORDS = 400_000
SKETCH_WORDS = 100_000  # hashes of words that a sketching worker keeps between slices
SLICE_ROWS, SLICE_BYTES = 128, 1 << 20  # documents, and bytes of their texts, worked on at once; a longer text is a slice of its own
DIFF_WORDS = 16  # longs in a bitmap of differences
SMALL = 200_000  # ids that may be broadcast
MIX = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "id long, key binary, n_shingles long, bands array<long>, bits array<long>"


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = rng.integers(0, 2**63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, HASHES), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Sketcher:
    def __init__(self, n: int, keep: int = KNOWN_WORDS):
        self.n, self.keep, self.known = n, keep, {}
        self.times, self.masks = _seeds()

    def shingles(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all documents that have words, one after the other, and how many each has."""
        flat = [w for d in docs for w in d]
        if len(self.known) > self.keep:
            self.known = {}
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(flat) - self.known.keys())
        word = np.fromiter(map(self.known.__getitem__, flat), dtype=np.uint64, count=len(flat))
        size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        end = np.repeat(np.cumsum(size), size)
        value, at = np.zeros(len(word), dtype=np.uint64), np.arange(len(word))
        for k in range(self.n):
            inside = at + k < end
            value[inside] = mixed(value[inside] * MIX + word[at[inside] + k] + np.uint64(k + 1))
        full = at + self.n <= end
        short = (size < self.n) & (size > 0)
        full[(np.cumsum(size) - size)[short]] = True
        return value[full], np.where(size >= self.n, size - self.n + 1, (size > 0).astype(np.int64))

    def signatures(self, value: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(documents, 2 * HASHES): the minima, then the maxima. Every count is positive."""
        out = np.empty((len(count), 2 * HASHES), dtype=np.uint64)
        start = np.cumsum(count) - count
        for k in range(HASHES):
            h = (value ^ self.masks[k]) * self.times[k]
            out[:, k] = np.minimum.reduceat(h, start)
            out[:, HASHES + k] = np.maximum.reduceat(h, start)
        return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    key = np.zeros((len(signature), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    rows = signature.reshape(-1, BANDS, ROWS)
    for r in range(ROWS):
        key = mixed(key * MIX + rows[:, :, r])
    return key.view(np.int64)


def bit_words(signature: np.ndarray) -> np.ndarray:
    """Four bits of every value, packed into 64-bit words."""
    bits = np.zeros((len(signature), WORDS * 16), dtype=np.uint8)
    bits[:, :2 * HASHES] = mixed(signature) & np.uint64(15)
    return (bits[:, ::2] << 4 | bits[:, 1::2]).view(np.int64)


def _lists(rows: np.ndarray, whole: np.ndarray) -> pa.Array:
    """A list column: a row of ``rows`` where ``whole`` is true, else null."""
    offsets = np.r_[0, np.cumsum(np.where(whole, rows.shape[1], 0))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel(), pa.int64()), mask=pa.array(~whole))


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of at most ``SLICE_ROWS`` texts and ``SLICE_BYTES`` bytes, or one text."""
    low, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > low and (at - low == SLICE_ROWS or held + size > SLICE_BYTES):
            yield low, at - low
            low, held = at, 0
        held += size
    if len(sizes) > low:
        yield low, len(sizes) - low


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(n, SKETCH_WORDS)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
            for low, rows in slices(sizes):
                batch = whole.slice(low, rows)
                docs = [words_of(t) for t in batch.column("text").to_pylist()]
                value, count = maker.shingles(docs)
                edge = np.r_[0, np.cumsum(count)]
                distinct = [len(np.unique(value[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                has = count > 0
                if has.any():
                    sign = maker.signatures(value, count[has])
                else:
                    sign = np.zeros((0, 2 * HASHES), dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array(distinct, pa.int64()), _lists(band_keys(sign), has),
                     _lists(bit_words(sign), has)], names=["id", "key", "n_shingles", "bands", "bits"])

    return run


def sketches(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """id, key (of the exact text), n_shingles, and bands and bits of the signature, null without words."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("key"),
        F.col(text).alias("text"))
    return rows.mapInArrow(_sketch(n), SKETCH)


def _difference_bits(left: set, right: set) -> tuple[list[int], int]:
    """The shingles that only one of two sets has, hashed into a bitmap of DIFF_WORDS longs; and how many share a bit."""
    only = {xxhash.xxh3_64_intdigest(b" ".join(g), seed) % (64 * DIFF_WORDS) for seed, s in ((0, left - right), (1, right - left)) for g in s}
    mask = sum(1 << k for k in only)
    words = np.frombuffer(mask.to_bytes(8 * DIFF_WORDS, "little"), dtype=np.int64)
    return words.tolist(), len(left ^ right) - len(only)


def _overlap(n: int, differences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, left = None, set()
        for batch in batches:
            sizes, bits, hidden = [], [], []
            for a_text, b_text in zip(batch.column("a_text"), batch.column("b_text"), strict=True):
                text = a_text.as_py()
                if held != text:
                    held, left = text, shingle_set(text, n)
                right = shingle_set(b_text.as_py(), n)
                sizes.append((len(left), len(right), len(left & right)))
                if differences:
                    mask, more = _difference_bits(left, right)
                    bits.append(mask)
                    hidden.append(more)
            columns = [pa.array(c, pa.int64()) for c in list(zip(*sizes, strict=True)) or [()] * 3]
            names = ["a", "b", "n_a", "n_b", "both"]
            if differences:
                columns += [pa.array(bits, pa.list_(pa.int64())), pa.array(hidden, pa.int64())]
                names += ["diff", "hidden"]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=names)

    return run


def overlaps(pairs: DataFrame, docs: DataFrame, n: int, involved: int, differences: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, both): sizes of the full shingle sets and of their intersection, for the pairs (a, b).

    ``docs``: id, text; a pair has a row for each text of its ids. ``involved``
    bounds the ids in the pairs. ``differences`` adds the bitmap of the shingles
    that only one side has, and the number of those that share a bit.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if involved <= SMALL:
        ids = F.broadcast(ids)
    texts = docs.join(ids, "id", "left_semi").distinct()
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    more = ", diff array<long>, hidden long" if differences else ""
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(
        _overlap(n, differences), f"a long, b long, n_a long, n_b long, both long{more}")


def similar(n_a, n_b, both, percent: int):
    return (both > 0) & (100 * both >= percent * (n_a + n_b - both))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over the edges (a, b), for ids that have an edge.

    Every round takes the smallest label among the neighbours, then the label of
    the node that the label names, so far ends come together in few rounds.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state, _ = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = state.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        named = state.select(F.col("id").alias("comp"), F.col("comp").alias("far"))
        state, seen = cut(
            step.join(named, "comp").select("id", "old", F.least("comp", "far").alias("comp")),
            F.count_if(F.col("comp") != F.col("old")).alias("moved"))
        state = state.select("id", "comp")
        if not seen["moved"]:
            return state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id and kept (id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their sets
    of distinct ``n``-word shingles; with fewer than ``n`` words the whole
    sequence is the one shingle. Null, empty and wordless texts have an empty
    set and no link. Rows with a null id are never linked and have a null
    component and kept = true. Rows that repeat an id get the same component as
    long as their texts are equal; further columns are ignored.
    """
    made, _ = cut(sketches(docs, doc_id, text, n))
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    # one node for all copies of a text, named by their smallest id
    nodes, _ = cut(
        made.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("key")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    meta, _ = cut(nodes.groupBy("id").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("texts")))
    known = ["low", "high", "bits", "texts"]

    def facts(side: str) -> DataFrame:
        return meta.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in known])

    def alike(a: str, b: str):
        """False only for pairs that cannot be similar, or are so with a probability below 1e-6."""

        def apart(i: int):
            x = F.col(f"{a}_bits")[i].bitwiseXOR(F.col(f"{b}_bits")[i])
            return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(
                F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x1111111111111111)))

        sizes = (100 * F.col(f"{a}_high") >= percent * F.col(f"{b}_low")) & (100 * F.col(f"{b}_high") >= percent * F.col(f"{a}_low"))
        open_ = (F.col(f"{a}_texts") > 1) | (F.col(f"{b}_texts") > 1) | (F.least(f"{a}_low", f"{b}_low") < SURE_SIZE)
        return sizes & (open_ | (sum((apart(i) for i in range(WORDS)), F.lit(0)) <= APART_MOST))

    def grown(links: DataFrame | None, pairs: DataFrame):
        """Links with those of the pairs (a, b) that are similar; the components, if there are new links."""
        held, met = cut(pairs)
        if not met["rows"]:
            return links, None
        seen, found = cut(
            overlaps(held, whole, n, 2 * met["rows"]), F.count_if(similar(F.col("n_a"), F.col("n_b"), F.col("both"), percent)).alias("new"))
        if not found["new"]:
            return links, None
        new = seen.where(similar(F.col("n_a"), F.col("n_b"), F.col("both"), percent)).select("a", "b").distinct()
        links = new if links is None else links.unionByName(new)
        return links, components(links)

    def placed(groups: DataFrame | None) -> DataFrame:
        """Members of buckets with their components."""
        if groups is None:
            return live.withColumn("comp", F.col("id"))
        return live.join(groups, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    bands = nodes.select("id", F.explode("bands").alias("band"))
    centres = bands.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("top")).where(F.col("centre") != F.col("top"))
    live, _ = cut(bands.join(centres.select("band", "centre"), "band"))
    star = live.where(F.col("id") != F.col("centre")).groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a"))
    links, groups = grown(None, star.join(facts("a"), "a").join(facts("b"), "b").where(alike("a", "b")).select("a", "b"))

    apart = placed(groups)
    centre_comp = apart.where(F.col("id") == F.col("centre")).select("band", F.col("comp").alias("centre_comp")).distinct()
    star = apart.join(centre_comp, "band").where(F.col("comp") != F.col("centre_comp")).select(
        F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links, more = grown(links, star.join(facts("a"), "a").join(facts("b"), "b").where(alike("a", "b")).select("a", "b"))
    groups = groups if more is None else more

    apart = placed(groups)
    shares = apart.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))
    torn = shares.groupBy("band").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    member, rest = cut(apart.join(torn.select("band", "main"), "band"))
    if rest["rows"]:
        # Every member meets the smallest id of its buckets' largest component. What two members x and y share is
        # what both share with that root, as far as they do not lack the same, and what both have beyond it: a
        # bitmap of each one's differences gives an upper bound, which settles most pairs without their texts.
        roots, met = cut(member.groupBy(F.col("id").alias("b")).agg(F.min("main").alias("a")))
        met_root, _ = cut(overlaps(roots, whole, n, 2 * met["rows"], differences=True))
        pivot = met_root.groupBy(F.col("b").alias("id"), F.col("a").alias("pivot")).agg(
            F.max("both").alias("shared"), F.max("n_a").alias("root"), F.first("diff").alias("diff"), F.first("hidden").alias("hidden"),
            F.count(F.lit(1)).alias("rows"))
        pivot = pivot.where("rows = 1").drop("rows")
        added = ["pivot", "shared", "root", "diff", "hidden"]

        def within(a: str, b: str):
            same_differences = sum(
                (F.bit_count(F.col(f"{a}_diff")[i].bitwiseAND(F.col(f"{b}_diff")[i])) for i in range(DIFF_WORDS)), F.lit(0))
            most = F.col(f"{a}_shared") + F.col(f"{b}_shared") - F.col(f"{a}_root") + same_differences + F.least(f"{a}_hidden", f"{b}_hidden")
            single = (F.col(f"{a}_texts") == 1) & (F.col(f"{b}_texts") == 1)
            same = F.coalesce(F.col(f"{a}_pivot") == F.col(f"{b}_pivot"), F.lit(False))
            return ~(single & same) | (100 * most >= percent * (F.col(f"{a}_high") + F.col(f"{b}_high") - most))

        # members outside a bucket's largest component against all members of other components
        member = member.join(meta, "id").join(pivot, "id", "left")
        known = [*known, *added]
        x = member.where(F.col("comp") != F.col("main")).select(
            "band", F.col("id").alias("x"), F.col("comp").alias("x_comp"), *[F.col(c).alias(f"x_{c}") for c in known])
        y = member.select(
            "band", F.col("id").alias("y"), F.col("comp").alias("y_comp"), (F.col("comp") == F.col("main")).alias("y_main"),
            *[F.col(c).alias(f"y_{c}") for c in known])
        across = x.join(y, (x["band"] == y["band"]) & (F.col("x_comp") != F.col("y_comp")) & (F.col("y_main") | (F.col("x") < F.col("y")))
                        & within("x", "y") & alike("x", "y"))
        links, more = grown(links, across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        groups = groups if more is None else more

    if groups is None:
        groups = live.select("id", F.col("id").alias("comp")).distinct()
    of_key = nodes.join(groups, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"))
    return made.select("id", "key", "n_shingles").join(of_key, "key", "left").select(
        F.col("id").alias(doc_id), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce(F.when(F.col("id").isNotNull(), F.col("comp")), F.col("id"))).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(doc_id).isNull() | (F.col(doc_id) == F.col("component_id")))
