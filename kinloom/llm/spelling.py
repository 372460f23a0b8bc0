"""Spelling variants: words one edit apart, found by FM-index search schemes.

One error leaves one half of a word untouched. So two searches are complete:
first half exact, then on to the right with one error, and second half exact,
then on to the left with one error. Both halves end at a delimiter, so each
search walks in one direction from one end of the word, and the two directions
of the index are two indexes, one over the words, one over the words reversed.

An index holds its words between delimiters in the sort order of their suffixes.
The words that start (or end) with what has been read are one interval of that
order; reading a letter maps the interval's borders to the ranks of that letter.
All queries of a task move in step, as arrays of intervals.

Spark deals words and queries out by the exact half. A half that many words share
is cut into a grid of word blocks and query blocks, so a task never gets more
than a few blocks; no pair leaves a task, only counts and the best neighbour.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.urls import lower_ascii
from kinloom.operators.lineage import cut

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
SLIP = 199  # one run in so many loses a letter
BLOCK = 20_000  # words of an index, queries of a grid cell
FOUND = "word string, n_near long, near_n long, near string"


# ---- vocabulary

def words_of(docs: DataFrame, doc_id: str, text: str, letters: int) -> DataFrame:
    """One row ``word`` per run of letters, A-Z in lower case; where SLIP divides the crc32 of ``id:run``, less one letter."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{letters},}}"), F.lit(0))  # shorter runs make no word
    rows = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run = lower_ascii(F.col("run"))
    rows = rows.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % SLIP == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least so many letters that occur at least so often."""
    words = words_of(docs, doc_id, text, letters).where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


# ---- index

class Index:
    """FM-index of distinct words, read from their first letter on.

    Row r of the order is a suffix of a reversed word; equal suffixes stand in
    the order of their words. ``ranks`` holds (letter, row) of every row's
    preceding letter, sorted; so the position of (c, r) in it is where the suffix
    that c makes longer by one letter has its row. The delimiter is letter 0.
    """

    def __init__(self, words: list[str]):
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.letters, code = np.unique(points, return_inverse=True)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        mirror = code[first[word] + size[word] - 1 - (np.arange(len(points)) - first[word])]
        # every reversed word, then its delimiter
        self.length = len(points) + len(words)
        begin = first + np.arange(len(words))
        text = np.zeros(self.length, dtype=np.int64)
        text[np.arange(len(points)) + word] = mirror + 1
        owner = np.repeat(np.arange(len(words)), size + 1)
        left = np.repeat(begin + size + 1, size + 1) - np.arange(self.length)  # letters up to the end, delimiter included
        rank, step = text, 1
        while step <= size.max(initial=0):  # sort by the first 2, 4, 8, ... letters
            follows = np.zeros(self.length, dtype=np.int64)
            inside = np.flatnonzero(left > step)
            follows[inside] = rank[inside + step] + 1
            _, rank = np.unique(rank * (self.length + 2) + follows, return_inverse=True)
            step *= 2
        # words in the order of the whole reversed word, so that their delimiters' rows are in that order
        by_word = np.argsort(rank[begin], kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[by_word] = np.arange(len(words))
        order = np.lexsort((place[owner], rank))
        before = np.where(order == begin[owner[order]], 0, text[np.maximum(order - 1, 0)])
        self.before = before
        self.word_at = by_word  # delimiter row -> word
        at = np.argsort(before, kind="stable")
        self.ranks = before[at] * (self.length + 1) + at

    def row(self, letter: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ranks, letter * (self.length + 1) + row)

    def code(self, points: np.ndarray) -> np.ndarray:
        """Letters as the index numbers them; -1 for letters it does not have."""
        at = np.minimum(np.searchsorted(self.letters, points), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == points, at + 1, -1) if len(self.letters) else np.full(len(points), -1)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, letter, low, high): each letter that follows a state's interval, with its interval."""
        sigma = len(self.letters)
        wide = high - low > sigma
        some, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        size = (high - low)[some]
        state = np.repeat(some, size)
        rows = np.repeat(low[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
        pair = np.unique(state * (sigma + 1) + self.before[rows])
        pair = np.r_[pair, (many[:, None] * (sigma + 1) + np.arange(1, sigma + 1)).ravel()]
        state, letter = pair // (sigma + 1), pair % (sigma + 1)
        state, letter = state[letter > 0], letter[letter > 0]
        a, b = self.row(letter, low[state]), self.row(letter, high[state])
        full = b > a
        return state[full], letter[full], a[full], b[full]

    def one_error(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the index): all pairs one edit apart that agree in the query's first ``half`` letters."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(size) - size
        code = np.r_[self.code(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)), -1]
        query = np.arange(len(words))
        low, high = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.word_at))  # rows that start with the delimiter

        def read(query, at, low, high):
            """The states after the query's letter at ``at``, and which of them are left."""
            letter = code[first[query] + at]
            a, b = self.row(letter, low), self.row(letter, high)
            keep = np.flatnonzero((letter > 0) & (b > a))
            return keep, a[keep], b[keep]

        out, done = [], np.zeros(0, dtype=np.int64)
        for at in range(int(halves.max(initial=0))):
            short = halves[query] > at
            keep, a, b = read(query[short], at, low[short], high[short])
            query, low, high = np.r_[query[~short], query[short][keep]], np.r_[low[~short], a], np.r_[high[~short], b]
        at = halves[query]
        while len(query):
            # one error here ...
            rest = at < size[query]
            state, letter, a, b = self.children(low, high)
            own = code[first[query[state]] + at[state]]
            other = (letter != own) & rest[state]
            spent = [np.r_[query[rest], query[state], query[state][other]],  # letter left out, letter put in, letter replaced
                     np.r_[at[rest] + 1, at[state], at[state][other] + 1],
                     np.r_[low[rest], a, a[other]], np.r_[high[rest], b, b[other]]]
            # ... then no other
            while len(spent[0]):
                q, p, lo, hi = spent
                end = p == size[q]
                lo_end, hi_end = self.row(np.zeros(end.sum(), dtype=np.int64), lo[end]), self.row(np.zeros(end.sum(), dtype=np.int64), hi[end])
                hit = hi_end > lo_end
                out.append(np.unique(q[end][hit] * len(self.word_at) + self.word_at[lo_end[hit]]))
                q, p, lo, hi = q[~end], p[~end], lo[~end], hi[~end]
                keep, lo, hi = read(q, p, lo, hi)
                spent = [q[keep], p[keep] + 1, lo, hi]
            # ... or none yet
            query, at, low, high = query[rest], at[rest], low[rest], high[rest]
            keep, low, high = read(query, at, low, high)
            query, at = query[keep], at[keep] + 1
        pairs = np.unique(np.concatenate(out)) if out else done
        return pairs // max(len(self.word_at), 1), pairs % max(len(self.word_at), 1)


# ---- search

def search(cell: pa.Table) -> pa.Table:
    """Near words of the queries of one grid cell: their number, and the best one."""
    rows = list(zip(cell["word"].to_pylist(), cell["n"].to_pylist(), cell["room"].to_pylist(), cell["asks"].to_pylist(), strict=True))
    mirrored = bool(cell["mirrored"][0].as_py())
    count = {word: n for word, n, _, asks in rows if not asks}
    meets = {(word, room) for word, _, room, asks in rows if not asks}  # a cell may have several rooms, a pair meets in one
    asked, held, out = [(word, room) for word, _, room, asks in rows if asks], list(count), []
    if held and asked:
        index = Index([w[::-1] for w in held] if mirrored else held)
        for low in range(0, len(asked), BLOCK // 8):  # bounds the states that move in step
            some = asked[low:low + BLOCK // 8]
            half = np.fromiter(((len(word) + mirrored) // 2 for word, _ in some), dtype=np.int64, count=len(some))
            query, found = index.one_error([w[::-1] if mirrored else w for w, _ in some], half)
            best: dict[int, tuple[int, int, str]] = {}
            for i, j in zip(query.tolist(), found.tolist(), strict=True):
                (word, room), near = some[i], held[j]
                if (near, room) not in meets or (mirrored and near.startswith(word[:len(word) // 2])):
                    continue  # met in another room, or by the search from the front
                number, n, first = best.get(i, (0, 0, ""))
                better = count[near] > n or (count[near] == n and near < first)
                best[i] = (number + 1, count[near], near) if better else (number + 1, n, first)
            out += [(some[i][0], *b) for i, b in best.items()]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
        names=["word", "n_near", "near_n", "near"])


def cells(words: DataFrame, letters: int, block: int) -> DataFrame:
    """Rows word, n, mirrored, asks, room and cell: every word as a query of its own half, and as a word held under each half that may ask for it.

    A query meets a word in one room: their half, the query's block, the word's block.
    A query of L letters asks by its first L // 2, from the back by its last
    (L + 1) // 2 letters; a word is near queries of one letter more or less too.
    """
    length, sides = F.length("word"), []
    for mirrored in (False, True):
        turned, more = (F.reverse("word"), 1) if mirrored else (F.col("word"), 0)

        def half(size: Column, turned=turned, more=more) -> Column:
            return F.substring(turned, F.lit(1), F.floor((size + more) / 2).cast("int"))

        queries = words.select("word", "n", F.lit(mirrored).alias("mirrored"), F.lit(True).alias("asks"), half(length).alias("half"))
        halves = F.array_distinct(F.array(*[F.when(size >= letters, half(size)) for size in (length - 1, length, length + 1)]))
        held = words.select("word", "n", F.lit(mirrored).alias("mirrored"), F.lit(False).alias("asks"), F.explode(halves).alias("half"))
        held = held.where(F.col("half").isNotNull())
        sides += [queries, held]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])
    rows, seen = cut(rows)
    crowded = rows.groupBy("mirrored", "half").agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("h")).select(
        "mirrored", "half", F.ceil(F.greatest("a", "h") / block).cast("long").alias("wide")).where("wide > 1")  # at most a row per block
    wide = F.coalesce("wide", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("word"), wide)
    rows = rows.join(crowded, ["mirrored", "half"], "left").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)))
    query_block = F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))
    word_block = F.when(F.col("asks"), F.col("other")).otherwise(F.col("own"))
    parts = max(1, -(-seen["rows"] // (2 * block)))
    return rows.select("word", "n", "mirrored", "asks", F.concat_ws(" ", "half", query_block, word_block).alias("room")).withColumn(
        "cell", F.pmod(F.xxhash64("room"), F.lit(parts)))


def variants(words: DataFrame, letters: int = LEAST_LETTERS, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, n, form, form_n, root, n_near for every row of ``words`` (word, n; words distinct, of at least ``letters`` code points).

    Near words differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word of largest n, the smallest in code-point order of
    equals, if that n is at least ``times`` (2 or more) its own; root follows the
    forms to the last. Forms rise in n, so a root is reached.
    """
    words, _ = cut(words.select("word", "n"))
    found = cells(words, letters, block).groupBy("mirrored", "cell").applyInArrow(search, FOUND)
    # n first, then the smaller word: the largest -n is the smallest n, so the least of (-n, word) is wanted
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    formed = (-F.col("best.n")) >= F.lit(times) * F.col("n")
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n"))
    named, _ = cut(named)
    # every round follows the roots found so far, so the way doubles
    roots, _ = cut(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots, seen = cut(
            roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            F.count_if("moved").alias("moved"))
        roots = roots.drop("moved")
        if not seen["moved"]:
            break
    return named.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT,
                      times: int = TIMES) -> DataFrame:
    """The words of the documents with their near words, forms and roots; see ``vocabulary`` and ``variants``.

    Null and empty texts have no words, a null id counts as an empty one, rows
    that repeat count as often as they stand there; other columns play no part.
    """
    return variants(vocabulary(docs, doc_id, text, letters, count), letters, times)
