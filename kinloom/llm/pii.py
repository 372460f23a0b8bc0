r"""Personal data: patterns, and terms that give a protected entity away.

The values that the patterns find (addresses, ips, cards, phones) are protected
entities. How strongly a term reveals one is estimated from the corpus: of N
documents, n(e) hold the entity, n(t) hold the term and n(e, t) have the term
within ``NEAR`` words of the entity, then

    disclosure = PMI(e; t) / IC(e) = 1 + log(n(e, t) / n(t)) / -log(n(e) / N)

which is 1 if the term occurs with the entity only, and 0 if it tells nothing.
Terms are removed from ``REMOVE`` on and generalised from ``GENERALISE`` on,
wherever they occur, if unrelated texts bear witness. A text is known by the
``SKETCH`` smallest hashes of its words and word pairs; texts are related if the
similarity of these sets, estimated from the smallest hashes of both, reaches
``RELATED``. The longest text behind a term is the first witness, the longest
that is not related to it the next, and so on until there are ``SUPPORT``. Any
number of near copies of a text is one witness, and neither they nor further
unrelated texts put another one out. Copies of a text count alike in all of the
numbers, and as one text.

A term is a word of three letters or more, with marks, inner hyphens and inner
apostrophes; what stands between apostrophes counts as a term of its own as well.

All of it is DataFrame expressions. The patterns are the contract's, written so
that they never look at a character twice: a run of characters is taken whole,
and only where a run begins (or a match ended).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fresh
from kinloom.operators.lineage import cut

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM_START, TERM_END = r"(?<![^\s(\[\"'’«])", r"(?=[\s.,;:!?)\]\"'’»]|$)"
TERM = TERM_START + r"(?=\p{L}(?:[\p{M}'’‐-]*+\p{L}){2})\p{L}[\p{L}\p{M}]*+(?:['’‐-]\p{L}[\p{L}\p{M}]*+)*+" + TERM_END
NEAR, SUPPORT = 8, 3
SKETCH, RELATED = 64, 0.4
GENERALISE, REMOVE = 0.85, 0.95
SMALL = 200_000  # rows that may be broadcast
SPAN = "struct<start:int,end:int,kind:int,value:string>"
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def sums_before(steps: Column) -> Column:
    """For each element of a non-empty int array the sum of those before it, without adding all anew each time."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def run(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / CHUNK).cast("int")), lambda c: total(F.slice(a, c * CHUNK + 1, CHUNK)))
        return let(chunks, lambda s: let(F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))), lambda heads: F.transform(
            a, lambda _, i: heads[(i / CHUNK).cast("int")] + total(F.slice(a, (i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)))))

    return let(steps, run)


def matches(text: Column, pattern: Column, kind: Column, gate: Column) -> Column:
    """Spans of all matches, leftmost and non-overlapping; ``gate`` is false only where there is none."""

    def place(v: Column) -> Column:
        found, parts = v["f"], v["p"]
        steps = F.transform(found, lambda x, i: F.length(parts[i]) + F.length(x))
        return let(sums_before(steps), lambda before: F.transform(found, lambda x, i: F.struct(
            (before[i] + F.length(parts[i])).alias("start"), (before[i] + F.length(parts[i]) + F.length(x)).alias("end"),
            kind.alias("kind"), x.alias("value"))))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("p"))
    some = let(both, lambda v: F.when(F.size(v["f"]) > 0, place(v)))
    return F.coalesce(F.when(gate, some), F.array().cast(f"array<{SPAN}>"))


def passes_luhn(digits: Column) -> Column:
    def weigh(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            n = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (1 + i % 2)
            return acc + F.when(n > 9, n - 9).otherwise(n)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0

    return let(digits, weigh)


def base_spans(text: Column) -> Column:
    """All spans of the four patterns that pass their checks, by start, then kind."""
    gates = {
        "email": text.contains("@"), "phone": text.contains("+"),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    }

    def digits(x: Column) -> Column:
        return F.regexp_replace(x["value"], "[^0-9]", "")

    def card(x: Column) -> Column:
        return F.when(F.length(digits(x)).between(14, 19), passes_luhn(digits(x))).otherwise(False)

    checks = {
        "ip": lambda x: x["value"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"), "card": card,
        "phone": lambda x: F.length(digits(x)).between(10, 15),
    }
    found = []
    for number, kind in enumerate(KINDS, 1):
        spans = matches(text, F.lit(PATTERNS[kind]), F.lit(number), gates[kind])
        found.append(F.filter(spans, checks[kind]) if kind in checks else spans)
    return F.array_sort(F.concat(*found))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def with_parts(found: Column) -> Column:
    """Terms, and for those with apostrophes also what stands between them."""
    def parts(w: Column) -> Column:
        return F.filter(F.split(w, "['’]"), lambda p: p.rlike(r"(?:\p{L}\P{L}*+){3}"))

    return let(found, lambda f: F.concat(f, F.flatten(F.transform(F.filter(f, lambda w: w.contains("'") | w.contains("’")), parts))))


def words_of(text: Column) -> Column:
    """All terms of a text, repeated ones too."""
    return with_parts(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def known_by(found: Column) -> Column:
    """What a text is known by, from its terms in lower case."""
    both = F.concat(
        F.transform(found, lambda w: F.xxhash64(w)), F.transform(found, lambda w, i: F.xxhash64(w, F.try_element_at(found, i + 2))))
    return F.struct(F.size(found).alias("words"), F.slice(F.array_sort(F.array_distinct(both)), 1, SKETCH).alias("hashes"))


def spots(texts: DataFrame) -> DataFrame:
    """(key, witness, spots): what a text is known by, and for each span its value and the ``NEAR`` terms on either side.

    One column after the other, each used more than once, so that none is worked out anew inside another.
    """
    s, t, has = F.col("s"), F.col("t"), F.size("s") > 0
    # terms that start before a span: a running count over the starts of both
    marks = F.array_sort(F.concat(
        F.transform(s, lambda x, i: F.struct(x["start"].alias("at"), F.lit(0).alias("term"), i.alias("no"))),
        F.transform(t, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("term"), F.lit(-1).alias("no")))))
    counted = F.arrays_zip(F.col("marks").alias("mark"), sums_before(F.transform("marks", lambda m: m["term"])).alias("n"))
    before = F.transform(F.filter(counted, lambda c: c["mark"]["no"] >= 0), lambda c: c["n"])

    def near(x: Column, i: Column) -> Column:
        n = F.col("before")[i]
        first = F.greatest(n - NEAR, F.lit(0))
        # a term can start with an address, and no other can start inside a span
        after = F.slice(F.filter(F.slice(t, n + 1, F.lit(NEAR + 1)), lambda y: y["start"] >= x["end"]), 1, NEAR)
        return F.struct(F.lower(x["value"]).alias("entity"), F.concat(F.slice(t, first + 1, n - first), after).alias("terms"))

    return (
        texts.select("text", base_spans(F.col("text")).alias("s"))
        .select("text", "s", matches(F.col("text"), F.lit(TERM), F.lit(0), has).alias("t"))
        .select("text", "s", "t", F.when(has, marks).alias("marks"))
        .select("text", "s", "t", F.when(has, before).alias("before"), F.transform(t, lambda x: F.lower(x["value"])).alias("words"))
        .select(_key(F.col("text")).alias("key"), F.when(has, known_by(F.col("words"))).alias("witness"), F.transform(s, near).alias("spots")))


def related(a: Column, b: Column) -> Column:
    """Whether the sets behind two sketches are similar."""
    lowest = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return let(lowest, lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) >= RELATED * F.size(u))


def borne_out(rows: DataFrame, witnesses: DataFrame, support: int) -> DataFrame:
    """The (entity, term) of ``rows`` (entity, term, key) that so many unrelated texts bear out; ``witnesses`` are (key, witness)."""
    left = rows.join(witnesses, "key").select("entity", "term", F.struct("witness.words", "key", "witness.hashes").alias("witness"))
    for _ in range(support - 1):
        longest, most = cut(left.groupBy("entity", "term").agg(F.max("witness").alias("longest")))
        left = left.join(_small(longest, 8 * most["rows"]), ["entity", "term"]).where(
            ~related(F.col("witness.hashes"), F.col("longest.hashes"))).drop("longest")
    return left.select("entity", "term").distinct()


def revealing_terms(docs: DataFrame, text: str, support: int = SUPPORT, generalise: float = GENERALISE,
                    remove: float = REMOVE) -> tuple[DataFrame, int] | None:
    """(key, terms), rows: the terms to treat in each text that has any, as written there; terms are (term, kind), kind 6 if removed."""
    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    found, _ = cut(spots(texts.where(F.col("text").rlike("[0-9@]"))))
    near = found.select("key", "witness", F.posexplode("spots").alias("pos", "spot")).select(
        "pos", "spot.entity", "key", "witness",
        F.array_distinct(with_parts(F.transform("spot.terms", lambda t: F.lower(t["value"])))).alias("terms"))
    # a text has one first span in each of its rows
    times = near.where("pos = 0").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    together, _ = cut(
        near.select("entity", "key", F.explode("terms").alias("term"))
        .distinct().join(times, "key"))
    n = texts.count()

    def rows_of(*by: str) -> DataFrame:
        return together.groupBy(*by, "key").agg(F.max("times").alias("times")).groupBy(*by).agg(F.sum("times").alias("n"))

    n_e = near.select("entity", "key").distinct().join(times, "key").groupBy("entity").agg(F.sum("times").alias("n_e")).where(F.col("n_e") < n)

    def disclosure(rows_of_term: str) -> Column:
        return 1 + F.log(F.col("n_et") / F.col(rows_of_term)) / -F.log(F.col("n_e") / F.lit(n))

    # the rows that have the term near any entity are some of those that have it, so common words go here already
    often = together.groupBy("entity", "term").agg(F.count_distinct("key").alias("texts")).where(F.col("texts") >= support).select("entity", "term")
    pairs, _ = cut(
        often.join(rows_of("entity", "term").withColumnRenamed("n", "n_et"), ["entity", "term"]).join(n_e, "entity")
        .join(rows_of("term").withColumnRenamed("n", "n_near"), "term").where(disclosure("n_near") >= generalise))
    # counted for the whole vocabulary whether or not terms are left to judge, so the work grows evenly with the input
    n_t, _ = cut(
        texts.select(F.explode(F.array_distinct(words_of(F.lower("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    telling, some = cut(pairs.join(n_t, "term").select("entity", "term", disclosure("n_t").alias("disclosure")).where(F.col("disclosure") >= generalise))
    behind, _ = cut(together.select("entity", "term", "key").join(_small(telling.select("entity", "term"), some["rows"]), ["entity", "term"]))
    witnesses = near.where("pos = 0").groupBy("key").agg(F.first("witness").alias("witness"))
    told = telling.join(borne_out(behind, witnesses, support), ["entity", "term"]).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    treated, most = cut(told.select("term", F.when(F.col("disclosure") >= remove, 6).otherwise(5).alias("kind")))
    if not most["rows"]:
        return None
    hits = texts.select(_key(F.col("text")).alias("key"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("written")).withColumn(
        "term", F.lower("written"))
    out, seen = cut(
        hits.join(_small(treated, most["rows"]), "term").select("key", F.col("written").alias("term"), "kind").distinct()
        .groupBy("key").agg(F.collect_list(F.struct("term", "kind")).alias("terms")))
    return out, seen["rows"]


def with_spans(docs: DataFrame, text: str = "text", into: str = "spans", **thresholds) -> DataFrame:
    """``docs`` plus all spans by start, then kind: 1 to 4 as in KINDS, 5 a term to generalise, 6 a term to remove.

    Positions are code points, the end is exclusive. Null and empty texts have
    no span. Rows stay as they are; a column named ``into`` gives way.
    """
    told = revealing_terms(docs, text, **thresholds)
    base = base_spans(F.col(f"`{text}`"))
    if told is None:
        return docs.withColumn(into, base)
    key, terms = fresh(docs, "__key", "__terms")
    found, rows = told
    joined = docs.withColumn(key, _key(F.col(text))).join(
        _small(found.select(F.col("key").alias(key), F.col("terms").alias(terms)), rows), key, "left")
    # longer ones first, as a term may begin another
    words = F.array_join(F.transform(F.array_sort(F.transform(terms, lambda t: F.struct(
        (-F.length(t["term"])).alias("n"), t["term"].alias("term")))), lambda t: t["term"]), "|")
    pattern = F.concat(F.lit(TERM_START + "(?:"), F.coalesce(words, F.lit("")), F.lit(")" + TERM_END))
    spans = matches(F.col(text), pattern, F.lit(5), F.col(terms).isNotNull())
    kinds = F.map_from_entries(F.col(terms))
    spans = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.coalesce(kinds[s["value"]], F.lit(5)).alias("kind"), s["value"].alias("value")))
    return joined.withColumn(into, F.array_sort(F.concat(base, spans))).drop(key, terms)


def digest_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term", "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"] - 1], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_term, one row per row of ``docs``."""
    (into,) = fresh(docs, "__spans")
    found = with_spans(docs.select(doc_id, text), text, into).select(doc_id, into)

    def count(number: int) -> Column:
        return F.size(F.filter(into, lambda s: s["kind"] == number)).cast("long")

    return found.select(
        doc_id,
        *[count(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS, 1)],
        F.sha2(digest_text(F.filter(into, lambda s: s["kind"] < 5)), 256).alias("base_sha256"),
        digest_text(F.col(into)).alias("spans"),
        F.size(F.filter(into, lambda s: s["kind"] > 4)).cast("long").alias("n_term"))


def cleaned(text: Column, spans: Column) -> Column:
    """The text with each span replaced: values by their kind, terms by [NAME] or [TERM], or by nothing."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def label(s: Column) -> Column:
        general = F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        return F.when(s["kind"] < 5, labels[s["kind"] - 1]).when(s["kind"] == 5, general).otherwise("")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        fresh_ = F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))
        return F.when(F.size(done) == 0, F.array(fresh_)).when(
            s["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(fresh_)))

    merged = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,label:string>>"), merge)

    def rebuild(m: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            since = F.when(i == 0, 0).otherwise(m[i - 1]["end"])
            return F.concat(F.substring(text, since + 1, s["start"] - since), s["label"])

        return F.concat(F.array_join(F.transform(m, piece), ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(merged, rebuild))


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with personal data and revealing terms taken out of the text; every row and column stays."""
    (into,) = fresh(docs, "__spans")
    found = with_spans(docs, text, into, **thresholds)
    return found.withColumn(text, cleaned(F.col(text), F.col(into))).select(*[F.col(f"`{c}`") for c in docs.columns])
