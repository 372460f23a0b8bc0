from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from kinloom.llm import pii

ODD = [
    None, "", "   ", "a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "300.1.1.1 001.002.003.004 1.2.3.0000000000000000000004",
    "4041894974608795 4041-8949-7460-8795 4041 8949 7460 8796", "+1 (489) 555-0950 +1", "é\U0001F600 foo.bar@x.co. x@y",
    "1 " * 20_000, "a" * 100_000, "1" * 30_000, "9.9.9.9 " * 2_000, "a@b@c.de", "+49 30 1234567 ++1234567890123456",
]


def random_texts(n: int) -> list[str]:
    rnd = random.Random(5)
    letters = "ab@.-+ 0123456789()_%\n1234é\U0001F600"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 300))) for _ in range(n)]


def test_base_spans_equal_one_by_one_matching(spark):
    texts = ODD + random_texts(600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.span_digests(docs).collect()}
    for i, text in enumerate(texts):
        kinds = [k for *_, k in brute.base_spans(text)]
        assert rows[i].base_sha256 == brute.base_sha(text), text
        assert [rows[i][f"n_{k}"] for k in brute.KINDS] == [kinds.count(k) for k in brute.KINDS]


def revealing_corpus() -> list[str]:
    rnd = random.Random(1)
    other = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    texts = [f"{other()} Gandalfus mail gandalf@x.org please {other()} the end" for k in range(12)]
    texts += [f"some other mail the please text{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)]
    # copies and near copies of one text are one witness, whatever their number
    base = [other() for _ in range(3)]
    near = [f"{base[0]} {base[1]} changed{chr(97 + k)} {base[2]} Sarumanus sent saruman@z.org now" for k in range(20)]
    return [*texts, *["Elrondus wrote elrond@y.org today"] * 50, *near]


def test_terms_that_reveal_an_entity_are_found_and_common_ones_are_not(spark):
    docs = spark.createDataFrame(list(enumerate(revealing_corpus())), "doc_id long, text string")
    told = {w for r in pii.with_spans(docs).collect() for w in [s.value for s in r.spans if s.kind > 4]}
    assert "Gandalfus" in told
    assert not told & {"mail", "please", "the", "Elrondus", "wrote", "Sarumanus"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "gandalf" not in clean[0].lower() and "[EMAIL]" in clean[0] and "please" in clean[0]
    assert clean[120] == "Elrondus wrote [EMAIL] today"


def test_more_texts_and_near_copies_put_no_term_out(spark):
    """Long unrelated texts of one language share their smallest hashes; near copies of a witness change nothing."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijkl") for _ in range(5)) for _ in range(1500)]
    other = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [f"{other(200)} Gandalfus at gandalf@x.org {other(200)}" for _ in range(500)]
    base = other(60)
    texts += [f"{other(30)} Bilbous at bilbo@x.org {other(30)}" for _ in range(10)]
    texts += [f"{base} copy{chr(97 + k // 26)}{chr(97 + k % 26)} Bilbous at bilbo@x.org {other(1)}" for k in range(80)]
    texts += [f"{base} copy{chr(97 + k // 26)}{chr(97 + k % 26)} Sarumanus at saruman@x.org {other(1)}" for k in range(80)]
    texts += [other(20) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {s.value for r in pii.with_spans(docs).collect() for s in r.spans if s.kind > 4}
    assert told == {"Gandalfus", "Bilbous"}


def test_terms_with_marks_hyphens_and_apostrophes(spark):
    names = ["Jean-Luc", "O'Brien", "D’Artagnan", "हिन्दी", "İstanbulus", "Zoe\u0301lla"]
    rnd = random.Random(4)
    other = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    texts = [f"{other()} {name} at who{i}@x.org {other()}" for i, name in enumerate(names) for _ in range(5)]
    texts += [f"{other()} Gandalfus at g@x.org {other()}" for _ in range(5)] + [f"{other()} at Gandalfus's"] + [other() for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: [s.value for s in r.spans if s.kind > 4] for r in pii.with_spans(docs).collect()}
    for i, name in enumerate(names):
        assert name in rows[5 * i]
    assert any(v.startswith("Gandalfus") for v in rows[5 * len(names) + 5])


def test_terms_near_a_span_are_the_eight_words_on_either_side(spark):
    word = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03d}")
    left, right = [word(k) * 20 for k in range(12)], [word(k) * 20 for k in range(12, 24)]
    text = " ".join([*left, "12 -- " * 50, "foo.bar@x.org", "9.9.9.9", *right])
    row = pii.spots(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.entity, [t.value for t in s.terms]) for s in row.spots] == [
        ("foo.bar@x.org", left[-8:] + right[:8]), ("9.9.9.9", [*left[-7:], "foo", *right[:8]])]


def test_base_spans_stay_when_terms_are_added(spark):
    texts = revealing_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.span_digests(docs).collect():
        assert r.base_sha256 == brute.base_sha(texts[r.doc_id])


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(revealing_corpus())), "doc_id long, text string")
    want = sorted(map(str, pii.span_digests(docs).collect()))
    monkeypatch.setattr(pii, "SMALL", 0)
    assert sorted(map(str, pii.span_digests(docs).collect())) == want


def test_empty_table_repeated_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.span_digests(empty).count() == 0
    twice = spark.createDataFrame([(1, "a@b.de", "x"), (1, "a@b.de", "x"), (None, None, None)], "doc_id long, text string, spans string")
    assert pii.span_digests(twice).count() == 3
    clean = pii.sanitise(twice)
    assert clean.columns == ["doc_id", "text", "spans"]
    assert sorted(clean.collect(), key=str) == sorted([(1, "[EMAIL]", "x"), (1, "[EMAIL]", "x"), (None, None, None)], key=str)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.de")], "doc_id long, text string")
    plan = pii.span_digests(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_running_sums(spark):
    row = spark.range(1).select(pii.sums_before(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("int"))).alias("s")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1000)]
