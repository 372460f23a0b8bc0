"""Token counts, chat format, page text."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinloom.llm import chat, html, tokens

ODD = [
    None, "", " \n", "ΑΣ ΟΔΟΣ", "İstanbul don't WE'LL <|endoftext|>x<|startoftext|>", "a\x1cb\x85c d　e", "日本語テキスト 12345",
    "é café", "a" * 20_000, "ab" * 5_000, "\U0001F600 ١٢٣ ²½", "<|ENDOFTEXT|> <|endoftext|", "'S 'T it's", "word " * 3_000,
]


def test_token_counts_equal_the_library(spark):
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("abcdeé .,'1\n") for _ in range(200)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    for r in tokens.count_tokens(docs).collect():
        want = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 2048)


def test_token_counts_keep_rows_and_replace_clashing_columns(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, None, None)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int"))
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(r.n_tokens for r in got.collect()) == [0, 2, 2]
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_another_vocabulary_is_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        tokens.Merger(public_tokenizers.path("byte_bpe_50k.json"))


TURNS = [
    (1, 0, "system", "Be \\ brief."), (1, 1, "user", "</s>[INST] <|im_end|>\n<|im_start|>user\n\\<\\[INST]"), (1, 2, "assistant", "[INST]\\"),
    (1, 3, "assistant", ""), (2, 1, "assistant", "é\U0001F600 ok"), (2, 0, "user", None), (None, 0, None, "x"), (3, None, "tool\nx\\n", "<s><<SYS>>"),
    (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", "long " * 30_000), (-7, 0, "user", "</s>[INST] ok [/INST]"),
]


def expected(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = [t for t in turns if t[0] == conv]
        rows.sort(key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t[1:]))
        said = [t[3] or "" for t in rows if t[2] == "assistant"]
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in rows)
        out[conv] = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("rows", [4096, 2])
def test_chats_read_back_exactly(spark, rows, monkeypatch):
    monkeypatch.setattr(chat, "ROWS", rows)
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = chat.format_chats(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.chat_digests(formatted).collect()}
    assert got == expected(TURNS)
    for r in formatted.collect():
        body = r.text
        for control in chat.CONTROL:
            if control not in ("<|im_start|>", "<|im_end|>"):
                assert control not in body
        assert body.count("<|im_start|>") == body.count("<|im_end|>")


def test_chat_pieces_fit_together(spark):
    """Pieces of a conversation that crosses batches: numbers and loss spans count through the whole text."""
    import pyarrow as pa

    rows = [(1, k, ("user", "assistant")[k % 2], f"é{k}") for k in range(10)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows[a:a + 3]]) for a in (0, 3, 6, 9)]
    pieces = [p for b in chat._pieces(iter(batches)) for p in b.to_pylist()]
    assert [p["piece"] for p in pieces] == [0, 1, 2, 3]
    whole = "".join(p["text"] for p in pieces)
    assert [whole[s["start"]:s["end"]] for p in pieces for s in p["loss"]] == [f"é{k}" for k in range(1, 10, 2)]


def test_chats_of_an_empty_table(spark):
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, piece int"))).count() == 0


PAGES = {
    "": "", "plain text only": "plain text only", "<p>Hi</p>": "Hi", "<!-- x": "", "<p a='x>y</p>z": "y z",
    "<article><h1>T</h1><p>a &amp; b<br>c</article><footer>f</footer>": "T a & b c",
    "<nav>m</nav><main><p>One <b>bo</b>ld.</p><div class='ad'>BUY</div><p>Two</p></main><aside>s</aside>": "One bold. Two",
    "<header>Site</header><article><header><h1>Head</h1></header><p>Text &lt;p&gt; 1 < 2</p><form>Name <input></form></article>": "Head Text <p> 1 < 2",
    "<article><p>Body</p><section class='comments'><p>nice post</p></section></article>": "Body",
    "<article><p>Body</p></article><article class='comment'><p>nice post</p></article>": "Body",
    "<div id=cookie-notice>We use cookies</div><div class=content><p>Real words here</p></div><div class=sidebar>side</div>": "Real words here",
    "<script>var t='</p>';if(a<b)x()</script><style>p{}</style><p>kept  \n text</p>": "kept text",
    "<p>" + "word " * 30 + "</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul>": ("word " * 30).strip(),
    "<article></article><div><p>outside</p></div>": "outside",
}


def test_page_text(spark):
    rows = list(enumerate(PAGES)) + [(99, None), (0, "")]
    pages = spark.createDataFrame([(i, f"u{i}", h, 5) for i, h in rows], "page_id long, url string, html string, n_chars int")
    got = html.main_texts(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = list(PAGES.values())
    for r in got.collect():
        assert r.text == ("" if r.page_id == 99 else want[r.page_id])
        assert r.n_chars == len(r.text)
    assert html.main_texts(spark.createDataFrame([], "page_id long, html string")).count() == 0


LONG = "These are the words of the article, long enough to stand on their own. " * 5
P = f"<p>{LONG}</p>"
ARTICLES = [  # pages that hold LONG as their article, with and without a mark
    "<div class='content no-sidebar'>{}</div>", "<div class='layout has-sidebar'><article>{}</article><div class=sidebar>links here</div></div>",
    "<div class='with-header'>{}</div>", "<div class='no-comments'>{}</div>", "<div class='side-by-side'>{}</div>", "<div class='main right-side'>{}</div>",
    "<section id=search>{}</section>", "<form id=aspnetForm><div>{}</div></form>", "<div class='sidebar-left'><nav>menu</nav>{}</div>",
    "<div class='sidebar'><ul><li><a>a</a><li><a>b</a></ul></div>{}", "{}<div class='site-footer'><p>Contact us in our office today.</p></div>",
    "<div class=header><p>Our site since 1990</p></div><div id=page>{}</div>", "<div class='post-comments'><p>I liked this</p></div>{}",
    "<article>{}<div class='share-buttons'><a>Tweet this</a></div></article>", "<main><div class='related'><ul><li>One<li>Two</ul></div>{}</main>",
    "<div id=cookie-consent>We use cookies</div><div>{}</div>", "<article>{}<div class='newsletter-signup'>" + "Join now. " * 30 + "</div></article>",
    "{}<section class=comments><article class=comment>" + "I disagree with all of it. " * 6 + "</article></section>",
    "<article>{}<ol class=commentlist><li>" + "A reader wrote this long remark. " * 9 + "</ol></article>",
    "<div class='ad-slot'>Buy now</div>{}<div class='two-ads'>Buy more</div>", "<header><h1>Our site</h1></header><main>{}</main>",
]


@pytest.mark.parametrize("frame", ARTICLES)
def test_words_in_class_and_id_do_not_drop_articles(frame):
    assert html.main_text(f"<html><body class='no-sidebar'>{frame.format(P)}</body></html>") == LONG.strip()


def test_named_parts_of_an_article_stay():
    parts = ["<h2 id=social>On society</h2>", "<p id=search>A search began.</p>", "<h2 id='market-share'>Shares</h2>",
             "<section id='related-work'><p>Others did it too.</p></section>", "<h3 id=comments>What they said</h3>",
             f"<div class=related>{P}</div>"]
    for part in parts:
        inner = " ".join(re.sub("<[^>]*>", " ", part).split())
        assert html.main_text(f"<article>{P}{part}</article>") == f"{LONG.strip()} {inner}"
        if "related>" not in part:  # without a mark, that name is believed
            assert html.main_text(f"<div>{P}{part}{P}</div>") == f"{LONG.strip()} {inner} {LONG.strip()}"


def test_links_are_measured_as_they_are_read():
    linked = "<p><a href=x>Fish &amp; chips,\n   &quot;salt&quot; &amp; vinegar</a></p>"
    plain = 'Fish & chips, "salt" & vinegar'
    assert html.main_text(f"<article>{linked}</article>") == plain
    assert html.main_text(f"<article>{P}{linked}</article>") == f"{LONG.strip()} {plain}"
    assert html.main_text(f"<div>{P}{linked}{P}</div>") == f"{LONG.strip()} {plain} {LONG.strip()}"


def test_closing_paragraphs_and_formulas_stay():
    assert html.main_text(f"<div>{P}<div class=ad>Buy</div><p>The end.</p></div><div><p>Imprint</p></div>") == f"{LONG.strip()} The end."
    formula = "<math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x=1</annotation></math>"
    assert html.main_text(f"<article><p>So {formula} holds.</p></article>") == "So x=1 holds."


def test_letters_that_grow_in_lower_case_move_no_raw_end():
    assert html.main_text("İİİİİ<script>x</script><p>Hello</p>") == "İİİİİ Hello"
    assert html.main_text("<TITLE>İstanbul</Title><p>Merhaba</p><STYLE>İ</sTyle><p>dünya</p><script>'</ſcript>'</SCRIPT >son") == "Merhaba dünya son"


def test_far_apart_parts_without_an_article():
    page = "<div><p>" + "real text here " * 10 + "</p><p>short</p></div><div><p>x</p></div><hr><nav>n</nav><div><p>tiny</p></div>"
    assert html.main_text(page) == ("real text here " * 10).strip() + " short x"


def test_a_very_long_page():
    assert html.main_text("<article>" + "<p>w x</p>" * 50_000 + "</article>") == " ".join(["w x"] * 50_000)
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
