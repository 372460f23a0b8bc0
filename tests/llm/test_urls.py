"""URL filters against a rule-by-rule test of each url."""

from __future__ import annotations

import random

from kinloom.llm import urls

RULES = "host string, path string, verdict string"


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    listed = {}
    for h, p, v in rules:
        h = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h or "")
        listed[h, p or ""] = max(v, listed.get((h, p or ""), v))
    fit = [(len(h) + len(p), len(h), v, h + p) for (h, p), v in listed.items() if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else default


def check(spark, rows, rules, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge_urls(pages, spark.createDataFrame(rules, RULES), **how)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, u, *brute(u, rules, **how))) for i, u in rows)


def test_rules_by_hand(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    given = [
        "http://www.example.org/es/7", "http://example.org/es", "HTTP://WWW.Example.ORG/en/123?x#y", "https://myexample.org/es/7", "http://org/x",
        "http://a.com/fr/1", "http://a.com/de/", "http://com/de/?q", "http://example.org", "http://example.org?es/", "http://b.net/es/", "no url",
        "", None, "://", "http:///es/", "http://a.com/x://b.org/", "http://example.org./es/", "http://exam.ple.org/es/", "http://a.com/FR/1",
        "http://é.example.org/es/ü", "http://example.org/es/" + "x" * 50_000, "http://" + "a." * 3_000 + "example.org/en/1",
    ]
    check(spark, list(enumerate(given)) + [(None, given[0]), (0, given[0])], rules)


def test_nested_hosts_and_paths_at_random(spark):
    rnd = random.Random(5)

    def host():
        return ".".join(rnd.choice("abAé") for _ in range(rnd.randint(0, 4)))

    def path():
        return "".join(rnd.choice("/abé") for _ in range(rnd.randint(0, 6)))

    rules = [(host(), path(), rnd.choice(["allow", "block"])) for _ in range(400)] + [("", "", "block"), (None, None, "allow"), ("a.b", None, "block")]
    rows = [(i, f"{rnd.choice(['http', ''])}://{host()}/{path()}{rnd.choice(['', '?a', '#b/'])}") for i in range(3_000)]
    check(spark, rows, rules, default="unknown")


def test_one_hot_url_spreads_over_ranges(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/xy", "allow")]
    rows = [(i, "http://www.a.org/xyz") for i in range(5_000)] + [(i, f"http://b{i}.org/x") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4)
    got = urls.judge_urls(pages, spark.createDataFrame(rules, RULES))
    assert {(r.rule, r.verdict): r["count"] for r in got.groupBy("rule", "verdict").count().collect()} == {
        ("a.org/xy", "allow"): 5_000, ("org/", "allow"): 50}


def test_no_rules_no_rows_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "mine", 3)], "page_id long, url string, Host string, __number int")
    got = urls.judge_urls(pages, spark.createDataFrame([], RULES), default="block")
    assert [tuple(r) for r in got.collect()] == [(1, "http://a.org/x", 3, "a.org", "/x", None, "block")]
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame([("a", "/", "block")], RULES)).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = spark.sql("SELECT 'a.org' AS host, '/' AS path, 'block' AS verdict")
    plan = urls.judge_urls(pages, rules)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InArrow", "InPandas"))
