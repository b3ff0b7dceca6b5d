"""The cascade against rules tried one by one."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import url_filter as U

URLS = "page_id long, url string, host string, rule string"


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def urls():
    rng = random.Random(4)
    hosts = ["net", "a.net", "example.net", "www.example.net", "notexample.net", "example.com", "x.example.com", "example.com.evil", "org", "b.org", "", "EXAMPLE.Com", "example.net:80", "net."]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/de/y?z", "/fr/", "/fr", "?q=://x/", "#f", "/a#b?c", "/de/\n/x"]
    rows = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return rows + [None, "", "no scheme", "://", "http:///x", "a://b://c/d", "HTTP://Example.COM/de/", "http://" + "x." * 3000 + "net/" + "y" * 5000]


def judged(spark, rules, rows):
    df = spark.createDataFrame([(n if n % 7 else None, u, "clash", "clash") for n, u in enumerate(rows)], URLS)
    return sorted(map(repr, ((r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(df, rules).collect())))


def test_verdicts_equal_rules_tried_one_by_one(spark):
    rows = urls()
    assert judged(spark, U.RULES, rows) == sorted(map(repr, (brute(u, U.RULES) for u in rows)))


def test_no_rules_and_empty_table(spark):
    assert {x[3] for x in map(eval, judged(spark, [], urls()))} == {"allow"}
    assert U.judge_urls(spark.createDataFrame([], URLS)).collect() == []


def test_a_list_too_long_for_one_filter_is_taken_in_blocks(spark, monkeypatch):
    rows = urls()
    rules = [*U.RULES, ("allow", "example.net", "/"), ("block", "b.org", "/fr/"), ("block", "example.com", "/")]
    for name, most in (("MAX_BITS", 1), ("MOST_RULES", 2)):
        with monkeypatch.context() as m:
            m.setattr(U, name, most)
            assert judged(spark, rules, rows) == sorted(map(repr, (brute(u, rules) for u in rows)))


def test_bad_rules_are_refused(spark):
    df = spark.createDataFrame([], URLS)
    for rules in ([("deny", "a", "/")], [("block", "a", "/"), ("allow", "A", "/")]):
        with pytest.raises(ValueError):
            U.judge_urls(df, rules)


def test_the_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where(F.expr("xxhash64(key) % 10 = 0"))
    levels = U.build_cascade(listed, universe)
    assert len(levels) > 1
    wrong = universe.withColumn("m", U.member(levels, F.col("key"))).where(F.col("m") != F.expr("xxhash64(key) % 10 = 0"))
    assert wrong.count() == 0
