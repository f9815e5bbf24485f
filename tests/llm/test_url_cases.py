from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import url_filter


def test_odd_inputs(spark):
    long = "http://h.org/" + "a/" * 600_000 + "porn"
    rows = [(1, None), (1, None), (None, "http://x.com/"), (2, ""), (3, long), (4, "HTTP://ü.COM/É?x"), (5, "://"), (6, "http://[::1]:80/p#f")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "verdict": F.lit(0), "rule": F.lit(None)})
    got = sorted(((r.page_id or 0, r.host, r.path[:5], r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()), key=str)
    assert got == [(0, "x.com", "/", "com/", "allow"), (1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "h.org", "/a/a/", None, "block"), (4, "ü.com", "/É", "com/", "allow"), (5, "", "", None, "allow"), (6, "[::1]:80", "/p", None, "allow")]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_ties_and_terms(spark):
    pages = spark.createDataFrame([("p", "http://a.b/c/d"), ("q", "http://z/win-win"), ("r", "http://z/win/bet")], "page_id string, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules=[("allow", "a.b", "/c/"), ("block", "a.b", "/c/"), ("allow", "b", "/")]).collect()}
    assert (got["p"].rule, got["p"].verdict) == ("a.b/c/", "block")
    assert [(got[k].soft_terms, got[k].verdict) for k in "qr"] == [(1, "allow"), (2, "block")]
    assert url_filter.judge_urls(pages, rules=[], strict=[], soft=[]).where("verdict = 'block'").count() == 0
