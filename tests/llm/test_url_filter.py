"""URL filters against every rule on every page."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import url_filter

ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/", "http://Example.NET/en/x?y#z", "http://example.net", "http://example.net?/en/", "http://example.net#/", "https://a.b.c.example.com/de/",
    "https://example.com/de", "https://notexample.com/de/1", "x://org/fr/", "x://.org/fr/", "x://org./fr/", "x://a..org/fr/fr/", "y://net/://net/", "z://ÄÖ.NET/ä/", "http://u:p@sub.example.net:80/en/", "http://example.net/en/" + "a/" * 3000,
    "http://" + "a." * 3000 + "net/x", "http://example.net/\nen/", "http://one.net/en/q", "http://one.net/english", "http://example.com//de/",
]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, x in enumerate(rest) if x in "/?#"), len(rest))
        m = next((i for i, x in enumerate(rest) if i >= n and x in "?#"), len(rest))
        host, path = rest[:n].translate({i: i + 32 for i in range(65, 91)}), rest[n:m]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if None not in (h, p) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


MORE = [
    ("net", "/", "block"), ("example.net", "/e", "allow"), ("one.net", "/en", "block"), ("one.net", "/en/", "allow"), ("a.example.com", "", "block"), ("b.c.example.com", "/de/", "allow"), ("", "", "block"), (None, "/", "block"), ("org", None, "block"),
    ("one.net", "/en/", "block"), ("one.net", "/en/", "block"), ("example.com", "//de/", "allow"),
]


@pytest.mark.parametrize("rules", [url_filter.RULES, MORE, []])
def test_every_rule_on_every_page(spark, sf_dir, rules):
    real = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = [*real, *enumerate(ODD), (None, None), (None, "http://one.net/en/q"), (None, "http://one.net/en/q"), (3, "http://one.net/en/q"), (3, "http://one.net/en/q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("mine"), "n": F.lit(1), "verdict": F.lit("mine"), "prefix": F.lit("p")})
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter((k, *brute(u, rules)) for k, u in rows)


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).count() == 0


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = db.sql(url_filter.sql())
    got = url_filter.query(spark, sf_dir)
    assert want.columns == got.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    assert len({r["rule"] for r in got.collect()}) >= 4


def test_no_python(spark, sf_dir):
    plan = url_filter.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan
