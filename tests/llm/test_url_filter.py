"""URL filters: the parts of a URL, listed rules, and mined rules against enumeration in SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assetlake.llm import url_filter

ODD = [
    ("https://WWW.Example.com/en/a?x=1#y", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://b.example.com/en/1", "b.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?/en/", "example.com", "", None, "allow"),
    ("ftp://x.net/es/://y", "x.net", "/es/://y", "net/es/", "block"),
    ("http://x.net/fr", "x.net", "/fr", None, "allow"),
    ("//x.net/fr/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.net/fr/É", "É.net", "/fr/É", "net/fr/", "block"),
    ("http://a.org/\nb?c", "a.org", "/\nb", None, "allow"),
]


def run_sql(pages: list, labels: list) -> list:
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id bigint, url varchar)").executemany("INSERT INTO pages VALUES (?, ?)", pages)
    duck.execute("CREATE TABLE labels (doc_id bigint, quality int, toxic int)").executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    duck.execute(url_filter.OP12_SQL)
    names = [c[0] for c in duck.description]
    return sorted([tuple(str(r[names.index(c)]) for c in ("page_id", "host", "path", "rule", "verdict", "mined")) for r in duck.fetchall()])


def run_spark(spark, pages: list, labels: list) -> list:
    urls = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("theirs") for c in ("html", "host", "tokens", "rule", "blocked", "mined")})
    known = url_filter.page_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(str(r[c]) for c in ("page_id", "host", "path", "rule", "verdict", "mined")) for r in url_filter.filter_urls(urls, known).collect())


def planted(seed: int, n: int) -> tuple[list, list]:
    rng, pages, labels = random.Random(seed), [], []
    for i in range(n):
        name = rng.choice(["alpha", "beta", "pills-now", "free-bets"])
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(['m.', ''])}{name}.example.{rng.choice(['org', 'net'])}/{rng.choice(['en', 'de', 'promo'])}/{i}{rng.choice(['', '?ref=x'])}"
        bad = rng.random() < (0.95 if name == "pills-now" or (name == "free-bets" and "/promo/" in url) else 0.05)
        pages.append((i, url))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), 0) if rng.random() < 0.5 else (i, 1, int(bad)))
    pages += [pages[0], (n, None), (n + 1, "no scheme/pills now"), (n + 2, "")]
    return pages, labels + [(None, 0, 0), (2, None, None)]


def test_parts_and_listed_rules(spark):
    got = run_spark(spark, [(i, row[0]) for i, row in enumerate(ODD)], [])
    assert got == sorted((str(i), *map(str, row[1:]), "False") for i, row in enumerate(ODD))


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_against_enumeration(spark, seed):
    pages, labels = planted(seed, 240)
    got = run_spark(spark, pages, labels)
    assert got == run_sql(pages, labels)
    spam = [r for r in got if "pills-now" in r[1]]
    assert spam and all(r[5] == "True" for r in spam)
    assert not any(r[5] == "True" for r in got if r[1].startswith(("alpha", "m.alpha")))


def test_rules_are_pruned_and_matched_in_blocks(spark):
    pages, labels = planted(3, 300)
    urls = spark.createDataFrame(pages, "page_id long, url string")
    rules = url_filter.mine(urls, url_filter.page_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    made = [(set(r.tokens), r.sure, r.hits, r.pages) for r in rules.collect()]
    assert {"h:now", "h:pills"} in [m[0] for m in made]
    assert all(s >= url_filter.CONFIDENCE and h <= p for _, s, h, p in made)
    assert not any(a[0] < b[0] and a[1] >= b[1] for a in made for b in made)
    tokened = urls.withColumn("tokens", F.coalesce(url_filter.tokens(F.col("url")), F.array().cast("array<string>")))
    one, many = (sorted((str(r.page_id), r.m) for r in url_filter.matches(tokened, rules, "m", block=b).collect()) for b in (10**6, 1))
    assert one == many and any(m for _, m in one)


def test_a_long_url_that_many_labelled_pages_share(spark):
    """Forty tokens that always come together are one item, not 2 ** 40 itemsets."""
    long = "http://x.org/" + "/".join(f"w{i}" for i in range(40))
    urls = spark.createDataFrame([(i, long if i % 2 else f"http://y.org/{i}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(60)], "page_id long, blocked boolean")
    got = {r.page_id: r for r in url_filter.filter_urls(urls, labels).collect()}
    assert all(got[i].mined == (i % 2 == 1) for i in range(60))
    assert url_filter.filter_urls(urls.limit(0), labels).count() == 0
