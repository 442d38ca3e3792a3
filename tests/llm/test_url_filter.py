import random

import pytest

from tallyweave.llm import url_filter
from tallyweave.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:cut]


def brute(rows, rules, default="allow"):
    out = []
    for page_id, url in rows:
        host, path = split(url)
        fits = [(-len(h) - len(p), -len(h), p, v, h) for h, p, v in rules if None not in (h, p, v) and (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, default=None)
        out.append((page_id, host, path, best[4] + best[2] if best else None, best[3] if best else default))
    return sorted(out, key=repr)


def judged(spark, rows, rules, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    return sorted((tuple(r) for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES), **options).collect()), key=repr)


def test_random_urls_over_many_ranges(spark):
    draw = random.Random(3)
    labels = ["org", "com", "example", "a", "ab", "a-b", "é"]
    host = lambda: ".".join(draw.choices(labels, k=draw.randint(1, 4)))
    path = lambda: draw.choice(["", "/", "/x", "/xy/z", "/x/?q=/y", "#/x", "?/x", "/X"])
    rows = [(i, f"{draw.choice(['http', 'HTTPS', ''])}://{host()}{path()}") for i in range(400)] + [(500 + i, "http://hot.example.org/x") for i in range(300)]
    rules = [(host(), draw.choice(["", "/", "/x", "/xy/"]), draw.choice(["allow", "block"])) for _ in range(60)]
    for range_rows in (20, 100, 10_000):
        assert judged(spark, rows, rules, range_rows=range_rows, default="block") == brute(rows, rules, "block")


def test_the_rules_asked_for(spark):
    rows = list(enumerate([
        "http://Example.ORG/es/1", "https://www.example.org/en/12", "https://www.example.org/en/2", "http://x.com/fr/", "http://x.com/de/1?a#b", "http://com/fr/",
        "http://notexample.org/es/", "http://example.org", "http://example.org?x=/es/", "ftp://org/", "no host", "", None, "://", "http://a.org:80/es/", "http://comx/de/",
    ]))
    assert judged(spark, rows, URL_RULES) == brute(rows, URL_RULES)


@pytest.mark.parametrize("rules", [[], [("", "", "block")], [(None, "/", "block"), ("a", None, "block"), ("a", "/", None)], [("a", "/", "block"), ("a", "/", "allow")]])
def test_odd_rules_and_rows(spark, rules):
    rows = [(None, "http://a/x"), (1, "http://a/x"), (1, "http://a/x"), (2, "http://" + "b." * 3_000 + "a/" + "p" * 9_000), (3, None)]
    assert judged(spark, rows, rules, range_rows=1) == brute(rows, rules)


def test_further_columns_and_empty_table(spark):
    schema = "page_id long, url string, host string, `key` string, place int, verdict string"
    pages = spark.createDataFrame([(1, "http://a.org/", "h", "k", 1, None)], schema)
    rules = spark.createDataFrame(URL_RULES, RULES)
    assert [tuple(r) for r in url_filter.judge_urls(pages, rules).collect()] == [(1, "a.org", "/", "org/", "allow")]
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []


def test_many_ranges_share_few_tasks(spark):
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('http://h', id % 9000, '.org/', id % 3) AS url")
    rules = spark.createDataFrame([("org", "/1", "block"), ("h7.org", "/", "allow")], RULES)
    got = url_filter.judge_urls(pages, rules, range_rows=20, task_rows=2_000)
    assert got.rdd.getNumPartitions() <= 20
    count = lambda where: got.filter(where).count()
    blocked = sum(1 for i in range(40_000) if i % 3 == 1)
    # the longest rule wins: h7.org/ over org/1
    spared = sum(1 for i in range(40_000) if i % 3 == 1 and i % 9000 == 7)
    assert count("verdict = 'block'") == blocked - spared and count("rule = 'h7.org/'") == sum(1 for i in range(40_000) if i % 9000 == 7)
