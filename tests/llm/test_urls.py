import re

from cloudloom.llm import urls
from cloudloom.llm.queries import RULES, op7_url_filters

LINK = '<html><head><link rel="canonical" href="{}"></head>'
FRESH = "<META content='0; url={}' HTTP-EQUIV=refresh>"
PAGES = [
    (1, "http://a.example.com/en/5", ""),
    (2, "https://A.Example.COM/en/71?x=1#y", None),
    (3, "http://b.example.net/de/81", ""),
    (4, "http://b.example.net/de/7", ""),
    (5, "http://x.org/es/1", ""),
    (6, "http://alias.test/a", LINK.format("http://x.org/es/1")),
    (7, "http://alias.test/b", FRESH.format("http://alias.test/a")),
    (8, "http://alias.test/c", LINK.format("/b")),
    (9, "http://alias.test/d/e", LINK.format("f")),
    (10, "http://alias.test/d/f", LINK.format("http://z.example.com/en/7") + FRESH.format("http://q.com/en/")),
    (11, None, "x"),
    (12, "no scheme/en/", LINK.format("http://x.org/es/1")),
    (13, "http://notcom/en/", ""),
    (14, "http://com/en/", ""),
    (15, "://h/p", ""),
    (16, "http://x.test?q", LINK.format("//x.org/es/2")),
    (17, "http://x.test?q", ""),
    (17, "http://x.test?q", ""),
    (18, "http://x.test/", ""),
    (19, "http://u.test/\n/a://b/c", ""),
    (20, "http://alias.test/e", "<link rel=alternate href='http://x.org/es/1'><a href='http://x.org/es/1'>canonical</a>"),
]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    if not m:
        return "", "", ""
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or ""


def rule(host, path):
    fit = [(len(r), r, a) for a, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def test_query_against_brute_force(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = op7_url_filters(spark, str(tmp_path)).collect()
    assert len(got) == len(PAGES)
    linked = [(6, "http://x.org/es/1"), (7, "http://alias.test/a"), (8, "http://alias.test/b"), (9, "http://alias.test/d/f"), (10, "http://z.example.com/en/7"), (10, "http://q.com/en/"), (16, "http://x.org/es/2")]
    at = {i: split(u) for i, u, _ in PAGES}
    group = {n: {n} for n in [*at.values(), *(split(t) for _, t in linked)]}
    for i, t in linked:
        both = group[at[i]] | group[split(t)]
        for n in both:
            group[n] = both
    for r in got:
        host, path, _ = at[r.page_id]
        name, action = rule(host, path)
        if not action:
            actions = {rule(h, p)[1] for h, p, _ in group[at[r.page_id]]} if host else set()
            action = "block" if "block" in actions and "allow" not in actions else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, action), r
    assert {r.page_id: r.verdict for r in got}[8] == "block"
    assert {r.page_id: r.verdict for r in got}[9] == "allow"


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    from cloudloom.llm.queries import OP7_SQL

    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    key = lambda r: tuple(str(v) for v in r)
    got = op7_url_filters(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(c.sql(OP7_SQL).fetchall(), key=key)


def test_redirects_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://x.test/", "http://x.org/es/9"), (None, "http://x.org/es/9"), ("http://x.test/", None)], "source string, target string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, RULES, more).collect()}[18] == "block"
    assert urls.judge(pages.limit(0), RULES).collect() == []
