"""Operator 7 against brute force."""

import random
from datetime import date, timedelta

from tracewright.llm.url_filter import filter_urls, host_of, validity

DAY = date(2024, 1, 1)


def captures_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, fetched date, host string, list string")


def entries_table(spark, rows):
    return spark.createDataFrame(rows, "list string, domain string, day date, action string")


def brute(host, day, entries):
    """The longest listed domain, then the first list, and since when."""
    hits = []
    for name, domain in {(e[0], e[1].lower()) for e in entries}:
        days = {}
        for e in entries:
            if (e[0], e[1].lower()) == (name, domain) and e[2] <= day:
                days[e[2]] = days.get(e[2], False) or e[3] == "add"
        since, on = None, False
        for d in sorted(days):
            if days[d] and not on:
                since = d
            on = days[d]
        if on and (host == domain or host.endswith("." + domain)):
            hits.append((-len(domain), name, since))
    return min(hits)[1:] if hits else None


def test_as_of_join(spark):
    rng = random.Random(1)
    domains = ["a.org", "b.a.org", "c.b.a.org", "org", "x.com", "www.x.com"]
    entries = [(rng.choice("pq"), rng.choice(domains).upper(), DAY + timedelta(rng.randrange(20)), rng.choice(["add", "remove"]))
               for _ in range(60)]
    rows = [(i, f"http://u:p@{rng.choice(domains)}:80/x?http://a.org", DAY + timedelta(rng.randrange(25))) for i in range(150)]
    got = filter_urls(captures_table(spark, rows), entries_table(spark, entries)).collect()
    assert len(got) == 150
    for r in got:
        want = brute(r.host, r.fetched, entries)
        assert ((r.list, r.since) if r.blocked else None) == want, r


def test_odd_rows(spark):
    entries = [("p", "a.org", DAY, "add"), ("p", None, DAY, "add"), (None, "b.org", DAY, "add"), ("p", "c.org", None, "add"),
               ("p", "d.org", DAY, "keep"), ("p", "", DAY, "add"), ("p", "a.org", DAY, "add")]
    rows = [(None, "http://a.org", DAY), (1, None, DAY), (2, "", DAY), (3, "no url", DAY), (4, "http://A.org./", None),
            (5, "https://A.ORG./", DAY), (5, "https://A.ORG./", DAY), (6, "http://b.org", DAY), (7, "http://d.org", DAY),
            (8, "http://a.org", DAY - timedelta(1)), (9, "http://" + "x." * 200 + "a.org/", DAY), (10, "http://notaa.org", DAY)]
    got = filter_urls(captures_table(spark, rows), entries_table(spark, entries)).collect()
    assert sorted((r.page_id or 0) for r in got if r.blocked) == [0, 5, 5, 9] and len(got) == len(rows)


def test_intervals(spark):
    def at(n):
        return DAY + timedelta(n)
    rows = [("p", "a", at(0), "add"), ("p", "a", at(2), "add"), ("p", "a", at(4), "remove"), ("p", "a", at(4), "add"),
            ("p", "a", at(5), "remove"), ("p", "a", at(6), "remove"), ("p", "a", at(9), "add"), ("q", "a", at(1), "remove")]
    got = {(r.list, r.since, r.until) for r in validity(entries_table(spark, rows)).collect()}
    assert got == {("p", at(0), at(5)), ("p", at(9), None)}


def test_empty_tables(spark):
    assert filter_urls(captures_table(spark, []), entries_table(spark, [])).collect() == []
    got = filter_urls(captures_table(spark, [(1, "http://a.org", DAY)]), entries_table(spark, [])).collect()
    assert [r.blocked for r in got] == [False]


def test_hosts(spark):
    urls = ["HTTP://User@Host.COM:8080/p", "ftp://h", "//h/x", "http:///x", "mailto:a@b", "http://[::1]/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(df.url)).collect()] == ["host.com", "h", "", "", "", "["]
