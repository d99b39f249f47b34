import re

import pytest

from lociflow.llm.urls import judged_pages, page_rank

from .helpers import rows_of, with_clashing_names

PAGES = "page_id long, url string, html string"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages():
    urls = [
        None, "", "no scheme", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/de/", "https://net/", "https://net", "https://xnet/a", "http://b.example.com/de/1", "http://example.com/fr/",
        "http://q.org/fr/a", "http://q.org/en/a", "ftp://u@h.org:80/fr/", "http://a/b://c/d", "http://x.example.net?en/", "x://\u00c4.NET/\n/en/", "http://good.test/", "http://linked.test/", "http://suspect.test/",
    ]
    html = {16: '<a href="https://q.org/fr/a">x</a>', 10: '<a HREF=\'http://linked.test/p\'>y</a> <a href=//good.test>', 18: '<a href="http://net/"><a href="http://b.example.com/de/1">'}
    return [(i, u, html.get(i)) for i, u in enumerate(urls)]


def test_parts_rules_and_propagation(spark):
    rows = pages()
    got = rows_of(judged_pages(with_clashing_names(spark.createDataFrame(rows, PAGES))), "page_id")
    for (i, url, _), r in zip(rows, got, strict=True):
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        assert (r["page_id"], r["host"], r["path"], r["rule"]) == (i, host, path, rule), url
        if rule:
            assert r["verdict"] == verdict
    by_host = {r["host"]: r for r in got}
    assert by_host["linked.test"]["trust"] > 0 and by_host["linked.test"]["verdict"] == "allow"
    assert by_host["suspect.test"]["distrust"] > 0 and by_host["suspect.test"]["verdict"] == "block"


def test_page_rank_matches_power_iteration(spark):
    links = {("a", "b"): 1, ("b", "c"): 2, ("b", "a"): 1, ("c", "a"): 3, ("c", "d"): 1}
    seeds = {"a": 0.75, "c": 0.25}
    rank = {h: 0.15 * s for h, s in seeds.items()}
    for _ in range(8):
        new = {h: 0.15 * s for h, s in seeds.items()}
        for (a, b), n in links.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / sum(k for (x, _), k in links.items() if x == a)
        rank = new
    got = page_rank(spark.createDataFrame(list(seeds.items()), "host string, share double"), spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "a string, b string, n long"), 8, 0.85)
    assert {r["host"]: r["rank"] for r in got.collect()} == pytest.approx(rank)


def test_defined_cases(spark):
    assert judged_pages(spark.createDataFrame([], PAGES)).count() == 0
    got = rows_of(judged_pages(spark.createDataFrame([(1, "http://a.net/", None), (1, "http://a.net/", None), (None, None, None)], PAGES)), "page_id")
    assert [(r["page_id"], r["verdict"]) for r in got] == [(1, "block"), (1, "block"), (None, "allow")]


def test_verdict_depends_on_the_hosts_own_pages(spark):
    few = [("http://few.example.com/de/1", None)] + [(f"http://few.example.com/fr/{i}", None) for i in range(9)]
    most = [(f"http://most.example.com/de/{i}", None) for i in range(9)] + [("http://most.example.com/fr/", '<a href="/de/1">')]
    linking = [(f"http://farm{i}.test/", '<a href="http://most.example.com/de/1">') for i in range(30)]
    once = [("http://once.test/0", '<a href="http://most.example.com/de/1">')] + [(f"http://once.test/{i}", None) for i in range(1, 30)]
    rest = [(f"http://h{i}.net/", None) for i in range(3000)]

    def verdicts(rows):
        got = judged_pages(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PAGES)).where("rule is null")
        return {(r["host"], r["verdict"], round(r["trust"], 9), round(r["distrust"], 9)) for r in got.collect()}

    small = verdicts(few + most + linking + once)
    by_host = {host: verdict for host, verdict, _, _ in small}
    assert len(by_host) == len(small) and by_host["few.example.com"] == "allow" and by_host["most.example.com"] == "block"
    assert by_host["farm0.test"] == "block" and by_host["once.test"] == "allow"
    assert verdicts(few + most + linking + once + rest) == small
