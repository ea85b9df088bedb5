"""Operator 13 against rules tried one by one on every URL, and against its SQL."""

import re

import oracle
import pytest
from pyspark.sql import functions as F

from itemforge.llm import registry, url_filters
from itemforge.llm.url_filters import ALLOW, BLOCK, path_rule, pattern

URLS = [
    None, "", "no scheme", "http://", "https://ORG/", "https://org", "https://x.Example.ORG/es/1", "https://example.org/es", "http://example.org/en/1", "http://example.org/en/12?q",
    "http://badexample.org/es/", "http://a.com/fr/x#y", "http://a.com/de/", "http://a.com/DE/", "a://b.com://c.org/fr/", "http://h.com?x=/fr/", "http://h.com#/de/", "http://u@h.com:80/de/x",
    "http://www.spam-farm.net/", "http://xspam-farm.net/", "http://spam-farm.a.net/en", "http://casino-1.net", "http://my.casino-royal.net/x", "http://mycasino-x.net/", "http://ads.net/",
    "http://x.net/login", "http://x.net/login/", "http://x.net/logins", "http://x.net/LOGIN?next=1", "http://x.net/a.PDF", "http://x.net/a.pdf?x", "http://docs.x.net/search?q=1", "http://x.net/search?q=1",
    "http://blog.x.net/feed/", "http://x.net/feed/", "http://x.net/feed/x", "http://x.net/tag/a?b&page=2", "http://x.net/tag/a?page=2", "http://x.net/a\nb/feed/\n", "http://x.net/" + "a/" * 50_000 + "login", "http://été.net/Ünï",
]


def brute(url, paths, patterns):
    """host, path, rule, pattern, verdict; every rule is tried, by an own reading of its text."""
    low_az = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.split("[/?#]", rest, maxsplit=1)[0]
    host, path = low_az(raw), re.split("[?#]", rest[len(raw) :], maxsplit=1)[0]
    fit = []
    for action, text in paths:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(text), action, text))
    if fit:
        _, action, text = max(fit)
        return host, path, text, None, action

    def fits(text):
        body, start, end = text, "", ""
        if body.startswith("||"):
            body, start = body[2:], r"\A[^:/?#]*://([^/?#]*\.)?"
        if body.endswith("|"):
            body, end = body[:-1], r"\Z"
        inner = "".join(".*" if c == "*" else r"([^a-z0-9_%.\-]|\Z)" if c == "^" else re.escape(c) for c in body)
        return re.search(start + inner + end, low_az(url or ""), re.S)

    for wanted in (ALLOW, BLOCK):
        found = sorted(t for a, t in patterns if a == wanted and fits(t))
        if found:
            return host, path, None, found[0], wanted
    return host, path, None, None, ALLOW


@pytest.mark.parametrize("broadcast", [8 << 20, 0])
def test_brute(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", broadcast)
    rows = [(i if i % 5 else None, u) for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3).withColumns({c: F.lit("x") for c in ("host", "rule", "row", "token", "tokens", "kind")})
    got = url_filters.judge(df, url_filters.default_rules()).collect()
    want = [(i, *brute(u, url_filters.PATH_RULES, url_filters.PATTERNS)) for i, u in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ties_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    rules = [path_rule(BLOCK, "c/x/y"), path_rule(ALLOW, "b.c/x"), pattern(BLOCK, "*")]
    assert url_filters.judge(df, rules).first().rule == "b.c/x"
    assert url_filters.judge(df, rules[::2]).first().verdict == BLOCK
    free = url_filters.judge(df, []).first()
    assert (free.host, free.rule, free.verdict) == ("a.b.c", None, ALLOW)
    assert url_filters.judge(df.where("page_id = 2"), rules).count() == 0
    with pytest.raises(ValueError):
        path_rule(BLOCK, "/x")


def test_tokens_are_in_every_url_that_fits():
    assert pattern(BLOCK, "||ads.*/banner^").tokens == ("ads", "banner")
    assert pattern(BLOCK, "track*er.js|").tokens == ("js",)
    assert path_rule(BLOCK, "example.org/en/1").tokens == ("example", "org", "en")


def test_filed_under_the_rarest(spark):
    urls = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],)], "tokens array<string>")
    rules = [path_rule(BLOCK, "a.b/c/d"), pattern(BLOCK, "x")]
    assert url_filters.rarest(urls, rules) == {"a.b/c/d": "b", "x": url_filters.EVERY}


def test_query_and_sql(spark):
    query, sql = registry.queries()["op13_url_filters"], registry.oracle_sql()["op13_url_filters"]
    assert oracle.rows_of_spark(query(spark, oracle.DATA)) == oracle.rows_of_duckdb(oracle.connect(), sql)
