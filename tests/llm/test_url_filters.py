import re

from oracle import check

from meshflock.llm import url_filters as u
from meshflock.llm.queries import QUERIES, ORACLES

D = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    check(QUERIES["op2_url_filters"](spark, D), ORACLES["op2_url_filters"], D, 200)


def brute(url):
    host, path = u.split_url(url)
    best = None
    for r in u.RULES:
        if re.search(r.regex(), host if r.host_only else host + path):
            best = u.better(best, r)
    return host, path, best.site if best else None, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/en/12", "http://a.example.org/es/x?y", "http://example.org", "http://example.org?x", "http://notexample.org/es/",
        "http://x.com/fr/a#b", "http://x.com:80/fr/", "x://casino.com/de/", "x://my-casino.net/", "x://casinos.net/", "x://casino://y", "x://Ä.com/fr/", "x://example.org/en/", "http://ÉX.ORG/"]


def test_edges_and_several_passes(spark, monkeypatch):
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS * 2)], "page_id long, url string, host string")
    for n in (50_000, 4):
        monkeypatch.setattr(u, "RULES_PER_PASS", n)
        got = u.judge(df, u.RULES).collect()
        assert len(got) == len(URLS) * 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r
    assert u.judge(df.limit(0), u.RULES).count() == 0


def test_rarest_token_is_indexed():
    r = u.site("block", "example.org/en/1")
    assert r.tokens() == ["example", "org", "en"]
    index = u.Index([r, u.Rule("block", "*track*"), u.Rule("allow", "||ads.*")], {"example": 9, "org": 2, "en": 5})
    assert list(index.by_token) == ["org", "ads"] and len(index.always) == 1
    assert [x.pattern for x in index.matches("a.b", "/xtracky")] == ["*track*"]


def test_counts_cover_all_urls(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "page_id long, url string")
    assert u.token_counts(df, u.RULES, "url")["example"] == 5
