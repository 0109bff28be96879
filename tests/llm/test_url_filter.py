"""Rules, links between hosts and odd rows of the URL filter."""

import pytest

from tessera.llm import url_filter

SHAPE = "page_id long, url string, html string, host string, rule int, salt int, bad string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", 1, 2, "own") for r in rows], SHAPE)


def judged(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.decided) for r in df.collect()), key=str)


CASES = [
    ("http://A.org/x", "a.org", "/x", "org/", "allow"), ("http://org", "org", "", None, "allow"),
    ("http://example.org/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
    ("x://www.Example.org/en/17", "www.example.org", "/en/17", "example.org/en/1", "block"),
    ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("http://a.com?x=/fr/", "a.com", "", None, "allow"), ("http://a.com:80/fr/", "a.com:80", "/fr/", None, "allow"),
    ("a://b://c.org/", "b:", "//c.org/", None, "allow"), ("no scheme.org/", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http:///de/", "", "/de/", None, "allow"), ("", "", "", None, "allow"), ("http://com/de/\n1", "com", "/de/\n1", "com/de/", "block"),
]


@pytest.mark.parametrize("inline", [url_filter.INLINE_RULES, 0])
def test_rules(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    rows = [(i if i else None, c[0], None) for i, c in enumerate(CASES)] + [(3, CASES[3][0], "")]
    got = judged(url_filter.judge_urls(pages(spark, rows)))
    want = [(i if i else None, *c[1:]) for i, c in enumerate(CASES)] + [(3, *CASES[3][1:])]
    assert [g[:5] for g in got] == sorted(want, key=str)
    assert url_filter.judge_urls(pages(spark, rows), rules=()).where("rule IS NOT NULL OR decided <> 'default'").count() == 0
    assert url_filter.judge_urls(pages(spark, [])).count() == 0


def test_trust_and_distrust_follow_links(spark, monkeypatch):
    link = '<a class=x href="{}">l</a>'.format
    rows = [(1, "http://good.com/fr/", link("https://Friend.net/x") + link("//friend.net") + link("/own")),
            (2, "http://bad.com/de/", link("http://victim.net")), (3, "http://farm.net/", link("http://bad.com/y?z") + "x" * 300_000),
            (4, "http://friend.net/", None), (5, "http://victim.net/", ""), (6, "http://feeder.net/", link("http://farm.net")),
            (7, "http://hidden.net/", "<!-- " + link("http://bad.com/") + " --><script>'" + link("http://bad.com/") + "'</script>"),
            (8, "http://blog.farm.net/", ""), (9, "http://friend.net/", link("http://bad.com/"))]
    want = {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow"}
    for hosts in (url_filter.BROADCAST_HOSTS, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", hosts)
        got = {r.page_id: (r.verdict, r.decided) for r in url_filter.judge_urls(pages(spark, rows)).collect()}
        assert {k: v[0] for k, v in got.items()} == want
        assert (got[1][1], got[3][1], got[7][1]) == ("rule", "graph", "default")


def test_ranks_are_the_power_series(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 5), ("d", "a", 1)], "src string, dst string, w long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 0.5)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(edges, seeds).collect()}
    out = {"a": {"b": 0.75, "c": 0.25}, "b": {"c": 1.0}, "c": {"a": 1.0}, "d": {"a": 1.0}}
    into = {"b": {"a": 1.0}, "c": {"a": 1 / 3, "b": 2 / 3}, "a": {"c": 5 / 6, "d": 1 / 6}}
    for kind, (ways, start) in enumerate([(out, {"a": 1.0}), (into, {"c": 0.5})]):
        rank = {h: 0.15 * v for h, v in start.items()}
        for _ in range(url_filter.ROUNDS):
            nxt = {h: 0.15 * v for h, v in start.items()}
            for h, v in rank.items():
                for to, share in ways.get(h, {}).items():
                    nxt[to] = nxt.get(to, 0.0) + 0.85 * v * share
            rank = nxt
        assert all(abs(got[h][kind] - v) < 1e-12 for h, v in rank.items())
