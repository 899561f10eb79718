import random

from meterframe.llm import url_rules

RULES = "host string, path string, verdict string"
PAGES = "page_id bigint, url string, host string, rule string, html string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:end]


def brute(url, rules):
    host, path = parts(url)
    fits = [
        (len(h + (p or "")), len(h), h + (p or ""), v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, pages, rules):
    frame = spark.createDataFrame([(n, u, "x", "y", "z") for n, u in pages], PAGES)
    return {(r[0], *tuple(r)[1:]) for r in url_rules.judge(frame, spark.createDataFrame(rules, RULES)).collect()}


def test_nested_rules_against_brute_force(spark):
    pick = random.Random(5)
    labels = ["a", "b", "com", "net", "example"]

    def host():
        return ".".join(pick.choice(labels) for _ in range(pick.randint(1, 4)))

    def path():
        return "".join("/" + pick.choice(["x", "y", "xx"]) for _ in range(pick.randint(0, 3)))

    rules = list({(host(), path()): 0 for _ in range(60)})
    rules = [(h, p, pick.choice(["allow", "block"])) for h, p in rules]
    pages = [(n, f"https://{host()}{path()}{pick.choice(['', '?q=1', '#t', '/'])}") for n in range(400)]
    assert judged(spark, pages, rules) == {(n, *brute(u, rules)) for n, u in pages}


def test_odd_pages_and_rules(spark):
    pages = [(1, None), (2, "no scheme"), (3, "http://"), (None, "HTTP://Ex.NET/en/A?b"), (4, "x://ex.net"), (5, "")]
    pages += [(6, "http://ex.net/en/" + "p" * 50_000), (7, "http://notex.net/en/"), (8, "a://b://c/d"), (9, "x://É.net/en/")]
    rules = [("ex.net", "/en/", "block"), ("net", None, "allow"), (None, "/", "block"), ("ex.net", "/en/", "allow")]
    usable = [("ex.net", "/en/", "block"), ("net", "", "allow")]
    assert judged(spark, pages, rules) == {(n, *brute(u, usable)) for n, u in pages}
    assert judged(spark, pages, []) == {(n, *brute(u, [])) for n, u in pages}
    assert judged(spark, [], rules) == set()


def test_repeated_pages_stay(spark):
    frame = spark.createDataFrame([(1, "http://a.net/", "h", "r", "x")] * 3, PAGES)
    rules = spark.createDataFrame([("net", "/", "block")], RULES)
    assert [r["verdict"] for r in url_rules.judge(frame, rules).collect()] == ["block"] * 3


def test_interval_reaches_cuts_behind_the_highest_character(spark, monkeypatch):
    high = "\U0010ffff"
    pages = [(n, f"http://net/{high * (n % 3)}{n}") for n in range(60)] + [(99, "http://net/"), (98, "http://nets/")]
    cuts = ["net", "net\0/" + high, "net\0/" + high * 2 + "3", "net\0/" + high * 3, "nets"]
    monkeypatch.setattr(url_rules, "sampled_cuts", lambda keys, parts: (cuts, [1] * 6))
    rules = [("net", "/", "block"), ("net", "/" + high, "allow")]
    assert judged(spark, pages, rules) == {(n, *brute(u, rules)) for n, u in pages}
