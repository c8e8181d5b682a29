import random

from cinegrid.llm import url_filter


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:k]), rest[k:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    hits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(hits)[3:]) if hits else (host, path, None, default)


def run(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(df, url_filter.rules_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_hard_urls(spark):
    urls = [None, "", "x", "http://", "http://NET/", "http://a.b.Example.NET/en/x?y#z", "http://example.net", "http://example.net?/en/", "http://notexample.com/de/1", "http://example.com/de", "ftp://x.org/fr/#a", "http://org/fr/", "http://a..net/", "a://b://c.net/", "http://é.net/q", "http://" + "a." * 5000 + "net/" + "p" * 50000]
    run(spark, urls + urls, url_filter.RULES)


def test_random_rules(spark):
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    rules = sorted({(rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4))), rng.choice(["block", "allow"])) for _ in range(40)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{rng.choice(hosts)}/{''.join(rng.choice('xy/') for _ in range(6))}" for _ in range(200)]
    run(spark, urls, rules)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.verdicts(df, url_filter.rules_table(spark)).count() == 0
