import random
import re

from dossierlake.llm import url_filter as u


def host_path(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [(len(r), r, v) for v, r in u.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.com/x?y#z", "https://A.B.Example.COM/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/a#b", "http://example.com/en", "http://example.com/EN/", "https://m.x.net/es/1", "https://net/fr/2?q",
    "http://x.net/de/", "http://xnet/es/", "http://com", "http://com/", "http://notexample.com/en/", None, "", "no scheme", "://", ":///p", "a://b://c.com/d", "http://x.org?u=http://y.net/es/", "http://É.Org/Ä\nB?c", "http://u@h.com:80/en/", "http://x.net/es", "http://" + "a." * 2000 + "net/es/" + "p" * 50_000,
]


def pages(spark, urls):
    return spark.createDataFrame([(i, x, "h", "v", 1) for i, x in enumerate(urls)], "page_id long, url string, host string, verdict string, n int")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_hosts_paths_and_longest_rules(spark):
    got = {r.page_id: r for r in u.url_digest(pages(spark, URLS), labels(spark, [])).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = host_path(url)
        rule, verdict = rule_of(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url


def test_random_urls(spark):
    rng = random.Random(3)
    urls = ["".join(rng.choice(["http", "://", "/", "?", "#", "example", ".", "com", "net", "en/", "/es/", "WWW.", "www.", "é", " "]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for r in u.url_digest(pages(spark, urls), labels(spark, [])).collect():
        host, path = host_path(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.org": ("org", "x.org"), "org": ("org", "org"), "": ("", ""), "m.x.org": ("org", "x.org"), "a.b.c.x.org": ("org", "x.org")}
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("s", u.suffix_of(F.col("h")))
    assert {r.h: (r.s, r.d) for r in rows.withColumn("d", u.domain_of(F.col("h"), F.col("s"))).collect()} == hosts


def reputation(told, of):
    """Plain Python of the shrinkage: told maps host -> (n, bad); hosts have three labels."""
    up = lambda level: {k: tuple(map(sum, zip(*[v for h, v in level.items() if h.split(".", 1)[1] == k], strict=True))) for k in {h.split(".", 1)[1] for h in level}}
    domains = up(told)
    suffixes = up(domains)
    n, bad = map(sum, zip(*suffixes.values(), strict=True))

    def strength(level, mean):
        k, total = len(level), sum(n for n, _ in level.values())
        if k < 2 or total <= k:
            return of.most
        b = sum(n * (x / n - mean(h)) ** 2 for h, (n, x) in level.items()) / (k - 1)
        w = sum(n * (x / n) * (1 - x / n) for n, x in level.values()) / (total - k)
        n0 = (total - sum(n * n for n, _ in level.values()) / total) / (k - 1)
        rho = (b - w) / (b + (n0 - 1) * w) if b + (n0 - 1) * w else 0
        return min(max((1 - rho) / rho, of.least), of.most) if rho > 0 else of.most

    def shrink(level, mean, prior):
        m = strength(level, mean)
        return {h: (x + m * prior(h)) / (n + m) for h, (n, x) in level.items()}, m

    s, _ = shrink(suffixes, lambda h: bad / n, lambda h: bad / n)
    d, _ = shrink(domains, lambda h: suffixes[h.split(".", 1)[1]][1] / suffixes[h.split(".", 1)[1]][0], lambda h: s[h.split(".", 1)[1]])
    p, m = shrink(told, lambda h: domains[h.split(".", 1)[1]][1] / domains[h.split(".", 1)[1]][0], lambda h: d[h.split(".", 1)[1]])
    return {h: (p[h], p[h] - of.z * (p[h] * (1 - p[h]) / (told[h][0] + m + 1)) ** 0.5) for h in told}


def test_reputation_shrinks_and_blocks(spark):
    rng, told = random.Random(5), {}
    for tld in ("org", "edu", "io"):
        for d in range(6):
            for h in range(5):
                n = rng.choice([1, 2, 5, 30])
                rate = 0.95 if (tld, d) == ("io", 0) else 0.1
                told[f"h{h}.d{d}.{tld}"] = (n, sum(rng.random() < rate for _ in range(n)))
    told["h0.d5.org"], told["h1.d0.org"] = (1, 1), (200, 195)
    outcomes = [(h, int(i < bad)) for h, (n, bad) in told.items() for i in range(n)] + [("h0.d1.org", None)]
    got = {r.host: r for r in u.host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    want = reputation(told, u.Reputation())
    assert set(got) == set(want)
    for h, (mean, bound) in want.items():
        assert (got[h].n, got[h].bad) == told[h] and abs(got[h].posterior - mean) < 1e-9 and abs(got[h].bound - bound) < 1e-9
    assert got["h1.d0.org"].bound > 0.5 > got["h0.d5.org"].bound  # one bad page is not enough, 195 of 200 are
    assert all(got[h].posterior > 0.5 for h in told if h.endswith("d0.io"))


def test_bad_hosts_are_blocked_and_rules_come_first(spark):
    urls = [f"http://bad.x.org/{i}" for i in range(60)] + [f"http://good.x.org/{i}" for i in range(60)] + ["http://bad.x.com/1"] * 60 + ["http://x.net/es/1"] * 9
    rows = [(i, 0 if i < 50 or i >= 120 else 1, 0) for i in range(0, 189, 1) if i % 60 < 50] + [(5, None, 0), (9_999, 0, 1), (None, 0, 0)]
    got = u.url_digest(pages(spark, urls), labels(spark, rows)).collect()
    verdicts = {(r.host, r.verdict, r.method) for r in got}
    assert verdicts == {("bad.x.org", "block", "reputation"), ("good.x.org", "allow", "reputation"), ("bad.x.com", "allow", "rule"), ("x.net", "block", "rule")}
    assert len(got) == len(urls)


def test_long_lists_of_hosts_are_not_broadcast(spark, monkeypatch):
    urls = [f"http://bad.x.org/{i}" for i in range(60)] + ["http://y.org/"]
    rows = labels(spark, [(i, 0, 0) for i in range(60)])
    want = sorted(u.url_digest(pages(spark, urls), rows).collect())
    monkeypatch.setattr(u, "BROADCAST_BYTES", 0)
    assert sorted(u.url_digest(pages(spark, urls), rows).collect()) == want


def test_empty_tables(spark):
    assert u.url_digest(pages(spark, []), labels(spark, [(1, 0, 0)])).collect() == []
    assert u.url_digest(pages(spark, []), labels(spark, [])).collect() == []
