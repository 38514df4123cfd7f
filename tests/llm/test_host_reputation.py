import re

import pytest

from braidgraph.llm import host_reputation as hr

URLS = ["http://www.Example.com/en/1?x=1", "https://example.com/en/2", "http://a.example.com/fr", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/1#a?b", "ftp://com", "com/en/", None, "", "http://other.org", "http://notexample.com/en/1", "http://b.co.uk/en/?", "http://net/es/", "://x.net/fr/é"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if url and "://" in url else None
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in hr.RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")


@pytest.mark.parametrize("inline,broadcast", [(256, 200_000), (0, 0)])
def test_rules(spark, monkeypatch, inline, broadcast):
    monkeypatch.setattr(hr, "INLINE_RULES", inline)
    monkeypatch.setattr(hr, "BROADCAST_HOSTS", broadcast)
    none = spark.createDataFrame([], "url string, bad int")
    rows = hr.judge_urls(frame(spark, URLS), none, hr.RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == [brute(u) for u in URLS]


def test_reputation(spark):
    outcomes = [("http://bad.site.org/", 1)] * 40 + [("http://good.site.org/", 0)] * 40 + [("http://few.site.org/", 1)] * 2 + [("http://fine.com/", 0)] * 60 + [(f"http://h{i}.com/", i % 5 == 0) for i in range(50)]
    rows = hr.judge_urls(frame(spark, ["http://bad.site.org/1", "http://good.site.org/", "http://few.site.org/", "http://new.site.org/", "http://fine.com/", "http://unseen.xyz/"]), spark.createDataFrame([(u, int(b)) for u, b in outcomes], "url string, bad int"))
    got = {r["host"]: r for r in rows.collect()}
    assert got["bad.site.org"]["verdict"] == "block"
    assert all(got[h]["verdict"] == "allow" for h in got if h != "bad.site.org")
    # Few outcomes are drawn to the domain, none at all inherits it.
    assert got["good.site.org"]["posterior_mean"] < got["new.site.org"]["posterior_mean"] < got["few.site.org"]["posterior_mean"] < got["bad.site.org"]["posterior_mean"]


def test_empty(spark):
    assert hr.judge_urls(frame(spark, []), spark.createDataFrame([], "url string, bad int"), hr.RULES).count() == 0


def test_query(spark, small):
    rows = hr.query(spark, small).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert rule is None or r["verdict"] == verdict


def test_lower_bound(spark):
    from pyspark.sql import functions as F

    import numpy as np

    draw = np.random.default_rng(1)
    for a, b in ((0.5, 0.5), (3.0, 1.0), (40.0, 10.0)):
        logits = (lambda x: np.log(x) - np.log1p(-x))(np.clip(draw.beta(a, b, 400_000), 1e-300, 1 - 1e-16))
        got = spark.range(1).select(hr.lower_bound(F.lit(a), F.lit(b), 1.645)).first()[0]
        assert got == pytest.approx(1 / (1 + np.exp(-(logits.mean() - 1.645 * logits.std()))), rel=0.05)


def levels_of(host, listed=()):
    name = re.sub(r":[0-9]*$", "", host.split("@")[-1]).removesuffix(".")
    if re.match(r"[0-9]{1,3}(\.[0-9]{1,3}){3}$|\[", name):
        return name, "(address)", name
    labels = name.split(".")
    suffix = next((t for i in range(len(labels)) if (t := ".".join(labels[i:])) in listed), None)
    if suffix is None:
        suffix = ".".join(labels[-2:]) if len(labels) > 1 and labels[-2] in hr.SECOND_LEVEL and re.fullmatch("[a-z]{2}", labels[-1]) else labels[-1]
    return name, suffix, ".".join(labels[-len(suffix.split(".")) - 1 :])


HOSTS = ["1.2.3.4", "9.9.3.4:80", "a.example.com:8080", "user:pw@a.example.com", "x.gov.br", "y.x.gov.br", "b.com.sg.", "com", "co.uk", "", "me.blog.host", "you.blog.host", "blog.host", "[2001:db8::1]:443", "a.b.c.d.org"]


@pytest.mark.parametrize("listed", [(), ("blog.host", "org")])
def test_levels(spark, listed):
    from pyspark.sql import functions as F

    names = spark.createDataFrame([(h,) for h in HOSTS], "host string").select(hr.name_of(F.col("host")).alias("name")).distinct()
    table = spark.createDataFrame([(x,) for x in listed], "suffix string") if listed else None
    assert {tuple(r) for r in hr.with_levels(names, table).select("name", "suffix", "domain").collect()} == {levels_of(h, listed) for h in HOSTS}


def slow_posteriors(hosts, outcomes):
    """host -> (n, bad, a, b) by dictionaries."""
    seen = {}
    for host, bad in outcomes:
        if bad is not None:
            n, x = seen.get(levels_of(host), (0, 0))
            seen[levels_of(host)] = (n + 1, x + bad)
    every = (sum(x for _, x in seen.values()) + 0.5) / (sum(n for n, _ in seen.values()) + 1)

    def strength(units):  # (n, bad, mean)
        s = sum(n * (x / n - m) ** 2 for n, x, m in units)
        a, b = sum(m * (1 - m) for _, _, m in units), sum(m * (1 - m) * (n - 1) for n, _, m in units)
        return 1 / min(0.5, max(0.001, (s - a) / b if b else 0.001)) - 1

    def grouped(at):
        out = {}
        for key, (n, x) in seen.items():
            have = out.get(key[at], (0, 0))
            out[key[at]] = (have[0] + n, have[1] + x)
        return out

    suffixes, parents = grouped(1), {k[2]: k[1] for k in seen}
    m = strength([(n, x, every) for n, x in suffixes.values()])
    suffix_rate = {k: (x + m * every) / (n + m) for k, (n, x) in suffixes.items()}
    domains = grouped(2)
    m = strength([(n, x, suffix_rate[parents[k]]) for k, (n, x) in domains.items()])
    domain_rate = {k: (x + m * suffix_rate[parents[k]]) / (n + m) for k, (n, x) in domains.items()}
    m = strength([(n, x, domain_rate[k[2]]) for k, (n, x) in seen.items()])
    out = {}
    for host in hosts:
        key = levels_of(host)
        prior = domain_rate.get(key[2], suffix_rate.get(key[1], every))
        n, x = seen.get(key, (0, 0))
        out[host] = (n, x, (x + m * prior) / (n + m))
    return out


def test_posteriors_equal_a_slow_version(spark):
    import random

    draw = random.Random(3)
    outcomes = [(draw.choice(HOSTS), draw.choice([0, 0, 1, None])) for _ in range(300)] + [("a.b.c.d.org", 1)] * 30
    hosts = [*HOSTS, "new.example.com", "5.5.5.5", "z.gov.br", "nowhere.xyz"]
    got = hr.host_posteriors(spark.createDataFrame([(h,) for h in hosts * 2], "host string"), spark.createDataFrame(outcomes, "host string, bad int")).collect()
    want = slow_posteriors(hosts, outcomes)
    assert len(got) == len(want)
    for r in got:
        assert (r["n_labelled"], r["n_bad"]) == want[r["host"]][:2] and r["posterior_mean"] == pytest.approx(want[r["host"]][2]), r


def test_repeated_ids_long_urls_and_rules_of_one_length(spark):
    long = "http://h.com/" + "x" * 200_000
    rows = spark.createDataFrame([(1, long), (1, long), (1, "http://h.com/b"), (None, "http://h.com/b")], "page_id long, url string")
    rules = [("h.com/b", "block"), ("h.com/x", "allow"), ("h.com/b", "allow"), ("h.com/a", "block")]
    none = spark.createDataFrame([], "url string, bad int")
    got = sorted((str(r["page_id"]), len(r["path"]), r["rule"], r["verdict"]) for r in hr.judge_urls(rows, none, rules).collect())
    assert got == [("1", 2, "h.com/b", "block"), ("1", 200_001, "h.com/x", "allow"), ("1", 200_001, "h.com/x", "allow"), ("None", 2, "h.com/b", "block")]
