import re

import numpy as np

from rolemill.llm import url_graph as U
from tests.llm.helpers import by_id

KIND = "page_id long, url string, html string"
LOWER = str.maketrans(U.UPPER, U.UPPER.lower())


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for verdict, r in U.RULES:
        name, _, start = r.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r) > len(best[1])):
            best = (verdict, r)
    return best


URLS = [None, "", "no scheme", "http://A.Example.com/en/x?q=/fr/", "https://www.EXAMPLE.com/en/", "x://com/", "http://xcom/", "http://net/es", "http://a.net/es/1", "http://a.net/fr/1#/es/", "http://a.net?x", "http://a.net#x", "://b.com/y", "http://é.com/ü", "http://a.net\n/fr/", "ftp://u@h:1/p", "http://x/://net/es/", "HTTP://DE.NET/FR/z"]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(99, "http://a.com/" + "long/" * 40_000, "")]
    got = by_id(U.judge_urls(spark.createDataFrame(rows, KIND)), "page_id")
    for i, url, _ in rows:
        host, path = split(url)
        found = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, found and found[1]), url
        if found:
            assert got[i].verdict == found[0]
        assert got[i].verdict in ("allow", "block")


def test_ranks_like_dense_iteration(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{i}.org" for i in range(12)] + ["bad.net", "good.com"]
    rows = [(0, "http://bad.net/es/1", '<a href="http://h0.org/">'), (1, "http://good.com/1", "<a href='//h1.org/x'><a HREF=/own>")]
    for i in range(12):
        links = "".join(f'<a href="https://{hosts[j]}/p?{k}">' for k, j in enumerate(rng.integers(0, 14, 4)))
        rows.append((2 + i, f"http://{hosts[i]}/", links if i % 5 else None))
    settings = U.Spread(rounds=6)
    got = by_id(U.judge_urls(spark.createDataFrame(rows, KIND), settings), "page_id")
    counts = np.zeros((14, 14))
    for _, url, html in rows:
        src = hosts.index(split(url)[0])
        for link in re.findall(r"""(?i)href=["']?([^"'> ]+)""", html or ""):
            dst = src if link.startswith("/own") else hosts.index(split("x:" + link if link.startswith("//") else link)[0])
            counts[src, dst] += src != dst
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    back = share.T / np.where(share.T.sum(1, keepdims=True) > 0, share.T.sum(1, keepdims=True), 1)

    def walk(step, seed):
        rank = seed.copy()
        for _ in range(settings.rounds):
            rank = seed + 0.85 * (rank @ step)
        return rank

    trust = walk(share, np.array([float(h == "good.com") for h in hosts]))
    distrust = walk(back, np.array([float(h == "bad.net") for h in hosts]))
    for page, url, _ in rows:
        i = hosts.index(split(url)[0])
        assert np.isclose(got[page].trust, trust[i]) and np.isclose(got[page].distrust, distrust[i])
        if got[page].rule is None:
            assert got[page].verdict == ("block" if distrust[i] >= 0.5 and distrust[i] > trust[i] else "allow")


def test_who_links_to_blocked_hosts_is_blocked(spark):
    bad = '<a href="http://spam.net/es/9">'
    rows = [(i, f"http://spam.net/es/{i}", None) for i in range(5)] + [(10, "http://fan.org/", bad), (11, "http://else.org/", '<a href="http://fan.org">')]
    got = by_id(U.judge_urls(spark.createDataFrame(rows, KIND), U.Spread()), "page_id")
    assert got[10].verdict == "block" and got[0].verdict == "block"


def test_converged_ranks_like_the_linear_system(spark):
    """Two hosts in a circle and a chain of 12 hosts, whose distrust takes more than 8 rounds."""
    pair = ["a.net", "b.org"]
    rows = [(0, "http://a.net/es/1", "<a href='http://b.org/'>")] + [(i, "http://a.net/x", None) for i in (1, 2, 3, 4, 5)] + [(6, "http://b.org/", "<a href='http://a.net/'>")]
    chain = ["c.net", *(f"c{i}.org" for i in range(1, 12))]
    rows += [(20, "http://c.net/es/1", None)] + [(20 + i, f"http://c{i}.org/", f"<a href='http://{chain[i - 1]}/'>") for i in range(1, 12)]
    hosts = pair + chain
    step = np.zeros((14, 14))
    step[0, 1] = step[1, 0] = 1
    for i in range(2, 13):
        step[i, i + 1] = 1  # against the links
    seed = np.array([1 / 6, 0.0, 1.0] + [0.0] * 11)
    want = np.linalg.solve(np.eye(14) - 0.85 * step.T, seed)
    got = by_id(U.judge_urls(spark.createDataFrame(rows, KIND)), "page_id")
    for page, url, _ in rows:
        assert abs(got[page].distrust - want[hosts.index(split(url)[0])]) < 1e-6
    assert want[0] >= 0.5 and got[1].rule is None and got[1].verdict == "block"


def test_repeated_pages_extra_columns_and_empty(spark):
    rows = [(1, "http://a.org/", "<a href=x>", 1, "z"), (1, "http://a.org/", "<a href=x>", 1, "z")]
    out = U.judge_urls(spark.createDataFrame(rows, KIND + ", rank int, host string"))
    assert out.count() == 2
    assert U.judge_urls(spark.createDataFrame([], KIND)).count() == 0
