import pytest

from shredline.llm import url_filter as U


def judge(spark, rows, **more):
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    return U.judge_urls(pages, rules, **more).collect()


CASES = {  # url: host, path, rule, verdict (None: the method's)
    "http://A.Com/x?y#z": ("a.com", "/x", "com/", "allow"),
    "http://a.com": ("a.com", "", None, None),
    "https://example.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
    "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
    "https://www.example.com/en/q": ("www.example.com", "/en/q", "www.example.com/en/", "allow"),
    "https://notexample.com/en/q": ("notexample.com", "/en/q", "com/", "allow"),
    "x://a.net/es/": ("a.net", "/es/", "net/es/", "block"),
    "x://a.net/es": ("a.net", "/es", None, None),
    "x://a.net?u=://b.com/": ("a.net", "", None, None),
    "x://É.net#/fr/": ("É.net", "", None, None),
    "no host/here": ("", "", None, "allow"),
    "x:///p": ("", "/p", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(CASES)] + [(0, "http://A.Com/x?y#z", None)]
    got = judge(spark, rows)
    assert len(got) == len(rows)
    urls = list(CASES)
    for g in got:
        host, path, rule, verdict = CASES[urls[g.page_id]]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict in ("allow", "block") if verdict is None else g.verdict == verdict


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts) + '<a href="/local">y</a>'
    got = {g.page_id: g for g in judge(spark, [
        (1, "x://good.com/a", link("friend.org")), (2, "x://friend.org/a", link("pal.org")), (3, "x://pal.org/", None),
        (4, "x://bad.net/es/", ""), (5, "x://farm.org/", "<a href='//bad.net/es/'>x</a>"), (6, "x://ring.org/", link("farm.org")),
        (7, "x://alone.org/", link("elsewhere.org")), (8, "x://bad.net/other", None)])}
    assert {i: g.verdict for i, g in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block",
                                                     6: "block", 7: "allow", 8: "block"}
    assert got[2].trust > got[3].trust > 0 == got[2].distrust and got[5].distrust > got[6].distrust > 0 == got[5].trust


def test_small_ranks_count(spark):
    """A host that gets a thousandth of the distrust at each of five links has a rank of under 1e-15 and is blocked."""
    link = lambda host, n=1: f'<a href="http://{host}/">x</a>' * n
    chain = ["bad.net", "c1.org", "c2.org", "c3.org", "c4.org", "c5.org"]
    rows = [(0, "x://bad.net/es/", None), (50, "x://good.com/", link("pal.org"))]
    rows += [(i, f"x://{chain[i]}/", link(chain[i - 1])) for i in range(1, 6)]
    rows += [(10 + i, f"x://noise{i}.org/", link(chain[i], 1000)) for i in range(5)]
    got = {g.page_id: g for g in judge(spark, rows)}
    assert 0 < got[5].distrust < 1e-15 and {got[i].verdict for i in range(6)} == {"block"} and got[50].verdict == "allow"


def brute_rank(edges, seeds, rounds, damping):
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    rank = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * w for h, w in start.items()}
        for (s, d), w in edges.items():
            new[d] = new.get(d, 0) + damping * rank.get(s, 0) * w / sum(x for (a, _), x in edges.items() if a == s)
        rank = new
    return rank


def test_propagation_equals_brute_force(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("c", "d"): 3.0}
    out = {}
    for (s, _), w in edges.items():
        out[s] = out.get(s, 0) + w
    frame = spark.createDataFrame([("allow", s, d, w / out[s]) for (s, d), w in edges.items()],
                                  "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("allow", "a", 1.0), ("allow", "d", 3.0)], "kind string, host string, weight double")
    got = {r.host: r["rank"] for r in U.propagate(frame, seeds, 5).collect()}
    want = brute_rank(edges, {"a": 1.0, "d": 3.0}, 5, 0.85)
    assert set(got) == {h for h, x in want.items()} and all(abs(got[h] - x) < 1e-12 for h, x in want.items())


def test_seeds_reach_far_hosts(spark):
    """Twelve links from the only seed, and ranks equal those of many rounds of brute force."""
    chain = ["bad.net", *[f"c{i}.org" for i in range(1, 13)]]
    rows = [(0, "x://bad.net/es/", None)] + [
        (i, f"x://{chain[i]}/", f'<a href="http://{chain[i - 1]}/">x</a><a href="http://pal{i}.org/">x</a>') for i in range(1, 13)]
    got = {g.page_id: g for g in judge(spark, rows)}
    assert {g.verdict for g in got.values()} == {"block"}
    edges = {(a, b): 1.0 for a, b in zip(chain, chain[1:])} | {(f"pal{i}.org", chain[i]): 1.0 for i in range(1, 13)}
    want = brute_rank(edges, {"bad.net": 1.0}, 300, 0.85)
    assert all(abs(g.distrust / want[g.host] - 1) < 1e-8 for g in got.values())


@pytest.mark.parametrize("few", [0, U.FEW])
def test_propagation_settles_in_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(U, "FEW", few)
    edges = {("a", "b"): 1.0, ("b", "a"): 1.0, ("b", "c"): 2.0, ("c", "b"): 1.0}
    frame = spark.createDataFrame([("allow", "a", "b", 1.0), ("allow", "b", "a", 1 / 3), ("allow", "b", "c", 2 / 3),
                                   ("allow", "c", "b", 1.0)], "kind string, src string, dst string, share double")
    got = {r.host: r["rank"] for r in U.propagate(frame, spark.createDataFrame([("allow", "a", 2.0)], "kind string, host string, weight double")).collect()}
    want = brute_rank(edges, {"a": 1.0}, 300, 0.85)
    assert set(got) == set(want) and all(abs(got[h] / want[h] - 1) < 1e-8 for h in want)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    assert U.judge_urls(pages, rules).count() == 0
