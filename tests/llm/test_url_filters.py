"""Rules, hosts and paths by hand, and scores against dense matrices."""

import numpy as np

from patchlake.llm.url_filters import DAMPING, ROUNDS, filter_urls, host_edges, host_scores


def tables(spark):
    rows = [
        (1, "http://good.com/", '<a href="http://friend.org/a">x</a> <a href=//mid.org/>y</a>'),
        (2, "https://friend.org/x?q=1#f", '<a href="http://mid.org/">z</a><a href="http://friend.org/own">own</a>'),
        (3, "http://spam.net/es/1", "<a href='http://spam2.info/'>s</a>"),
        (4, "http://feeder.info/p", '<a href="http://spam.net/es/1">s</a><a href="HTTP://SPAM.net/x">s</a>'),
        (5, "http://spam2.info/", '<a href="http://spam.net/fr/">b</a>'),
        (6, "HTTP://WWW.Example.COM/en/a", None), (7, "http://example.com/en/", None), (8, "http://a.example.com/en/b", None), (9, "http://example.com/de/", None),
        (10, None, None), (11, "no scheme", "<a href='http://good.com'>"), (12, "://", ""), (13, "http://xnet/es/", ""), (14, "http://net/es/", ""), (15, "a://b://c/d", ""),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_rules(spark):
    df, _ = tables(spark)
    edges = host_edges(df)
    got = {r.page_id: r for r in filter_urls(df, host_scores(df, edges)).collect()}
    want = {1: ("good.com", "/", "com/", "allow"), 3: ("spam.net", "/es/1", "net/es/", "block"), 6: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 7: ("example.com", "/en/", "example.com/en/", "block"), 8: ("a.example.com", "/en/b", "example.com/en/", "block"), 9: ("example.com", "/de/", "com/", "allow"), 10: ("", "", None, "allow"), 11: ("", "", None, "allow"), 12: ("", "", None, "allow"), 14: ("net", "/es/", "net/es/", "block"), 15: ("b:", "//c/d", None, "allow")}
    for i, x in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == x
    assert got[13].rule is None and got[2].verdict == "allow" and got[2].path == "/x"


def dense(nodes, edges, seeds):
    at = {h: i for i, h in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        m[at[s], at[d]] += w
    push = np.zeros(len(nodes))
    for h, x in seeds.items():
        push[at[h]] = x * (1 - DAMPING)
    total = push.copy()
    for _ in range(ROUNDS):
        push = DAMPING * push @ m
        total += push
    return dict(zip(nodes, total, strict=True))


def test_scores(spark):
    df, _ = tables(spark)
    links = [(r.src, r.dst, r.weight) for r in host_edges(df).collect()]
    assert {(a, b): w for a, b, w in links}["good.com", "mid.org"] == 0.5
    got = {r.host: r for r in host_scores(df, host_edges(df)).collect()}
    nodes = sorted(set(got) | {x for a, b, _ in links for x in (a, b)})
    allowed = {"good.com": 1, "www.example.com": 1, "example.com": 1}
    barred = {"spam.net": 1, "example.com": 1, "a.example.com": 1, "net": 1}
    into = {}
    for a, b, w in links:
        into[b] = into.get(b, 0) + w
    trust = dense(nodes, links, {h: n / 3 for h, n in allowed.items()})
    distrust = dense(nodes, [(b, a, w / into[b]) for a, b, w in links], {h: n / 4 for h, n in barred.items()})
    for h, r in got.items():
        assert abs(r.trust - trust[h]) < 1e-12 and abs(r.distrust - distrust[h]) < 1e-12
    assert got["feeder.info"].distrust > got["feeder.info"].trust


def test_empty_table_and_clashing_names(spark):
    df, _ = tables(spark)
    none = df.where("false")
    assert filter_urls(none, host_scores(none, host_edges(none))).count() == 0
    from pyspark.sql import functions as F

    extra = df.withColumns({"host": F.lit("h"), "rule": F.lit("r"), "blocked": F.lit(1)})
    assert filter_urls(extra, host_scores(extra, host_edges(extra))).count() == df.count()


def test_the_whole_series_on_a_long_chain(spark, tmp_path):
    """Fourteen hosts in a row, the last two linking back, against a dense solve; the query blocks what is far from its seed."""
    from patchlake.llm.queries import op9_url_filters

    chain = [f"h{i:02d}.info" for i in range(13)] + ["spam.net"]
    to = {a: [b] for a, b in zip(chain, chain[1:], strict=False)}
    to["spam.net"] = [chain[11], chain[5]]
    rows = [(i, f"http://{h}/es/", "".join(f'<a href="http://{x}/">x</a>' for x in to[h])) for i, h in enumerate(chain)]
    rows += [(100 + i, f"http://lone{i}.org/", "") for i in range(40)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    edges = host_edges(pages)
    got = {r.host: r for r in host_scores(pages, edges, rounds=None).collect()}
    at = {h: i for i, h in enumerate(chain)}
    m = np.zeros((len(chain), len(chain)))
    for r in edges.collect():
        m[at[r.src], at[r.dst]] = r.weight
    back = m.T / np.maximum(1e-300, m.sum(axis=0)[:, None])
    want = np.linalg.solve((np.eye(len(chain)) - DAMPING * back).T, (1 - DAMPING) * np.eye(len(chain))[-1])
    for h in chain:
        assert abs(got[h].distrust - want[at[h]]) < 1e-10 and got[h].trust == 0
    assert got[chain[0]].distrust > 0
    verdicts = {r.host: r.verdict for r in op9_url_filters(spark, str(tmp_path)).collect()}
    far = [h for h in chain[:7] if want[at[h]] * len(rows) > 1.01]
    assert far and all(verdicts[h] == "block" for h in far) and verdicts["lone1.org"] == "allow"
    assert verdicts == {h: "block" if h in at and want[at[h]] * len(rows) > 1 else "allow" for h in verdicts} | {"spam.net": "block"}
