from hazeloom.llm.urls import judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), (None, "/", "block")]
URLS = [
    "http://a.Example.com/en/1?x#y", "https://www.example.com/en/2", "http://example.com", "http://badexample.com/en/1", "x.net/es/", None, "",
    "ftp://b.net/es/q", "ftp://b.net/esx", "ftp://b.net/e", "http://u://www.example.com/en/", "http://" + "a." * 500 + "example.com/en/" + "z" * 5000, "http://example.com/en/",
]


def brute(url):
    head, sep, rest = (url or "").partition("://")
    host = path = ""
    if sep:
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1:]) if fits else (None, "allow")))


def test_against_brute_force_broadcast_and_salted(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    want = sorted((i, *map(str, brute(u))) for i, u in enumerate(URLS * 2))
    for limit in (100, 0):
        got = judge_urls(pages, rules, broadcast_rows=limit).collect()
        assert sorted((r[0], *map(str, r[1:])) for r in got) == want


def test_repeated_rows_ties_and_empty_tables(spark):
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "h://a.b/")] * 3, "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, rules).collect()] == [(1, "a.b", "/", "a.b/", "block")] * 3
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow"] * 3
