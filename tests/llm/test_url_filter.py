from tidegrid.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("Net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block"), ("a.b", "", "block")]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    best = None
    for h, p, v in RULES:
        if h is None or not ((h := h.lower()) == host or host.endswith("." + h)) or not path.startswith(p):
            continue
        key = (len(h + p), len(h), v)
        if best is None or key > best[0]:
            best = (key, h + p, v)
    return (host, path, best[1] if best else None, best[2] if best else "allow")


def test_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com/en", "http://example.com", "x://com/",
        "http://notexample.com/en/1", "https://b.net/es/1", "https://net/es/", "https://net/fr/://x/en/", "http://a.b", "http://x.a.b?q", "http://É.com/ü#", "a://b://c.com/", "http://x.net/es/\nz",
        "http://" + "l." * 5000 + "com/" + "p" * 50000,
    ]
    rows = [(i, u, "kept", "mine") for i, u in enumerate(urls * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter.judge(pages, rules)
    assert out.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect())
    assert got == [(i, *brute(u)) for i, u, _, _ in rows]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    some = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(none, rules).collect() == []
    assert [tuple(r) for r in url_filter.judge(some, rules, default="block").collect()] == [(1, "http://a.com/", "a.com", "/", None, "block")]
