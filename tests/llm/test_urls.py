from vecbench.llm import urlfilter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "/xyz", "block"),
         ("x.a.b", "/x", "allow"), (None, "/", "block"), ("net", "/es/", "allow")]
URLS = ["http://Example.COM/en/a?x=1#f", "https://www.example.com/en/", "https://m.example.com/en/x", "http://notexample.com/en/", "http://example.com", "http://example.com?q",
        "//example.com/", None, "", "http://a.NET/es/1", "http://a.net/esx", "http://net/es/", "http://x.a.b/xyz", "http://listed.org/p/?utm_source=a&b=2&a=1", "http://listed.org/p?a=1&b=2",
        "http://www.listed.org/p/?a=1&b=2#x", "http://listed.org/q", "ftp://h\u00c9.org/\u00e9", "x://y://z/", "http:///nohost", "http://a..b/", "http://net/ES/"]
LISTED = "listed.org/p?a=1&b=2"


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), a, h + p) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    query = rest.split("#")[0].split("?", 1)[1] if "?" in rest.split("#")[0] else ""
    kept = sorted(q for q in query.split("&") if q and q.split("=")[0] not in U.TRACKING)
    canonical = host.removeprefix("www.") + path.removesuffix("/") + ("?" + "&".join(kept) if kept else "") if host else ""
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if canonical == LISTED else "allow", canonical == LISTED


def judge(spark, rows):
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, action string")
    listed = spark.createDataFrame([(LISTED,), (None,), ("",), (LISTED,)], "canonical string")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, canonical string, host string, row string")
    return U.judge_urls(pages, rules, listed)


def test_equals_brute_force(spark):
    rows = [(k, u, "h", "c", "h", "r") for k, u in enumerate(URLS)] + [(3, URLS[0], "", "", "", ""), (None, URLS[1], None, None, None, None)]
    got = sorted([tuple(r) for r in judge(spark, rows).collect()], key=repr)
    assert got == sorted([(r[0], *brute(r[1])) for r in rows], key=repr)
    assert judge(spark, []).count() == 0


def test_shuffled_forms_give_the_same(spark, monkeypatch):
    rows = [(k, u, "h", "c", "h", "r") for k, u in enumerate(URLS)]
    want = sorted([tuple(r) for r in judge(spark, rows).collect()], key=repr)
    monkeypatch.setattr(U, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(U, "BROADCAST_BLOCKS", 0)
    assert sorted([tuple(r) for r in judge(spark, rows).collect()], key=repr) == want


def test_bloom_filter_has_no_false_negatives_and_few_positives(spark):
    keys = spark.range(20000).select(U.F.concat(U.F.lit("k"), "id").alias("key"))
    filter_rows, blocks = U.bloom(keys, 20000)
    assert U.possible(keys, filter_rows, blocks).count() == 20000
    other = spark.range(20000).select(U.F.concat(U.F.lit("other"), "id").alias("key"))
    assert U.possible(other, filter_rows, blocks).count() < 400
