from credsift.llm import reputation


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame(list(outcomes), "page_id long, n int, bad int")
    return {r["page_id"]: r for r in reputation.filter_urls(pages, labels, **more).collect()}


CASES = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/"),
    ("https://example.net/fr/", "example.net", "/fr/", "net/"),
    ("http://example.net", "example.net", "", None),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
    ("x://b.example.com/de/1", "b.example.com", "/de/1", "example.com/de/"),
    ("x://org/fr/", "org", "/fr/", "org/fr/"),
    ("x://a.org/FR/", "a.org", "/FR/", None),
    ("x://h#a/b?c", "h", "", None),
    ("x://h?a://b/c", "h", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("no scheme", "", "", None), ("", "", "", None), (None, "", "", None), ("://", "", "", None),
]


def test_rules(spark):
    got = judged(spark, [url for url, *_ in CASES])
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == {"net/": "block", "example.com/de/": "block"}.get(rule, "allow")


def test_reputation_blocks_certainly_bad_hosts_only(spark):
    urls = ["x://bad.com/"] * 60 + ["x://good.com/"] * 200 + ["x://twice.com/"] * 2 + ["x://new.bad.com/"]
    outcomes = [(i, 1, 1) for i in range(55)] + [(60 + i, 1, 0) for i in range(200)] + [(260, 1, 1), (261, 1, 1)]
    got = judged(spark, urls, outcomes)
    assert got[0]["verdict"] == "block" and got[0]["n_labelled"] == 55
    assert got[100]["verdict"] == "allow"
    assert got[260]["verdict"] == "allow"  # two bad pages are not certain enough
    assert got[262]["n_labelled"] == 0


def test_shrinking(spark):
    """A host without labels has its domain's rate; one with many has its own."""
    hosts = spark.createDataFrame(
        [("a.x.com", 100, 90), ("b.x.com", 0, 0), ("c.y.com", 100, 1), ("d.y.com", 1, 1)], "host string, n long, bad long"
    )
    got = {r["host"]: r for r in reputation.host_reputation(hosts).collect()}
    assert got["b.x.com"]["rate"] > 0.5 and got["a.x.com"]["rate"] > 0.6
    assert got["c.y.com"]["rate"] < got["d.y.com"]["rate"] < 0.9
    assert all(0 <= r["lower"] <= r["rate"] <= 1 for r in got.values())


def test_empty_repeated_and_clashing(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(1, "x://a.com/", "r"), (1, "x://a.com/", "r"), (None, None, "r")], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1)], "page_id long, n int, bad int")
    got = reputation.filter_urls(pages, labels).collect()
    assert len(got) == 3 and [r["n_labelled"] for r in got if r["page_id"] == 1] == [4, 4]


def test_two_label_suffixes(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "")], "host string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in reputation.parent_domains(hosts, reputation.TWO_LABEL_SUFFIXES).collect()}
    assert got["a.b.co.uk"] == got["b.co.uk"] == ("co.uk", "b.co.uk")
    assert got["co.uk"] == ("co.uk", "co.uk") and got["x.y.com"] == ("com", "y.com") and got["com"] == ("com", "com") and got[""] == ("", "")
