from catamatch.llm import url_filter as op
from llm.cases import rows

URLS = ["http://a.example.net/en/x", "http://example.net/fr/", "https://EXAMPLE.com/de/1?q", "x://sub.Example.org/fr/y#z",
        "http://b.org", "http://net/", "http://a.net", "nourl", None, "http://fake-example.net/en/", "a://b?c://d/e", "://h/p",
        "http://xexample.com/de/"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op.url_filter(pages, none).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/fr/", "net/", "block"),
        2: ("example.com", "/de/1", "example.com/de/", "block"), 3: ("sub.example.org", "/fr/y", "org/fr/", "allow"),
        4: ("b.org", "", None, "allow"), 5: ("net", "/", "net/", "block"), 6: ("a.net", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("fake-example.net", "/en/", "net/", "block"),
        10: ("b", "", None, "allow"), 11: ("h", "/p", None, "allow"), 12: ("xexample.com", "/de/", None, "allow")}


def test_reputation(spark):
    pages, labels = [], []
    for host, bad, good in (("bad.org", 60, 1), ("sub.bad.org", 0, 0), ("good.org", 1, 60), ("new.com", 1, 0), ("mid.com", 5, 50)):
        for i in range(bad + good + 1):
            pages.append((len(pages), f"http://{host}/p"))
            if i < bad + good:
                labels.append((len(pages) - 1, int(i < bad)))
    pages = spark.createDataFrame(pages, "page_id bigint, url string")
    labels = spark.createDataFrame(labels + [(None, 1), (99999, 1), (0, None), (0, 1)], "page_id bigint, bad int")
    got = {h: v for h, v in rows(op.url_filter(pages, labels).select("host", "verdict").distinct(), "host", "verdict")}
    assert got["bad.org"] == "block"
    assert got["good.org"] == got["new.com"] == got["mid.com"] == "allow"
    score = {h: s for h, s in rows(op.reputation(spark.createDataFrame(
        [("a.x.co.uk", 0, 0), ("b.x.co.uk", 50, 50), ("c.y.co.uk", 50, 0)], "host string, n bigint, bad bigint")), "host", "score")}
    assert score["b.x.co.uk"] > score["a.x.co.uk"] > score["c.y.co.uk"]
    assert op.url_filter(pages.limit(0), labels).collect() == []
    repeated = op.url_filter(pages.limit(1).union(pages.limit(1)), labels)
    assert repeated.count() == 2


def test_long_urls_null_ids_and_clashing_columns(spark):
    long = "http://" + "a." * 30_000 + "net/" + "p" * 200_000
    urls = [(None, long), (None, long), (1, "http://a.org/\nq?x"), (1, None), (None, None)]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    for c in ("n", "bad", "rule", "verdict", "suffix", "domain", "score", "low", "labelled", "path"):
        pages = pages.withColumn(c, op.F.lit("x"))
    labels = spark.createDataFrame([(None, 1), (1, 0)], "page_id bigint, bad int").withColumn("host", op.F.lit("x"))
    got = rows(op.url_filter(pages, labels), "page_id", "host", "path", "rule", "verdict")
    host, path = "a." * 30_000 + "net", "/" + "p" * 200_000
    assert got == sorted([(None, host, path, "net/", "block")] * 2 + [
        (1, "a.org", "/\nq", None, "allow"), (1, "", "", None, "allow"), (None, "", "", None, "allow")], key=repr)
