from askgrid.llm import urls
from askgrid.llm.queries import URL_RULES

CASES = [
    ("http://www.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://blog.example.com/en/1", "blog.example.com", "/en/1", "example.com/en/", "block"),
    ("http://myexample.com/en/1", "myexample.com", "/en/1", "com/", "allow"),
    ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
    ("http://a.net/En/", "a.net", "/En/", None, "allow"),
    ("http://com?q", "com", "", None, "allow"),
    ("http://com/", "com", "/", "com/", "allow"),
    ("x://y://z/a#b", "y:", "//z/a", None, "allow"),
    ("a\nb://h\n.org/p", "h\n.org", "/p", None, "allow"),
    ("no host", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://a.org/XXX", "a.org", "/XXX", None, "block"),
    ("http://a.org/xxxl", "a.org", "/xxxl", None, "allow"),
    ("http://a.org/casino-casino", "a.org", "/casino-casino", None, "allow"),
    ("http://a.org/casino?poker", "a.org", "/casino", None, "block"),
    ("http://a.org/" + "x" * 50_000 + "?poker#bet", "a.org", "/" + "x" * 50_000, None, "block"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(k, u, "h", "r") for k, (u, *_) in enumerate(CASES)], "page_id int, url string, host string, __rule string")
    got = urls.judge_urls(df, URL_RULES).orderBy("page_id").select("url_check.*").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [tuple(c[1:]) for c in CASES]
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert urls.judge_urls(df, [], strict=[], soft=[]).where("url_check.verdict = 'block'").count() == 0


def test_no_column_is_lost(spark):
    names = ["judged", "Judged_", "__host", "__path", "__n", "__rule", "host", "n"]
    df = spark.createDataFrame([("http://a.net/es/", *names)], "url string" + "".join(f", `{n}` string" for n in names))
    got = urls.judge_urls(df, URL_RULES)
    assert got.columns == [*df.columns, "url_check"] and got.first()[1:-1] == tuple(names)
