"""URL rules and aliases, against the SQL twin and a walk over the links."""

from compare import connect, difference

from emberline.llm import urls
from emberline.llm.queries import ORACLES, QUERIES, URL_RULES

PAGES = [
    (1, "https://a.example.com/de/x", "<html></html>"),
    (2, "https://alias.test/1", '<LINK rel="canonical" HREF="https://a.example.com/de/x">'),
    (3, "https://alias.test/2", "<meta content='0; url=/1' http-equiv='refresh'>"),
    (4, "https://alias.test/3#top", '<link rel=canonical href="//www.example.net/en/page?a=1&amp;b=2">'),
    (5, "http://www.example.net/x", '<link rel="canonical" href="https://alias.test/4">'),
    (6, "https://alias.test/4", ""),
    (7, "https://alias.test/5", '<link rel="canonical" href="https://shop.net/never-crawled">'),
    (8, "https://alias.test/6/", '<!-- <link rel="canonical" href="https://shop.net/"> --><script>"<link rel=canonical href=https://shop.net/>"</script>'),
    (9, "HTTPS://Alias.TEST/dir/7?q", '<link rel="canonical" href="8">'),
    (10, "https://alias.test/dir/8", '<link rel="canonical" href="https://x.org/fr/ok">'),
    (11, "https://alias.test/9", '<link rel="canonical" href="https://x.org/fr/ok"><meta http-equiv=refresh content="1;url=http://bad.net/">'),
    (12, None, '<link rel="canonical" href="https://shop.net/">'), (13, "no scheme", None), (14, "ftp://Example.NET?x", ""),
    (15, "http://example.net", None), (16, "http://notexample.com/de/", ""), (17, "http://h.net/#/en/", ""), (None, "http://h.org/fr/", ""),
    (6, "https://alias.test/4", ""),
    (20, "https://dots.test/a/b/c", '<link rel=canonical href="../../x/./y">'), (21, "https://dots.test/x/y", '<link rel=canonical href="http://bad.net/1">'),
    (22, "https://dots.test/a/b/d", '<link rel=canonical href="../../../../up/..">'), (23, "https://dots.test/", '<link rel=canonical href="http://bad.net/2">'),
    (24, "https://query.test/p?old=1", '<link rel=canonical href="?q=2">'), (25, "https://query.test/p?q=2", '<link rel=canonical href="http://bad.net/3">'),
    (26, "https://based.test/deep/er/z", '<base target=_top><BASE HREF="/root/"><link rel=canonical href="z">'),
    (27, "https://based.test/root/z", '<link rel=canonical href="http://bad.net/4">'),
    (28, "https://based.test/other", '<base href="https://query.test/p?old=1"><link rel=canonical href="?q=2#top">'),
    (29, "https://alone.test/p?x", '<link rel=canonical href="#top">'), (30, "https://dots.test/a/b/", '<link rel=canonical href="..">'),
    (31, "https://dots.test/a/", '<link rel=canonical href="//x.org/fr/./k/../k">'), (32, "https://x.org/q", '<link rel=canonical href="./fr/../fr/k">'),
]
SCHEMA = "page_id long, url string, html string"


def test_aliases(spark):
    rows = {r["page_id"]: (r["rule"], r["verdict"], r["by_alias"]) for r in urls.judge(spark.createDataFrame(PAGES, SCHEMA), URL_RULES).collect()}
    assert rows[1] == ("example.com/de/", "block", False)
    assert rows[2] == rows[3] == (None, "block", True)
    assert rows[4] == (None, "allow", True)
    assert rows[5] == ("net/", "block", False) and rows[6] == (None, "block", True)
    assert rows[7] == (None, "block", True)  # by a target that was never crawled
    assert rows[8] == (None, "allow", False)
    assert rows[9] == rows[10] == (None, "allow", True)
    assert rows[11] == (None, "allow", True)  # allowed and blocked aliases: the explicit allow goes first
    assert rows[12] == rows[13] == (None, "allow", False)
    assert rows[14] == rows[15] == (None, "allow", False)  # an empty path does not start with /
    assert rows[16] == (None, "allow", False) and rows[17] == ("net/", "block", False) and rows[None] == ("org/fr/", "allow", False)


def test_links_are_resolved_as_browsers_do(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    rows = {r["page_id"]: (r["verdict"], r["by_alias"]) for r in urls.judge(pages, URL_RULES).collect()}
    for i in (*range(20, 29),):
        assert rows[i] == ("block", True), i
    assert rows[29] == ("allow", False) and rows[30] == rows[31] == rows[32] == ("allow", True)
    assert {r["target"] for r in urls.links(pages.where("page_id IN (20, 22, 24, 26, 30, 32)")).collect()} == {
        "https://dots.test/x/y", "https://dots.test/", "https://query.test/p?q=2", "https://based.test/root/z", "https://dots.test/a/", "https://x.org/fr/k"}


def test_hosts_and_paths(spark):
    rows = {r["page_id"]: (r["host"], r["path"]) for r in urls.judge(spark.createDataFrame(PAGES, SCHEMA), URL_RULES).collect()}
    assert rows[9] == ("alias.test", "/dir/7") and rows[12] == rows[13] == ("", "") and rows[14] == ("example.net", "")
    assert rows[4] == ("alias.test", "/3") and rows[17] == ("h.net", "/")


def test_equal_to_sql_with_links(spark, sf, tmp_path):
    spark.createDataFrame(PAGES, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/odd")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/odd/*.parquet")[0], f"{tmp_path}/pages.parquet")
    for folder in (tmp_path, sf):
        found = difference(QUERIES["op8_redirect_blocks"](spark, str(folder)), connect(str(folder)), ORACLES["op8_redirect_blocks"])
        assert found is None, found


def test_seen_redirects_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.test/", ""), (2, "http://b.test/", "")], SCHEMA)
    seen = spark.createDataFrame([("http://a.test", "http://gone.net/x"), (None, "http://b.test/"), ("http://b.test/", None)], "source string, target string")
    rows = {r["page_id"]: r["verdict"] for r in urls.judge(pages, URL_RULES, seen).collect()}
    assert rows == {1: "block", 2: "allow"}
    assert urls.judge(pages.where("false"), URL_RULES).count() == 0
