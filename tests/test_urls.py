from urllib.parse import parse_qs, urlencode, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from urlatlas.functions import ids, suffixes
from urlatlas.operators import ingest

GOLDEN = [
    ("https://example.com/path", "https", "example.com", None, "/path"), ("//example.com/path", "http", "example.com", None, "/path"),
    ("https://example.com:8443/path", "https", "example.com", 8443, "/path"), ("https://example.com/a/b/../c", "https", "example.com", None, "/a/c"),
    ("https://example.com/a//b", "https", "example.com", None, "/a/b"), ("https://example.com/path/", "https", "example.com", None, "/path/"),
    ("https://example.com/path?z=1&a=2&m=3", "https", "example.com", None, "/path?a=2&m=3&z=1"),
    ("HTTPS://Example.COM:443/a/../b?z=1&a=2#fragment", "https", "example.com", None, "/b?a=2&z=1"),
    ("HTTPS://WWW.Example.COM:443/Path/To/../Resource?utm_source=test&id=123&utm_source=other#section", "https", "www.example.com", None, "/Path/Resource?id=123&utm_source=test&utm_source=other"),
    ("http://e.com", "http", "e.com", None, "/"), ("http://u:p@e.com/a;b=1?x=1", "http", "e.com", None, "/a?x=1"), ("http://e.com/a/b/..", "http", "e.com", None, "/a"),
    ("http://e.com/a/b/../", "http", "e.com", None, "/a/"), ("http://e.com/..", "http", "e.com", None, "/"), ("http://e.com/?a=3&b=2&a=1", "http", "e.com", None, "/?a=3&a=1&b=2"),
    ("http://e.com/?a&&c=x+y%20%7E", "http", "e.com", None, "/?a=&c=x+y+~"), ("http://e.com/?x=%E9", "http", "e.com", None, "/?x=%EF%BF%BD"),
    ("http://[::1]:8080/x", "http", "::1", 8080, "/x"), ("  http://e.com/x \n", "http", "e.com", None, "/x"), ("ws://e.com/a;b", "ws", "e.com", None, "/a;b"),
]
REJECTED = {"": "empty", None: "null", "https:///path": "no host", "not a url": "no host", "example.com/p": "no host", "mailto:a@b.c": "no host", "http://e.com:99999/": "bad port", "http://[bad/": "no host", "1http://e.com/": "no host"}


def test_golden(spark):
    rows = ingest.components(spark.createDataFrame([(g[0],) for g in GOLDEN], "url string")).collect()
    assert [(r["url"], r["scheme"], r["host"], r["port"], r["path_query"]) for r in rows] == GOLDEN


def test_rejected(spark):
    df = spark.createDataFrame([(u,) for u in REJECTED], "url string")
    assert {r["url"]: r["reason"] for r in ingest.rejected(df).collect()} == REJECTED
    assert ingest.normalise(df, 1).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab=&+%2Fé~*; .c"), max_size=16), min_size=1, max_size=40))
def test_query_matches_the_standard_library(spark, queries):
    urls = [f"http://e.com/?{q}" for q in queries]
    rows = ingest.components(spark.createDataFrame([(u,) for u in urls], "url string")).select("query").collect()
    want = [urlencode(sorted(parse_qs(q, keep_blank_values=True).items()), doseq=True) for q in (urlsplit(u.strip()).query for u in urls)]
    assert [r["query"] for r in rows] == want


ODD_URLS = ["http://e.com?x=/a//b", "?a//b", "#//e.com/", "http:///e.com//x", "//", "///", "a//b", "http:e//x", "http://a@b@c.com:1/x@y", "http://e.com:/", "http://e.com:80:80/", "http://[::1]x:80/", "http://[::1]", "http://[v1.a]:7/", "http://a]b/", "http://e.com/a;b/c;d", "http://e.com/;x", "http://e.com;x/", "http://e.com/%zz?%zz=%", "ht\ttp://e\n.com/a\tb", "\u00a0http://e.com/ \u2003", "http://e.com/./.", "http://e.com/..a/.b/...", "ftp://e.com:21/", "ftps://e.com:0990/", "http://e.com:00080/", "http://e.com:99999999999999999999999999999999999999999/", "HTTP://E.com#?//", "http://?q", "http://#f", "http://e.com/?=&=&&a==b", "x-y.z+1://h/p;q", "1x://h/", "-x://h", "://h", "http://e.com/\u00e9?\u00e9=\u65e5"]


def test_parts_by_one_pattern(spark):
    """Against the standard library's pattern for the parts of a URL, cut as the rules say."""
    import re

    for r in ingest.components(spark.createDataFrame([(u,) for u in ODD_URLS], "url string")).collect():
        clean = re.sub(r"[\t\r\n]", "", r["url"].strip())
        m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?", clean)
        at = m[2].rpartition("@")[2] if m else ""
        port = ""
        if "[" in at or "]" in at:
            found = re.fullmatch(r"\[([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*|v[0-9A-Fa-f]+\.[^\]]+)\](?::([0-9]*))?", at)
            host, port = (found[1], found[2] or "") if found else ("", "")
        else:
            host, _, port = at.partition(":")
        reason = "no host" if not host else "bad port" if port and not (port.isdigit() and int(port) <= 65535) else None
        assert r["reject_reason"] == reason, r
        if reason:
            assert {r[c] for c in ("scheme", "host", "port", "path", "query", "path_query")} == {None}
            continue
        scheme = (m[1] or "http").lower()
        number = int(port) if port else None
        assert (r["scheme"], r["host"]) == (scheme, host.lower())
        assert r["port"] == (None if number == {"http": 80, "https": 443, "ftp": 21, "ftps": 990}.get(scheme) else number)
        kept, cut = [], re.sub(r";[^/]*$", "", m[3]) if scheme in ("http", "ftp") else m[3]
        for part in cut.split("/"):
            kept = kept[:-1] if part == ".." else kept + [part] * (part not in ("", "."))
        assert r["path"] == "/" + "/".join(kept) + "/" * (cut.endswith("/") and bool(kept))


def test_every_expression_is_evaluated_once(spark):
    """The plan of all parts, filtered, has few calls of regular expressions and no copy of them."""
    df = ingest.components(spark.createDataFrame([("http://e.com/",)], "url string")).where("reject_reason is null")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") <= 10 and len(plan) < 20_000


def test_ids(spark):
    known = {"example.com": (-8402009919309104269, "8b"), "example.org": (4627260942063550277, "40"), "test.com": (-5379317987878038173, "b5"), "another.net": (4446529915994598432, "3d")}
    rows = ingest.normalise(spark.createDataFrame([(f"https://{d}/page1",) for d in known], "url string"), 0).collect()
    assert {r["domain"]: (r["domain_id"], r["domain_prefix"]) for r in rows} == known
    assert next(r["url_id"] for r in rows if r["domain"] == "example.com") == -8863303695040264074
    assert all(ids.prefix_of(d) == p for d, (_, p) in known.items())


@pytest.mark.parametrize(("host", "domain"), [("www.example.co.uk", "example.co.uk"), ("a.b.example.com", "example.com"), ("localhost", "localhost"), ("co.uk", "co.uk"), ("x.city.kawasaki.jp", "city.kawasaki.jp"), ("a.b.c.kawasaki.jp", "b.c.kawasaki.jp")])
def test_suffixes(host, domain):
    assert suffixes.Suffixes(["// comment", "com", "uk", "co.uk", "*.kawasaki.jp", "!city.kawasaki.jp"]).registered(host) == domain


def test_hosts_outside_ascii(spark):
    rows = ingest.normalise(spark.createDataFrame([("http://中国.cn/",), ("http://EXAMPLE.com/",)], "url string"), 3)
    assert {r["host"] for r in rows.collect()} == {"xn--fiqs8s.cn", "example.com"}
    assert rows.select(F.min("dataset_id")).first()[0] == 3
