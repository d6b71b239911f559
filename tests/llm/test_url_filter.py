"""URL filters: parsing and rules against brute force, templates on hand-made trees."""

import re

from clickloom.llm import url_filter
from clickloom.llm.queries import QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.01"


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_query_equals_brute_force(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filter"](spark, FOLDER).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        host, path, rule, says = brute(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (says or ("block" if r["purity"] >= 0.8 else "allow"))


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Net", "http://x.example.net/en/1", "http://example.NET?/en/", "a://b.org/fr/x://y",
            "http://net/", "http://notnet/", "http://x.net/a\nb#c?d", "http://é.org/fr/" + "x/" * 3000, "http://b.example.com/de/1", "http://b.example.com/de/1"]
    frame = spark.createDataFrame([(i, u, "h", "t", 0.5) for i, u in enumerate(urls)] + [(None, "http://a.org/", "h", "t", 0.5)],
                                  "page_id long, url string, host string, template string, purity double")
    got = {r["id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(frame, URL_RULES).collect()}
    assert got == {i: brute(u)[:3] for i, u in [*enumerate(urls), (None, "http://a.org/")]}
    assert url_filter.judge(frame.limit(0), URL_RULES).collect() == []


def test_templates_generalise_merge_and_reject(spark):
    words = [f"slug{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    urls = [f"http://s.example.org/blog/{w}" for w in words]  # variable segments
    urls += [f"http://s.example.org/{k}/{i}.html" for k in ("red", "blue") for i in range(50)]  # alike
    urls += [f"http://s.example.org/fr/{i}.html" for i in range(50)]  # allowed by a rule, so unlike red and blue
    urls += [f"http://bad.example.org/x/{i}" for i in range(40)] + [f"http://bad.example.org/x/{w}" for w in words[:200]]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*URL_RULES, *(("block", "bad.example.org", f"/x/{w}") for w in words[:190])]
    rows = url_filter.judge(frame, rules, min_share=0.02).collect()
    by = {urls[r["id"]]: r for r in rows}
    assert by[urls[0]]["template"] == "/blog/*"
    assert by["http://s.example.org/red/1.html"]["template"] == "/blue|red/<n>.html"
    assert by["http://s.example.org/fr/1.html"]["template"] == "/fr/<n>.html"
    late = by[f"http://bad.example.org/x/{words[195]}"]
    assert (late["template"], late["rule"], late["verdict"]) == ("/x/*", None, "block") and late["purity"] > 0.9
    assert by["http://bad.example.org/x/3"]["verdict"] == "allow"
    assert by[urls[0]]["verdict"] == "allow"


def test_small_shares_stay_by_their_own_evidence(spark):
    """Blocked branches below 1% of a host say nothing of the host's other small branches, and are not hidden by them."""
    urls = [f"http://h.example.com/part{k:03d}x/{i}" for k in range(200) for i in range(100)]
    urls += [f"http://h.example.com/de/{i}" for i in range(150)] + [f"http://h.example.com/xy{w}/{i}" for w in "abcde" for i in range(20)]
    urls += [f"http://h.example.com/xya/more{i}x" for i in range(3)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "example.com", "/de/"), *(("block", "example.com", f"/xy{w}/{i}") for w in "abcde" for i in range(1, 10))]
    by = {urls[r["id"]]: r for r in url_filter.judge(frame, rules).collect()}
    assert by["http://h.example.com/de/7"]["template"] == "/de/<n>" and by["http://h.example.com/de/7"]["purity"] > 0.9
    late = by["http://h.example.com/xyc/0"]
    assert late["template"].startswith("/*") and late["template"] != "/*/<n>" and late["rule"] is None and late["verdict"] == "block"
    assert {(by[u]["template"], by[u]["verdict"]) for u in urls if "/part" in u} == {("/*/<n>", "allow")}
