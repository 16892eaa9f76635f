"""Site operators on fixtures, one for each semantic trap, and on properties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators import headers, links, listings, pages, rules
from pagewarden.sources import site

CASES = [
    ("y.html", "/blog/y.html", ["blog/y.html", "blog/y.html.html", "blog/y.html/index.html"]),
    ("./y.html", "/blog/y.html", ["blog/y.html", "blog/y.html.html", "blog/y.html/index.html"]),
    ("../a.html", "/a.html", ["a.html", "a.html.html", "a.html/index.html"]),
    ("../../../a", "/a", ["a", "a.html", "a/index.html"]),
    ("services/", "/blog/services/", ["blog/services/index.html"]),
    ("/blog/", "/blog/", ["blog/index.html"]),
    ("/", "/", ["index.html"]),
    ("../index.html#home", "/index.html", ["index.html", "index.html.html", "index.html/index.html"]),
    ("a.css?v=2", "/blog/a.css", ["blog/a.css", "blog/a.css.html", "blog/a.css/index.html"]),
    ("a%20b.html", "/blog/a%20b.html", ["blog/a%20b.html", "blog/a%20b.html.html", "blog/a%20b.html/index.html"]),
    ("//cdn.test/x.js", "//cdn.test/x.js", ["cdn.test/x.js", "cdn.test/x.js.html", "cdn.test/x.js/index.html"]),
    ("https://site.test/a/../b.html", "/b.html", ["b.html", "b.html.html", "b.html/index.html"]),
]
SKIPPED = ["?q=1", "#top", "MAILTO:a@b", "http://site.test/a", "HTTPS://site.test/a", "tel:1", "javascript:x"]


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_extraction(spark):
    html = """<iframe data-src="u1"><img src="u2" srcset="u3"><a href='u4'><a href=""><a HREF="u5">"""
    got = links.extract_links(spark.createDataFrame([(1, "u", html), (2, "v", None)], "page_id bigint, url string, html string"))
    assert [r.raw for r in got.orderBy("pos").collect()] == ["u1", "u2", "u4"]


def test_paths_and_candidates(spark):
    raw = [c[0] for c in CASES] + SKIPPED
    df = spark.createDataFrame([(r, "/blog/x.html") for r in raw], "raw string, base string")
    got = {r.raw: (r.path, r.keys) for r in links.checked_paths(df, "base", "site.test").withColumn("keys", urls.candidate_keys(F.col("path"))).collect()}
    assert got == {raw: (path, keys) for raw, path, keys in CASES}
    assert links.checked_paths(df.filter("raw LIKE '//%'"), "base", strict=True).count() == 0


@pytest.mark.parametrize("path", ["/", "/a", "/a/", "/a/./b", "/a/../../b/", "//a//b", "/..", "/a/.."])
def test_resolving_twice_changes_nothing(spark, path):
    once = spark.createDataFrame([(path,)], "p string").select(urls.collapse_dots(F.col("p")).alias("p"))
    assert once.first().p == once.select(urls.collapse_dots(F.col("p")).alias("p")).first().p


def test_last_dots(spark):
    # Written out: a path joined to its page's folder drops a last dot, a URL's path keeps a slash for it.
    joined = {"/a/.": "/a", "/a/./": "/a/", "/a/b/..": "/a", "/a/b/../": "/a/", "/a/..": "/", "/a//b": "/a/b", "/..": "/"}
    of_urls = {"/a/.": "/a/", "/a/./": "/a/", "/a/b/..": "/a/", "/a/b/../": "/a/", "/a/..": "/", "/a//b": "/a//b", "/..": "/", "/a//..": "/a/", "/a/b": "/a/b", "/": "/"}
    for expression, want in ((urls.collapse_dots, joined), (urls.collapse_url_dots, of_urls)):
        df = spark.createDataFrame([(x,) for x in want], "p string")
        assert {r.p: r.q for r in df.select("p", expression(F.col("p")).alias("q")).collect()} == want


def test_attributes_of_links(spark):
    html = """<iframe data-src="u1"><img src="u2" srcset="u3"><a href='u4'><a xhref="u5">"""
    got = links.extract_links(spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string"))
    assert rows_of(got, "attr", "raw") == [("data-src", "u1"), ("href", "u4"), ("src", "u2")]
    loads = [(1, "https://s.test/", a, r) for a, r in (("src", "https://a.test/x"), ("data-src", "https://b.test/"), ("href", "https://c.test/"), ("href", "https://d.test/f.woff2"), ("src", "https://fontana.test/"))]
    df = spark.createDataFrame(loads, "page_id int, url string, attr string, raw string")
    assert rows_of(pages.third_party_origins(df), "page_id", "n_third", "n_font", "ok") == [(1, 2, 1, False)]


def test_long_chains_and_loops(spark):
    rules_ = [(f"/c{k}", f"/c{k + 1}") for k in range(50)] + [(f"/r{k}", f"/r{(k + 1) % 7}") for k in range(7)] + [("/t1", "/t2"), ("/t2", "/r3"), ("/s", "/s"), ("/u", "/s")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rules_)], "line_no int, src string, dst string")
    got = {r.src: (r.hops, r.final, r.loops) for r in links.redirect_chains(df).collect()}
    assert got["/c0"] == (50, "/c50", False) and got["/c49"] == (1, "/c50", False) and len(got) == len(rules_)
    assert got["/r2"] == (7, "/r2", True) and got["/t1"] == (9, "/r3", True) and got["/s"] == (1, "/s", True) and got["/u"] == (2, "/s", True)


REDIRECTS = "/old /new 301\r\n\n/tmp /x 302\n/two /fields\n/old /newer 301\nhttp://a.test/* https://a.test/:splat 301\n/a /b 301\n/b /a 301\n/s /s 301\n/1 /2 301\n/2 /3 301"


def redirect_rules(spark):
    return site.parse_redirects(site.numbered_lines(spark.createDataFrame([(REDIRECTS,)], "value string")))


def test_redirects(spark):
    known = redirect_rules(spark)
    assert rows_of(known, "line_no", "src")[:2] == [(0, "/old"), (4, "/old")] and known.count() == 8
    paths = spark.createDataFrame([("/old",), ("/tmp",), ("http://a.test/x",)], "path string")
    assert {r.path: r.target for r in links.apply_redirects(paths, known).collect()} == {"/old": "/newer", "/tmp": None, "http://a.test/x": None}
    assert {r.path: r.target for r in links.apply_redirects(paths, known, wins="first").collect()}["/old"] == "/new"
    splat = links.apply_splat_redirects(spark.createDataFrame([("http://a.test/x/y?z",), ("http://b.test/",)], "url string"), known)
    assert rows_of(splat, "url", "target") == [("http://a.test/x/y?z", "https://a.test/x/y?z")]
    chains = {r.src: (r.hops, r.final, r.loops) for r in links.redirect_chains(known).collect()}
    assert chains["/1"] == (2, "/3", False) and chains["/a"][2] and chains["/s"] == (1, "/s", True) and chains["/old"] == (1, "/newer", False)


def test_good_and_broken_links_part_all(spark):
    files = spark.createDataFrame([("dir/sub/x.txt", 1), ("a.html", 1), ("d/index.html", 1)], "path string, bytes bigint")
    found = site.inventory(files)
    assert rows_of(found.filter("kind = 'dir'"), "path") == [("d",), ("dir",), ("dir/sub",)]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(["/a", "/d/", "/dir", "/dir/", "/old", "/none", "/none"])], "page_id int, path string")
    broken = links.broken_links(df, found, redirect_rules(spark))
    assert rows_of(broken, "page_id", "path") == [(3, "/dir/"), (5, "/none"), (6, "/none")]
    assert rows_of(links.broken_links(df.repartition(7), found.repartition(3), redirect_rules(spark)), "page_id", "path") == rows_of(broken, "page_id", "path")


def test_header_rules(spark):
    text = "# note\n/*\n  Strict-Transport-Security: max-age=1\n  Content-Security-Policy-Report-Only: default-src 'self' https://ok.test *.cdn.test; img-src *\n/assets/*\n  Cache-Control: public, immutable\n\n/a.xml\n  Content-Type: application/xml: x"
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([(text,)], "value string")))
    assert [tuple(r) for r in known.select("pattern", "name", "value").orderBy("line_no").collect()][2:] == [("/assets/*", "Cache-Control", "public, immutable"), ("/a.xml", "Content-Type", "application/xml: x")]
    wanted = spark.createDataFrame([("s", "hsts", "/*", "strict-transport-security", "present", None), ("s", "imm", "/assets/*", "Cache-Control", "absent", "immutable"), ("s", "txt", "/a.txt", "Content-Type", "present", "text/plain")], "suite string, check_id string, pattern string, name string, op string, literal string")
    assert rows_of(headers.check_headers(known, wanted), "check_id") == [("imm",), ("txt",)]
    own = headers.effective_headers(spark.createDataFrame([("/assets/x.css",), ("/a.xml",)], "path string"), known)
    assert ("/assets/x.css", "Cache-Control", ["public, immutable"]) in rows_of(own, "path", "name", "values") and own.count() == 6
    origins = spark.createDataFrame([("https://ok.test",), ("https://x.cdn.test",), ("https://cdn.test",), ("https://bad.test",)], "origin string")
    assert rows_of(headers.csp_violations(origins, known), "origin") == [("https://bad.test",), ("https://cdn.test",)]


def test_text_rules(spark):
    corpus = spark.createDataFrame([("a", " <?xml <b>Colour</b>"), ("b", "x siteMenu <nav>Blog</nav>"), ("c", "x Blog siteMenu <nav>no</nav>")], "path string, value string")
    wanted = site.expectations(spark, [("s", "1", "a", "starts_with", "<?xml", None, None), ("s", "2", "a", "not_contains", "Colour", None, None), ("s", "3", "z", "contains", "q", None, None), ("s", "4", "b", "matches", "(?i)SITEMENU", None, None), ("s", "5", "b", "not_matches", "n.v", None, None), ("s", "6", "b", "contains", "no", "g", None), ("s", "6", "b", "contains", "Blog", "g", None), ("s", "7", "a", "contains", "no", "g", None)])
    assert rows_of(rules.check_literals(corpus, wanted), "check_id") == [("2",), ("3",)]
    assert rows_of(rules.check_patterns(corpus, wanted), "check_id") == [("5",)]
    assert rows_of(rules.check_any_of(corpus, wanted), "check_id") == [("7",)]
    block = r"(?s)<nav>(.*?)</nav>"
    assert rows_of(rules.check_implication(corpus, "siteMenu", "Blog", True, block), "subject") == [("c",)]
    assert rows_of(rules.check_implication(corpus, "siteMenu", "Blog", False, block), "subject") == [("b",)]
    assert rows_of(rules.check_count(corpus, "x", 1), "subject", "detail") == []
    assert rows_of(rules.scan_forbidden(corpus, ["Blog", "<?xml"]), "subject", "detail") == [("a", "<?xml"), ("b", "Blog"), ("c", "Blog")]
    assert rows_of(rules.check_labels(corpus, ["Blog"]), "subject") == [("a",)]
    groups = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "group string, path string")
    sources = spark.createDataFrame([("s", "1", "g", "contains", "Blog"), ("s", "2", "g", "not_contains", "Colour"), ("s", "3", "h", "contains", "Colour")], "suite string, check_id string, subject string, op string, literal string")
    assert rows_of(rules.check_any_source(corpus, groups, sources), "check_id") == [("2",), ("3",)]


def test_null_texts_and_empty_groups(spark):
    corpus = spark.createDataFrame([("a", None), ("b", "x")], "path string, value string")
    wanted = site.expectations(spark, [("s", "1", "a", "contains", "x", None, None), ("s", "2", "a", "matches", "x", None, None), ("s", "3", "a", "not_contains", "x", None, None), ("s", "4", "a", "count", "x", None, 1), ("s", "5", "a", "contains", "x", "g", None), ("s", "6", "b", "count", "x", None, 1)])
    assert rows_of(rules.check_literals(corpus, wanted), "check_id") == [("1",)]
    assert rows_of(rules.check_patterns(corpus, wanted), "check_id") == [("2",)]
    assert rows_of(rules.check_counts(corpus, wanted), "check_id", "detail") == [("4", "found 0")]
    assert rows_of(rules.check_any_of(corpus, wanted), "check_id") == [("5",)]
    assert rows_of(rules.check_count(corpus, "x", 1), "subject") == [("a",)] and rows_of(rules.check_labels(corpus, ["x"]), "subject") == [("a",)]
    page = spark.createDataFrame([(1, "u", None)], "page_id int, url string, html string")
    assert rules.check_head_markers(page).count() == 2
    groups = spark.createDataFrame([("g", "b"), ("h", "gone")], "group string, path string")
    sources = spark.createDataFrame([("s", str(k), g, op, "x") for k, (g, op) in enumerate([("g", "contains"), ("h", "contains"), ("none", "contains"), ("none", "not_contains"), ("g", "not_contains")])], "suite string, check_id string, subject string, op string, literal string")
    assert rows_of(rules.check_any_source(corpus, groups, sources), "check_id") == [("1",), ("2",), ("4",)]


def test_rules_move_no_text(spark):
    corpus = spark.createDataFrame([("a", "x")], "path string, value string")
    wanted = site.expectations(spark, [("s", str(k), "a", op, "x", group, None) for k, (op, group) in enumerate([("contains", None), ("matches", None), ("contains", "g"), ("contains_if", "x"), ("tag_contains", "x")])])
    groups = spark.createDataFrame([("g", "a")], "group string, path string")
    for found in (rules.check_literals(corpus, wanted), rules.check_patterns(corpus, wanted), rules.check_any_of(corpus, wanted), rules.check_conditions(corpus, wanted), rules.check_tag_rules(corpus, wanted), rules.check_any_source(corpus, groups, wanted.filter("any_group IS NULL").limit(1))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "value" not in "".join(line for line in plan.splitlines() if "Join" in line or "Aggregate" in line)
        found.collect()


def test_policies_by_path(spark):
    text = "/*\n  Content-Security-Policy: default-src https://ok.test; frame-src 'none'\n/a/*\n  Content-Security-Policy: script-src https://js.test; object-src\n"
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([(text,)], "value string")))
    rows = [("/a/x", "script-src", "https://ok.test"), ("/b", "script-src", "https://ok.test"), ("/b", "script-src", "https://js.test"), ("/b", "frame-src", "https://ok.test"), ("/b", "img-src", "https://ok.test"), ("/a/x", "img-src", "https://ok.test"), ("/a/x", "object-src", "https://ok.test")]
    got = headers.csp_violations(spark.createDataFrame(rows, "path string, directive string, origin string"), known)
    assert rows_of(got, "path", "directive", "origin") == sorted([rows[0], rows[2], rows[3], rows[6]])


def test_tags_and_heads(spark):
    html = '<html lang="en"><head><title>T</title><link rel="canonical" href="https://s/a"><meta name="robots" content="noindex"><script type="application/ld+json">{"@type": "X"}</script></head><h1>a</h1><img src="i.png" loading="lazy"><img alt="" src="j.png" width="1"><IFRAME src="e">'
    df = spark.createDataFrame([(1, "https://s/a", html), (2, "https://s/b", "<p>")], "page_id bigint, url string, html string")
    tags = rules.tag_attrs(rules.extract_tags(df, "img"))
    assert rows_of(rules.check_tags(tags, F.lit(True), {"alt": None, "loading": "lazy"}, ("width",)), "detail") == [("forbids width",), ("needs alt",), ("needs loading=lazy",)]
    assert rules.extract_tags(df, "iframe").count() == 1
    assert rows_of(rules.check_head_markers(df), "check_id", "subject") == [("canonical", "https://s/b"), ("structured-data", "https://s/b")]
    head = pages.head_metadata(df).filter("page_id = 1").first()
    assert (head.title, head.canonical, head.robots, head.lang, head.n_h1, head.n_images, head.n_images_without_alt) == ("T", "https://s/a", "noindex", "en", 1, 2, 1)
    site_map = spark.createDataFrame([], "loc string, lastmod date")
    assert listings.unlisted_pages(pages.head_metadata(df), site_map).count() == 0
    assert rows_of(rules.extract_block(df, "(?s)<title>(.*?)</title>"), "block") == [("",), ("T",)]


def test_structured_data_and_dates(spark):
    blocks = ['{"@type": "A", "datePublished": "2026-08-01"}', '{"@graph": [{"@type": "B"}, {"@type": "C"}]}', "{bad"]
    html = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    nodes = pages.jsonld_nodes(spark.createDataFrame([(1, "https://s/a", html)], "page_id bigint, url string, html string"))
    assert sorted(str(r.type) for r in nodes.collect()) == ["A", "B", "C", "None"]
    feed = spark.createDataFrame([("t", "https://s/a", None, "", "Sat, 01 Aug 2026 00:00:00 +0000", "")], site.FEED)
    listed = lambda d: spark.sql(f"SELECT 'https://s/a' AS loc, DATE'{d}' AS lastmod")
    assert pages.date_conflicts(nodes, feed, listed("2026-08-01")).count() == 0
    assert pages.date_conflicts(nodes, feed, listed("2026-07-01")).count() == 1
    assert pages.date_conflicts(nodes, feed, listed("2026-08-02")).count() == 1 and pages.date_conflicts(nodes, feed, listed("2026-08-02"), later_listed=True).count() == 0
    timed = [(k, "u", f'<script type="application/ld+json">{{"timeRequired":"PT8M"}}</script><p>{n} min read</p>') for k, n in ((1, 8), (2, 9))]
    assert rows_of(pages.duration_conflicts(spark.createDataFrame(timed, "page_id bigint, url string, html string")), "page_id", "stated", "shown") == [(2, 8, 9)]
    durations = spark.createDataFrame([("PT8M",), ("PT1H2M",), ("8 min",), ("PT",)], "d string").select(pages.iso_minutes(F.col("d")).alias("m"))
    assert [r.m for r in durations.collect()] == [8, 62, None, None]


def test_listings_and_budgets(spark):
    url = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert rows_of(listings.missing_from(url("s/blog/", "s/a"), url("s/blog/x", "s/a")), "url") == [("s/blog/",)]
    assert rows_of(listings.listing_diff(url("a", "b"), url("b", "c")), "url", "in_left", "in_right") == [("a", True, False), ("c", False, True)]
    known = spark.createDataFrame([("/a", "/b")], "src string, dst string")
    listed = spark.createDataFrame([("https://s/a",), ("https://s/a/b",)], "loc string")
    assert rows_of(listings.redirected_in_sitemap(known, listed, "https://s"), "loc") == [("https://s/a",)]
    files = site.inventory(spark.createDataFrame([("i/a.png", 99), ("i/b.png", 100), ("i/d.css", 7)], "path string, bytes bigint"))
    budgets = spark.createDataFrame([("img", "i/a.png", 100, 50), ("img", "i/b.png", 100, 50), ("img", "i/c.png", 100, 50)], "asset_class string, path string, limit_bytes bigint, preferred_bytes bigint")
    assert rows_of(listings.check_budgets(files, budgets), "subject", "detail") == [("i/b.png", "100 of 100"), ("i/c.png", "no such file")]
    assert rows_of(listings.grade_budgets(files, budgets), "path", "grade") == [("i/a.png", "fair"), ("i/b.png", "over"), ("i/c.png", "missing")]
    used = spark.createDataFrame([(1, "/i/a.png"), (1, "/i/a.png"), (1, "/i/d.css")], "page_id int, path string")
    assert rows_of(listings.page_weight(used, files, 100, 106), "image_bytes", "total_bytes", "heavy") == [(99, 106, True)]
    found = spark.createDataFrame([("s", "a", "x", "y")], "suite string, check_id string, subject string, detail string")
    checks = spark.createDataFrame([("s", "a"), ("s", "b")], "suite string, check_id string")
    assert rows_of(listings.summarise(found, checks), "check_id", "n_failed", "ok") == [("a", 1, False), ("b", 0, True)]
    origins = lambda *u: spark.createDataFrame([(x,) for x in u], "origin string")
    assert rows_of(listings.inventory_diff(origins("a"), origins("b")), "origin", "declared", "observed") == [("a", True, False), ("b", False, True)]


def test_contacts_labels_and_origins(spark):
    df = spark.createDataFrame([(1, "https://s.test/", "tel:1"), (2, "https://www.s.test/b", "tel:1"), (3, "https://s.test/c", "tel:2"), (3, "https://s.test/c", "https://fonts.x.test/f"), (3, "https://s.test/c", "https://t.test/s.js")], "page_id int, url string, raw string")
    assert rows_of(pages.contact_outliers(df), "raw", "usual") == [("tel:2", "tel:1")]
    assert rows_of(pages.third_party_origins(df), "page_id", "n_third", "n_font", "ok") == [(3, 1, 1, False)]
    html = '<a href="/a">Go <b>on</b></a><a href="/b">Go on</a><a aria-label="x" href="/c">y</a><a aria-label="x" href="/c">z</a>'
    anchors = pages.extract_anchors(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string"))
    assert rows_of(pages.ambiguous_labels(anchors), "label", "n_targets") == [("Go on", 2)]


def test_near_duplicate_pages(spark):
    base = " ".join(f"w{k}" for k in range(80))
    texts = [base, base.replace("w40", "other"), base, "short one", " ".join(f"v{k}" for k in range(80)), None]
    df = spark.createDataFrame([(k, "u", None if t is None else f"<nav>x</nav><p>{t}</p>") for k, t in enumerate(texts)], "page_id int, url string, html string")
    assert [(r.page_a, r.page_b) for r in pages.near_duplicates(df).collect()] == [(0, 1)]


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicate_pages_of_large_groups(spark, block):
    # The least page of the group is like no other one; the others are variants of each other.
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base[:50] + [f"z{k}" for k in range(50)])]
    texts += [" ".join(f"n{v}" if k == 3 * v else w for k, w in enumerate(base)) for v in range(30)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(96)} for t in texts]
    want = [(a, b) for a in range(31) for b in range(a + 1, 31) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    df = spark.createDataFrame([(k, "u", f"<p>{t}</p>") for k, t in enumerate(texts)], "page_id int, url string, html string")
    got = pages.near_duplicates(df, **({} if block == 256 else {"block": block}))
    assert len(want) == 435 and sorted((r.page_a, r.page_b) for r in got.collect()) == want


@pytest.mark.parametrize("block", [512, 9])
def test_near_duplicate_classes_of_large_groups(spark, block):
    import random

    rng = random.Random(3)
    texts = []
    for size, edits, length in ((40, 1, 100), (45, 2, 120), (5, 30, 90)):
        base = [f"w{size}x{rng.randrange(500)}" for _ in range(length)]
        for v in range(size):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(length)] = f"n{v}x{rng.randrange(99)}"
            texts.append(" ".join(own))
    texts += [texts[3], texts[3], "too short", None]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} if t and len(t.split()) > 4 else None for t in texts]
    first = [texts.index(t) for t in texts]
    own = [k for k in range(len(texts)) if sets[k] and first[k] == k]
    close = {k: [x for x in own if x != k and len(sets[k] & sets[x]) / len(sets[k] | sets[x]) >= 0.8] for k in own}
    label = {k: k for k in own}
    for _ in own:
        label = {k: min([label[k], *(label[x] for x in close[k])]) for k in own}
    want = sorted((k, first[k], label[first[k]], len(close[first[k]])) for k in range(len(texts)) if sets[k])
    df = spark.createDataFrame([(k, "u", None if t is None else f"<p>{t}</p>") for k, t in enumerate(texts)], "page_id bigint, url string, html string")
    got = rows_of(pages.near_duplicate_classes(df, block=block), "page_id", "text_id", "class_id", "n_links")
    assert got == want and max(r[3] for r in want) >= 39
    assert pages.near_duplicate_classes(df.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.html").write_text("x")
    (tmp_path / "a.html").write_text("<p>\nA</p>")
    (tmp_path / "sub" / "b.html").write_text("B")
    (tmp_path / "sitemap.xml").write_text('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://s/a</loc><lastmod>2026-08-01</lastmod></url></urlset>')
    (tmp_path / "feed.xml").write_text('<rss><channel><item><title>t</title><link>https://s/a</link><guid isPermaLink="true">g</guid><pubDate>Sat, 01 Aug 2026 00:00:00 +0000</pubDate></item></channel></rss>')
    (tmp_path / "robots.txt").write_text("User-agent: *\nSitemap: https://s/sitemap.xml\n")
    (tmp_path / "llms.txt").write_text("# S\n## Main\n- [A](https://s/a): note\n- [B](https://s/b)\n")
    (tmp_path / "m.webmanifest").write_text('{"name": "S", "start_url": "/",\n "icons": [{"src": "i.png", "sizes": "1x1"}]}')
    (tmp_path / "sp ace+1").mkdir()
    (tmp_path / "sp ace+1" / "c%d.html").write_text("C")
    root = str(tmp_path)
    assert rows_of(site.list_files(spark, root).filter("path LIKE '%html'"), "path", "bytes") == [("a.html", 9), ("sp ace+1/c%d.html", 1), ("sub/b.html", 1)]
    nested = tmp_path / ("x" + root)
    nested.mkdir(parents=True)
    (nested / "n.html").write_text("N")
    assert [r.path for r in site.list_files(spark, root).filter("path LIKE '%n.html'").collect()] == [f"x{root}/n.html"]
    assert ("sub/b.html", "B") in rows_of(site.read_pages(spark, root, "files"), "url", "html")
    assert rows_of(site.read_sitemap(spark, f"{root}/sitemap.xml").selectExpr("loc", "string(lastmod) d"), "loc", "d") == [("https://s/a", "2026-08-01")]
    assert site.read_feed(spark, f"{root}/feed.xml").first().guid._VALUE == "g"
    assert [r.sitemap for r in site.read_robots(spark, f"{root}/robots.txt").collect() if r.sitemap] == ["https://s/sitemap.xml"]
    assert rows_of(site.read_llms(spark, f"{root}/llms.txt"), "section", "title", "url", "note") == [("Main", "A", "https://s/a", "note"), ("Main", "B", "https://s/b", "")]
    assert site.read_manifest(spark, f"{root}/m.webmanifest").first().icons[0].src == "i.png"
    texts = spark.createDataFrame([("a", "<?xml ?><urlset>"), ("b", "<html>")], "path string, value string")
    assert rows_of(site.check_sitemap_text(texts), "check_id", "subject") == [("no-html", "b"), ("urlset", "b"), ("xml-declaration", "b")]
    site.write_violations(rules.scan_forbidden(texts, ["html"]), f"{root}/out")
    assert spark.read.parquet(f"{root}/out").count() == 1


def test_stream(spark, tmp_path):
    from pagewarden.streaming import audit

    df = spark.createDataFrame([(1, "u", "<p>")], "page_id bigint, url string, html string")
    df.write.parquet(str(tmp_path / "in"))
    audit.audit_stream(audit.read_page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_words_of_a_page_are_computed_once(spark, monkeypatch):
    """A filter on the words isn't moved below them, where it would compute them again."""
    seen = []
    monkeypatch.setattr(pages, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    df = spark.createDataFrame([(1, "u", "<p>a b c d e f"), (2, "u", "a b")], "page_id bigint, url string, html string")
    placed, sets = pages._page_grams(df, 5)
    assert rows_of(placed, "page_id", "text_id") == [(1, 1)] and [len(r.grams) for r in sets.collect()] == [2]
    assert seen[0].count("regexp_extract_all") == 1
