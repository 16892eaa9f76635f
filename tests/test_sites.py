"""Rules of many sites, page-specific rules, long lists, policy sources, runs, dates and linear page text."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewarden.operators import globs, headers, links, listings, literals, pages, rules
from pagewarden.sources import site


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_rules_of_a_site_say_nothing_about_another(spark):
    files = spark.createDataFrame([("a", "_redirects", "/x /1 301\n/y /1 301"), ("b", "_redirects", "/x /2 301")], "site string, file string, value string")
    known = site.parse_redirects(site.numbered_lines(files))
    assert rows_of(known, "site", "file", "src", "dst") == [("a", "_redirects", "/x", "/1"), ("a", "_redirects", "/y", "/1"), ("b", "_redirects", "/x", "/2")]
    paths = spark.createDataFrame([("a", "/x"), ("b", "/x"), ("b", "/y"), ("c", "/x")], "site string, path string")
    assert rows_of(links.apply_redirects(paths, known, keys=("site",)).fillna("-"), "site", "path", "target") == [("a", "/x", "/1"), ("b", "/x", "/2"), ("b", "/y", "-"), ("c", "/x", "-")]
    no_files = spark.createDataFrame([], "site string, path string")
    assert rows_of(links.broken_links(paths, no_files, known, ("site",)), "site", "path") == [("b", "/y"), ("c", "/x")]
    # Rules without a site hold everywhere.
    assert links.broken_links(paths, no_files, known.drop("site"), ("site",)).count() == 0
    listed = spark.createDataFrame([("https://a/x",), ("https://b/y",), ("https://c/x",)], "loc string")
    assert rows_of(listings.redirected_in_sitemap(known, listed), "site", "loc") == [("a", "https://a/x")]


def test_chains_of_sites(spark):
    known = spark.createDataFrame([("a", 1, "/1", "/2"), ("a", 2, "/2", "https://b/1"), ("b", 1, "/1", "/9"), ("b", 2, "/l", "https://www.a/l"), ("a", 3, "/l", "http://b/l?q"), ("b", 3, "/2", "/3")], "site string, line_no int, src string, dst string")
    got = {(r.site, r.src): (r.hops, r.final_site, r.final, r.loops) for r in links.redirect_chains(known, ("site",)).collect()}
    assert got[("a", "/1")] == (3, "b", "/9", False) and got[("b", "/1")] == (1, "b", "/9", False) and got[("b", "/2")] == (1, "b", "/3", False)
    assert got[("a", "/l")] == (2, "a", "/l", True) and got[("b", "/l")] == (2, "b", "/l", True)


def test_walks_over_wildcards(spark):
    known = spark.createDataFrame(
        [("a.test", 1, "http://*", "https://:splat"), ("a.test", 2, "https://www.*", "https://:splat"), ("a.test", 3, "/old/*", "/new/:splat/"), ("a.test", 4, "/grow/*", "/grow/x/:splat"), ("a.test", 5, "/p", "/q"), ("a.test", 6, "/q", "/p"), ("a.test", 7, "/new/gone/", "https://b.test/z"), ("b.test", 1, "/z", "/end")],
        "site string, line_no int, src string, dst string",
    )
    starts = ["http://www.a.test/old/1?q=1#f", "https://a.test/grow/1", "https://a.test/p", "https://b.test/old/1", "https://a.test/old/gone", "https://a.test/fine", "http://b.test/x"]
    df = spark.createDataFrame([(x,) for x in starts * 2], "url string")
    got = {r.url: (r.hops, r.final, r.outcome) for r in links.follow_redirects(df, known, max_hops=6).collect()}
    assert got == {
        "http://www.a.test/old/1?q=1#f": (3, "https://a.test/new/1/", "ends"),
        "https://a.test/grow/1": (6, "https://a.test/grow/x/x/x/x/x/x/1", "endless"),
        "https://a.test/p": (2, "https://a.test/p", "loops"),
        "https://b.test/old/1": (0, "https://b.test/old/1", "ends"),
        "https://a.test/old/gone": (3, "https://b.test/end", "ends"),
        "https://a.test/fine": (0, "https://a.test/fine", "ends"),
        "http://b.test/x": (0, "http://b.test/x", "ends"),
    }
    assert links.follow_redirects(df.limit(0), known).count() == 0


def matches(pattern, text):
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), text, re.S) is not None


@pytest.mark.parametrize("bound", [10_000, 3])
def test_globs_match_definition(spark, bound, monkeypatch):
    monkeypatch.setattr(globs, "MAX_BROADCAST_RULES", bound)
    rng = random.Random(2)
    parts = ["/", "a", "bc", "/x/", "index", ".html", "%", "_", "!", "é", "1"]
    make = lambda stars: "".join("*" if rng.random() < stars else rng.choice(parts) for _ in range(rng.randrange(1, 7)))
    patterns = [make(0.35) for _ in range(60)] + ["*", "/*", "", "/", "*.html", "*index*", "a*a", "aa"]
    texts = sorted({make(0) for _ in range(80)} | {"", "a", "aa", "aaa", "/"})
    known = spark.createDataFrame([(s, k, p) for k, p in enumerate(patterns) for s in "st" if k % 3 or s == "s"], "site string, line_no int, pattern string")
    paths = spark.createDataFrame([(s, t, "kept") for t in texts for s in "su"], "site string, path string, more string")
    got = rows_of(globs.glob_join(paths, known.drop("site"), "path", "pattern"), "site", "path", "line_no", "more")
    times = lambda k: 2 if k % 3 else 1
    assert got == sorted((s, t, k, "kept") for t in texts for s in "su" for k, p in enumerate(patterns) if matches(p, t) for _ in range(times(k)))
    keyed = rows_of(globs.glob_join(paths, known, "path", "pattern", ("site",)), "site", "path", "line_no")
    assert keyed == sorted(("s", t, k) for t in texts for k, p in enumerate(patterns) if matches(p, t))
    assert globs.glob_join(paths, known.drop("site").limit(0), "path", "pattern").count() == 0


def test_many_globs_with_a_weak_begin_have_no_hot_key(spark):
    known = spark.range(20_000).select(F.col("id").cast("int").alias("line_no"), F.concat(F.lit("*/x"), F.col("id").cast("string")).alias("pattern"))
    paths = spark.range(3000).select(F.concat(F.lit("/blog/x"), F.col("id").cast("string")).alias("path"))
    found = globs.glob_join(paths, known, "path", "pattern")
    assert rows_of(found, "path", "line_no") == sorted((f"/blog/x{k}", k) for k in range(3000))
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_readers_keep_the_file(spark, tmp_path):
    for host, text in (("www.a.test", "/x /1 301\n/y /2 301"), ("b.test", "\n/x /3 301")):
        (tmp_path / host).mkdir()
        (tmp_path / host / "_redirects").write_text(text)
        (tmp_path / host / "_headers").write_text(f"/*\n  X-Site: {host}\n")
        (tmp_path / host / "llms.txt").write_text(f"# S\n## Part {host}\n- [A](https://{host}/a): n\n")
    assert rows_of(site.read_site_redirects(spark, str(tmp_path)), "site", "file", "line_no", "src", "dst") == [("a.test", "www.a.test/_redirects", 0, "/x", "/1"), ("a.test", "www.a.test/_redirects", 1, "/y", "/2"), ("b.test", "b.test/_redirects", 1, "/x", "/3")]
    assert rows_of(site.read_site_headers(spark, str(tmp_path)), "site", "pattern", "name", "value") == [("a.test", "/*", "X-Site", "www.a.test"), ("b.test", "/*", "X-Site", "b.test")]
    assert rows_of(site.parse_llms(site.read_rules(spark, str(tmp_path), "llms.txt")), "file", "section", "url") == [("b.test/llms.txt", "Part b.test", "https://b.test/a"), ("www.a.test/llms.txt", "Part www.a.test", "https://www.a.test/a")]
    assert rows_of(site.read_rules(spark, str(tmp_path / "b.test" / "_redirects")), "file", "line_no", "line") == [("_redirects", 0, ""), ("_redirects", 1, "/x /3 301")]


def test_policy_sources(spark):
    # Policy, page, resources that it allows, resources that it forbids; each case is a site of its own.
    https = "https://site.test/x"
    cases = [
        ("default-src 'self' https://cdn.test/js/ http://up.test", https, ["https://site.test", "https://cdn.test/js/a.js", "https://up.test", "http://up.test/y"], ["https://cdn.test/css/a", "http://site.test", "https://site.test:444", "https://other.test"]),
        ("default-src 'self'", "http://site.test/", ["http://site.test", "https://site.test", "http://site.test:80/x"], ["https://site.test:8443"]),
        ("script-src 'none'", https, [], ["https://site.test"]),
        ("script-src a.test:* *.b.test", https, ["https://a.test:81", "https://x.b.test", "https://y.x.b.test"], ["http://a.test", "https://b.test", "https://x.b.test:444"]),
        ("script-src *", https, ["https://a.test:81", "http://a.test", "wss://a.test"], ["data:x", "blob:https://site.test/1"]),
        ("script-src data: https:", https, ["data:x", "https://q.test:99/z"], ["http://q.test"]),
        ("script-src https://a.test/one", https, ["https://a.test/one", "https://a.test/one?q"], ["https://a.test/one/two"]),
        ("script-src http://a.test:80", https, ["https://a.test", "http://a.test"], ["https://a.test:444"]),
        ("script-src https://a.test; script-src *", https, ["https://a.test"], ["https://b.test"]),
        ("img-src 'self'", https, ["https://b.test"], []),
        ("script-src 'nonce-abc' 'unsafe-inline'", https, [], ["https://site.test"]),
        ("script-src 'self'", None, [], ["https://site.test"]),
    ]
    files = spark.createDataFrame([(str(k), f"/*\n  Content-Security-Policy: {policy}") for k, (policy, *_) in enumerate(cases)], "site string, value string")
    rows = [(str(k), "/p", page, "script-src", x) for k, (_, page, good, bad) in enumerate(cases) for x in good + bad]
    used = spark.createDataFrame(rows, "site string, path string, page string, directive string, origin string")
    found = headers.csp_violations(used, site.parse_headers(site.numbered_lines(files)))
    assert rows_of(found, "site", "origin") == sorted((str(k), x) for k, (*_, bad) in enumerate(cases) for x in bad)


@pytest.mark.parametrize("bound", [10_000, 0])
def test_policies_of_sites(spark, bound, monkeypatch):
    monkeypatch.setattr(headers, "MAX_BROADCAST_RULES", bound)
    files = spark.createDataFrame([("a", "/*\n  Content-Security-Policy: default-src https://one.test"), ("b", "/x/*\n  Content-Security-Policy: default-src https://two.test")], "site string, value string")
    known = site.parse_headers(site.numbered_lines(files))
    used = spark.createDataFrame([(s, p, o) for s in "abc" for p in ("/x/1", "/y") for o in ("https://one.test", "https://two.test")], "site string, path string, origin string")
    want = [("a", "/x/1", "https://two.test"), ("a", "/y", "https://two.test"), ("b", "/x/1", "https://one.test")]
    assert rows_of(headers.csp_violations(used, known), "site", "path", "origin") == want
    assert rows_of(headers.csp_violations(used.drop("path"), known), "site", "origin") == [("a", "https://two.test"), ("b", "https://one.test")]
    own = headers.effective_headers(used.select("site", "path"), known, keys=("site",))
    assert rows_of(own, "site", "path") == [("a", "/x/1"), ("a", "/y"), ("b", "/x/1")]
    wanted = spark.createDataFrame([("s", "p", site_, "/*", "content-security-policy", "present", "one.test") for site_ in "ab"], "suite string, check_id string, site string, pattern string, name string, op string, literal string")
    assert rows_of(headers.check_headers(known, wanted), "subject") == [("b/*",)]


OPS = ["contains", "not_contains", "starts_with", "matches", "not_matches", "count", "contains_if", "not_contains_if", "tag_contains", "tag_not_contains"]


@pytest.mark.parametrize("share,most,rows", [(0.1, 800, 1000), (2.0, 800, 3), (0.0, 2, 1000)])
def test_own_rules_equal_common_ones(spark, share, most, rows, monkeypatch):
    rng = random.Random(4)
    words = ["ab", "b", "<i ", "c>", "x", "<i c>", ""]
    texts = {f"p{k}": " ".join(rng.choice(words) for _ in range(6)) for k in range(12)} | {"null": None, "unasked": "ab"}
    corpus = spark.createDataFrame(list(texts.items()), "path string, value string")
    wanted = []
    for k in range(240):
        op = rng.choice(OPS)
        group = rng.choice(words[:4]) if op in rules.IF_OPS else "<i[^>]*>" if op in rules.TAG_OPS else None
        wanted.append(("s", str(k), rng.choice([*list(texts)[:13], "gone"]), op, rng.choice(words[:5]), group, rng.randrange(3) if op == "count" else None))
    table = site.expectations(spark, wanted)

    def found():
        return sorted(tuple(r) for r in rules.check_rules(corpus, table).collect())

    def holds(op, text, literal, group, n):
        tag = re.search(group, text) if op in rules.TAG_OPS else None
        tag = tag.group(0) if tag else ""
        return {
            "contains": literal in text, "not_contains": literal not in text, "starts_with": text.lstrip().startswith(literal), "matches": re.search(literal, text) is not None, "not_matches": re.search(literal, text) is None,
            "count": len(re.findall(literal, text)) == n, "contains_if": group is None or group not in text or literal in text, "not_contains_if": group is None or group not in text or literal not in text,
            "tag_contains": tag != "" and literal in tag, "tag_not_contains": tag != "" and literal not in tag,
        }[op]

    failed = sorted((check, subject) for _, check, subject, op, literal, group, n in wanted if subject == "gone" or not holds(op, texts[subject] or "", literal, group, n))
    plain = found()
    if share == 0.1:
        checks = (rules.check_literals, rules.check_patterns, rules.check_counts, rules.check_conditions, rules.check_tag_rules)
        assert sorted(tuple(r) for check in checks for r in check(corpus, table).collect()) == plain
    assert [(x[1], x[2]) for x in sorted(plain, key=lambda x: (x[1], x[2]))] == failed
    monkeypatch.setattr(rules, "COMMON", share)
    monkeypatch.setattr(rules, "MOST_COMMON", most)
    monkeypatch.setattr(rules, "RULES_A_ROW", rows)
    assert found() == plain


def test_a_rule_for_each_of_many_pages(spark):
    n = 100_000
    corpus = spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("text of page "), "id").alias("value"))
    wanted = corpus.select(F.lit("s").alias("suite"), F.lit("own").alias("check_id"), F.col("path").alias("subject"), F.lit("contains").alias("op"), F.concat(F.lit("page "), F.substr("path", F.lit(2)), F.when(F.col("path").endswith("77"), F.lit("!")).otherwise(F.lit(""))).alias("literal"))
    began = time.time()
    found = rules.check_literals(corpus, wanted)
    assert found.count() == n / 100 and time.time() - began < 60
    groups = corpus.select(F.lit("g").alias("group"), "path")
    sources = spark.createDataFrame([("s", "1", "g", "contains", "page 99999"), ("s", "2", "g", "contains", "none"), ("s", "3", "g", "not_contains", "page 5")], "suite string, check_id string, subject string, op string, literal string")
    assert rows_of(rules.check_any_source(corpus, groups, sources), "check_id") == [("2",), ("3",)]


@pytest.mark.parametrize("bound,piece", [(10_000, 1 << 16), (5, 40)])
def test_long_lists_of_literals(spark, bound, piece, monkeypatch):
    monkeypatch.setattr(rules, "MAX_BROADCAST_RULES", bound)
    monkeypatch.setattr(rules, "PIECE", piece)
    rng = random.Random(6)
    letters = "ab é\n.*"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = {f"t{k}": make(rng.randrange(0, 200)) for k in range(40)} | {"null": None, "empty": "", "long": make(3000)}
    literals = sorted({make(rng.randrange(1, 9)) for _ in range(150)} | {texts["long"][500:530], "zz", ""})
    corpus = spark.createDataFrame([*texts.items(), *texts.items()], "path string, value string")
    want = sorted((p, x) for p, t in texts.items() for x in literals if x in (t or ""))
    assert rows_of(rules.scan_forbidden(corpus, literals), "subject", "detail") == want
    table = spark.createDataFrame([*[(x,) for x in literals], (None,), ("zz",)], "literal string")
    assert rows_of(rules.find_literals(corpus, table), "path", "literal") == want
    assert rules.find_literals(corpus, table.limit(0)).count() == 0 and rules.find_literals(corpus.limit(0), table).count() == 0


def test_the_plan_of_a_long_list_is_short(spark):
    corpus = spark.range(200).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("a forbidden-"), (F.col("id") * 250).cast("string"), F.lit(" b")).alias("value"))
    plans = {}
    for n in (5_000, 50_000):
        table = spark.range(n).select(F.concat(F.lit("forbidden-"), "id", F.lit(" ")).alias("literal"))
        found = rules.find_literals(corpus, table)
        plans[n] = len(found._jdf.queryExecution().optimizedPlan().toString())
        assert found.count() == n / 250
    assert plans[50_000] < 1.1 * plans[5_000]


def test_texts_and_findings_of_a_long_list_stay_where_they_are(spark):
    titles = [f"a title of page {k}" for k in range(100)]
    table = spark.createDataFrame([(x,) for x in [*titles, "e", "no such title"]], "literal string")
    rows = [(f"p{k}", f"<h1>{titles[k]}</h1>{titles[(k + 3) % 100]}.") for k in range(100)]
    want = {(p, x) for p, t in rows for x in [*titles, "e"] if x in t}
    once = rules.find_literals(spark.createDataFrame(rows, "path string, value string"), table)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in once.collect()) == sorted(want)
    # Paths with several texts, one of them null.
    more = [*rows, ("p5", rows[6][1]), (None, rows[7][1]), (None, rows[7][1] + titles[50]), (None, None)]
    found = rules.find_literals(spark.createDataFrame(more, "path string, value string"), table)
    assert sorted(((r.path or "", r.literal) for r in found.collect())) == sorted({(p or "", x) for p, t in more if t for x in [*titles, "e"] if x in t})


@pytest.mark.parametrize("letters", ["a", "ab", "ab é\n.*\0", 'abcdefghij/"', "é€😀"])
def test_index_of_literals_finds_all_and_nothing_else(letters, monkeypatch):
    rng = random.Random(letters)
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n))).encode()
    for trial in range(12):
        for name, most in (("RANGE", 1 << 20), ("PAIRS", 1 << 20), ("MANY_PAIRS", 1 << 16), ("STEPS", 32)):
            monkeypatch.setattr(literals, name, most if trial % 2 else rng.choice([1, 3, 50]))
        texts = [make(rng.choice([3, 60, 800])) for _ in range(rng.randrange(30))]
        listed = {make(rng.choice([4, 12, 40, 600])) for _ in range(100)} | {t[rng.randrange(1 + len(t)) :] for t in texts[:3]}
        listed = sorted(listed - {b""}) or [b"x"]
        batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))], pa.string()), pa.array(texts, pa.binary())], names=["path", "value"]).slice(trial % 3)
        found = [r for part in literals.contained(batch, literals.Index(pa.array(listed, pa.binary())), rng.choice([7, 64, 1 << 16])) for r in part.to_pylist()]
        assert sorted((r["path"], x) for r in found for x in r["literals"]) == sorted((str(k), x) for k, t in enumerate(texts) if k >= trial % 3 for x in listed if x in t)


def test_parity_of_any_number_of_lists(spark):
    url = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    lists = {"sitemap": url("a", "b", "b"), "page": url("a", "c"), "llms": url("a", "b", "d")}
    assert rows_of(listings.listing_parity(lists), "url", "mask", "listed", "missing") == [("b", 5, ["sitemap", "llms"], ["page"]), ("c", 2, ["page"], ["sitemap", "llms"]), ("d", 4, ["llms"], ["sitemap", "page"])]
    assert rows_of(listings.listing_parity(lists, partial=False), "url")[0] == ("a",)


def test_runs_are_replaced_and_compared(spark, tmp_path):
    kind = "suite string, check_id string, subject string, detail string"
    found = lambda *x: spark.createDataFrame([("s", "c", a, "d") for a in x], kind)
    path = str(tmp_path / "runs")
    site.write_run(found("a", "b", "b"), path, "2026-01")
    site.write_run(found("b", "c"), path, "2026-02")
    for _ in range(2):
        site.write_run(found("a", "b", "b"), path, "2026-01")
    runs = site.read_runs(spark, path)
    assert rows_of(runs, "run", "subject") == [("2026-01", "a"), ("2026-01", "b"), ("2026-02", "b"), ("2026-02", "c")]
    assert rows_of(site.compare_runs(runs, "2026-01", "2026-02"), "subject", "state") == [("a", "fixed"), ("b", "open"), ("c", "new")]
    assert rows_of(site.compare_runs(runs, "2026-02", "none yet"), "state") == [("fixed",), ("fixed",)]


def test_feed_dates(spark):
    cases = {
        "Sat, 01 Aug 2026 00:00:00 +0000": ("2026-08-01", "2026-08-01 00:00:00"), "Sat, 1 Aug 2026 00:00:00 GMT": ("2026-08-01", "2026-08-01 00:00:00"), "1 Aug 26 23:30 EST": ("2026-08-01", "2026-08-02 04:30:00"),
        "Sat, 01 Aug 2026 23:30:00 -0500": ("2026-08-01", "2026-08-02 04:30:00"), "Sun, 2 Aug 2026 01:00:00 +0200": ("2026-08-02", "2026-08-01 23:00:00"), "01 Aug 1999 12:00:00 PDT (summer)": ("1999-08-01", "1999-08-01 19:00:00"),
        "01 Aug 99 12:00 Z": ("1999-08-01", "1999-08-01 12:00:00"), "31 Feb 2026 00:00:00 GMT": (None, None), "01 Foo 2026 00:00:00 GMT": (None, None), "01 Aug 2026 00:00:00 XYZ": ("2026-08-01", None), "soon": (None, None), "1 August 2026 10:00 +0530": ("2026-08-01", "2026-08-01 04:30:00"),
    }
    df = spark.createDataFrame([(x,) for x in cases] + [(None,)], "t string")
    got = {r.t: (r.d, r.i) for r in df.select("t", pages.feed_date(F.col("t")).cast("string").alias("d"), pages.feed_instant(F.col("t")).cast("string").alias("i")).collect()}
    assert got == cases | {None: (None, None)}


def test_page_words_in_linear_time(spark):
    html = ["<nav>a</nav>b<script>c</script><style>d</style>e", "<nav>a<nav>b</nav>c</nav>d", "<NAV x>a</NAV >b</nav>c", "a<nav>b<p>c", "a<script>b</style>c</script>d<script>e", "x < y <b>z</b> w < v", "<style>a</style><style>b", "<navy>a</nav>b", None, "", "<" * 50 + "a", "İ<nav>İ</nav>i"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(html)], "k int, html string")
    plain = F.regexp_extract_all(F.lower(F.regexp_replace("html", r"(?is)<nav\b.*?</nav>|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    for r in df.select("k", plain.alias("a"), pages.page_words(F.col("html")).alias("b")).collect():
        assert r.a == r.b, html[r.k]
    for start in ("<", "<nav>", "<script ", "<style>", "</nav><nav"):
        text = spark.range(1).select(F.repeat(F.lit(start), 1_000_000 // len(start)).alias("html"))
        text.select(F.size(pages.page_words(F.col("html")))).limit(0).collect()
        began = time.time()
        text.select(F.size(pages.page_words(F.col("html")))).collect()
        assert time.time() - began < 3, start


@pytest.mark.parametrize("bound", [100_000, 0])
def test_resources_are_judged_once_for_all_paths(spark, bound, monkeypatch):
    """Rows of paths travel once, to be told apart; a page that isn't known doesn't keep an allowed resource from being found so."""
    monkeypatch.setattr(headers, "MAX_BROADCAST_VERDICTS", bound)
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([("/*\n  Content-Security-Policy: default-src 'self' https://one.test; img-src *\n/x/*\n  Content-Security-Policy: script-src https://two.test",)], "value string")))
    pages = [("/x/1", "https://site.test/x/1"), ("/y", "https://site.test/y"), ("/y", "https://site.test/y"), ("/z", None)]
    used = spark.createDataFrame([(p, page, d, o) for p, page in pages for d in ("script-src", "img-src") for o in ("https://one.test", "https://two.test", "https://site.test", None)], "path string, page string, directive string, origin string")
    found = headers.csp_violations(used, known)
    want = [("/x/1", "https://one.test"), ("/x/1", "https://site.test"), ("/x/1", "https://two.test"), ("/y", "https://two.test"), ("/z", "https://site.test"), ("/z", "https://two.test")]
    assert rows_of(found.filter("origin IS NOT NULL AND directive = 'script-src'"), "path", "origin") == want
    assert found.filter("directive = 'img-src' AND origin IS NOT NULL").count() == 0
    assert found.filter("origin IS NULL").count() == 6
    if bound:
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(path") == 1
