"""Queries on rules of many sites, rules of single pages, long lists, policies, runs and dates; their SQL is written from what the rules mean, not from the code."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators import headers, listings, rules
from pagewarden.operators import links as L
from pagewarden.operators import pages as P
from pagewarden.sources import site
from pagewarden.sources.tables import shared_folder


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return own.withColumns({"host": urls.host(F.col("url")), "path": urls.url_path(F.col("url"))})


def _links(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, pos, raw, host, path of checked links."""
    found = L.extract_links(spark.read.parquet(f"{folder}/pages.parquet")).withColumns({"host": urls.host(F.col("url")), "base": urls.url_path(F.col("url"))})
    return L.checked_paths(found, "base").select("page_id", "pos", "raw", "host", "path")


def _host_rules(links: DataFrame, add: str, divisor: int) -> DataFrame:
    """Rule lines of every host: for the paths that its pages link to, of which some hosts have a rule and others a temporary one, which doesn't count."""
    own = links.select("host", "path").distinct()
    status = F.when((F.length("path") + F.length("host")) % divisor == 0, F.lit("301")).otherwise(F.lit("302"))
    return own.select(F.col("host").alias("site"), F.length("path").alias("line_no"), F.concat_ws(" ", "path", F.concat("path", F.lit(add)), status).alias("line"))


def site_broken_links(spark: SparkSession, folder: str) -> DataFrame:
    """A27 with rules by host: a rule of one host says nothing about the same path on another."""
    found = _links(spark, folder)
    files = found.filter("pos = 1").select("host", F.explode(F.slice(urls.candidate_keys(F.col("path")), 1, 1)).alias("path")).distinct()
    known = site.parse_redirects(_host_rules(found, "?new", 2)).withColumnRenamed("site", "host")
    return L.broken_links(found, files, known, ("host",)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "raw", "host", "path")


def site_redirect_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """A05, A28 by host: two lines for some paths, of which the last counts."""
    found = _links(spark, folder)
    lines = _host_rules(found, "?new", 3).unionByName(_host_rules(found.filter(F.length("host") % 2 == 0), "?newer", 3).withColumn("line_no", F.col("line_no") + 1000))
    known = site.parse_redirects(lines).withColumnRenamed("site", "host")
    return L.apply_redirects(found.select("host", "path").distinct(), known, keys=("host",)).select("host", "path", "target")


def site_redirected_listed(spark: SparkSession, folder: str) -> DataFrame:
    """A30 by host: a sitemap of all pages' own URLs, and redirects of the paths that are asked for with a fragment."""
    own = _pages(spark, folder)
    known = own.filter("contains(url, '#')").select(F.col("host").alias("site"), F.col("path").alias("src"), F.lit("/").alias("dst"))
    listed = own.select(F.concat(F.lit("https://"), "host", "path").alias("loc"))
    return listings.redirected_in_sitemap(known, listed).select("site", "src", "loc")


def site_chains(spark: SparkSession, folder: str) -> DataFrame:
    """B02 by host: every page's number is sent to its half, on the host of that page."""
    own = _pages(spark, folder).select("page_id", "host")
    half = own.select(F.col("page_id").alias("half"), F.col("host").alias("there"))
    pairs = own.filter("page_id > 1").withColumn("half", F.floor(F.col("page_id") / 2)).join(half, "half")
    name = F.concat(F.lit("/p"), F.col("half").cast("string"))
    target = F.when(F.col("host") == F.col("there"), name).otherwise(F.concat(F.lit("https://"), "there", name))
    known = pairs.select(F.col("host").alias("site"), F.lit(1).alias("line_no"), F.concat(F.lit("/p"), F.col("page_id").cast("string")).alias("src"), target.alias("dst"))
    return L.redirect_chains(known, ("site",)).select("site", "src", F.col("hops").cast("bigint").alias("hops"), "final_site", "final", "loops")


WALK_HOPS = 7


def redirect_walks(spark: SparkSession, folder: str) -> DataFrame:
    """B02 with wildcards: all pages' URLs under rules that differ by host: to https, without www, to another folder, for some back again (a loop), for some ever deeper."""
    n = F.length("host")
    lines = [
        (F.lit(True), "http://* https://:splat 301"),
        (F.lit(True), "https://www.* https://:splat 301"),
        (n % 2 == 0, "/en/* /english/:splat 301"),
        (n % 6 == 0, "/english/* /en/:splat 301"),
        (n % 5 == 0, "/de/* /de/x/:splat 301"),
        (F.lit(True), "*.html :splat/ 301"),
    ]
    texts = F.array_compact(F.array(*[F.when(some, F.struct(F.lit(k).alias("line_no"), F.lit(line).alias("line"))) for k, (some, line) in enumerate(lines)]))
    own = _pages(spark, folder)
    known = site.parse_redirects(own.select("host").distinct().select(F.col("host").alias("site"), F.inline(texts)))
    return L.follow_redirects(own.select(urls.strip_suffix(F.col("url")).alias("url")), known, max_hops=WALK_HOPS).select("url", F.col("hops").cast("bigint").alias("hops"), "final", "outcome")


def site_headers(spark: SparkSession, folder: str) -> DataFrame:
    """B03 by host: patterns with their literal part at the begin, at the end or inside, and a rule for all."""
    own = _pages(spark, folder).select(F.col("host").alias("site"), "path").distinct()
    text = F.concat(F.lit("/*\n  X-Site: "), "site", F.lit("\n*.html\n  X-Kind: page\n"), F.when(F.length("site") % 2 == 0, F.lit("/*/1*\n  X-One: 1\n/de/*\n  X-Kind: de")).otherwise(F.lit("/en/*\n  X-Kind: en")))
    known = site.parse_headers(site.numbered_lines(own.select("site").distinct().select("site", text.alias("value"))))
    return headers.effective_headers(own, known, keys=("site",)).select("site", "path", "name", F.array_join("values", "|").alias("values"))


POLICY = "/*\n  Content-Security-Policy: default-src 'self' https://cdn.test/js/ http://up.test; img-src data:; style-src 'none'; font-src *.cdn.test:8443; connect-src *; default-src *"
# Resource (%s: scheme and host of the page, %h: its host).
RESOURCES = [
    "%s/a.js", "http://%h", "https://%h", "%s:8443/x", "https://cdn.test/js/x.js", "https://cdn.test/css/x", "https://cdn.test/js", "http://cdn.test/js/x.js", "http://up.test/x", "https://up.test/x",
    "https://up.test:444/x", "data:text/plain,x", "https://a.cdn.test:8443/f", "http://a.cdn.test:8443/f", "https://cdn.test:8443/f", "wss://up.test/x",
]
DIRECTIVES = ["script-src-elem", "img-src", "style-src", "font-src", "connect-src"]


def policy_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of sources on resources of every page."""
    own = _pages(spark, folder).withColumn("whole", F.lower(F.regexp_extract("url", r"(?i)^(https?://[^/?#]*)", 1)))
    bare = F.regexp_extract("whole", r"://(.*)$", 1)
    made = [F.replace(F.replace(F.lit(x), F.lit("%s"), F.col("whole")), F.lit("%h"), bare) for x in RESOURCES]
    used = own.select("path", F.col("url").alias("page"), F.explode(F.array(*made)).alias("origin"), F.lit(DIRECTIVES).alias("d")).select("path", "page", "origin", F.explode("d").alias("directive"))
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([(POLICY,)], "value string")))
    return headers.csp_violations(used, known)


def page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A21, A22, A24, A25 with rules of each page's own beside common ones; of pages with one URL the first one's."""
    first = spark.read.parquet(f"{folder}/pages.parquet").groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p")).select("p.page_id", "url", "p.html")
    own = first.withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).withColumn("n", F.regexp_count("html", F.lit("<p>")))
    corpus = own.select(F.col("url").alias("path"), F.col("html").alias("value"))
    rule = lambda check, op, literal, group=None, n=None: F.struct(F.lit(check).alias("check_id"), F.lit(op).alias("op"), literal.alias("literal"), (F.lit(None).cast("string") if group is None else group).alias("any_group"), (F.lit(None).cast("int") if n is None else n).alias("n"))
    title = F.col("title")
    each = F.array(
        rule("title", "contains", title),
        rule("word", "not_contains", F.concat(F.substr(title, F.lit(1), F.lit(4)), F.lit(" "))),
        rule("links", "contains", F.concat(F.lit("/p"), F.col("page_id").cast("string"))),
        rule("paragraphs", "count", F.lit("<p>"), n=(F.col("n") + F.col("page_id") % 3 - 1).cast("int")),
        rule("heading", "matches", F.concat(F.lit("(?i)<h1[^>]*>"), F.substr(F.regexp_extract(title, "^[A-Za-z]+", 0), F.lit(1), F.lit(3)))),
        rule("if-nav", "contains_if", F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit("<nav")),
        rule("nav", "contains", F.lit("<nav")),
    )
    wanted = own.select(F.col("url").alias("subject"), F.inline(each)).withColumn("suite", F.lit("s"))
    return rules.check_rules(corpus, wanted).select("check_id", "subject", "detail")


def literal_index(spark: SparkSession, folder: str) -> DataFrame:
    """A31 with a list as long as the table: the first words of every page's title, and every page's path, in all pages and documents' languages."""
    own = _pages(spark, folder)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    literals = own.select(F.explode(F.array(F.concat(F.lit(">"), F.substr(title, F.lit(1), F.lit(9))), F.substr(title, F.lit(5), F.lit(7)), F.concat("path", F.lit('"')), F.substr(title, F.lit(1), F.lit(3)))).alias("literal")).filter("length(literal) > 2")
    corpus = own.select(F.col("url").alias("path"), F.col("html").alias("value"))
    return rules.scan_forbidden(corpus, literals).select("subject", "detail")


def parity_of_lists(spark: SparkSession, folder: str) -> DataFrame:
    """B06 with three lists: pages of a sitemap, of an HTML sitemap and of a list of links."""
    own = _pages(spark, folder)
    loc = F.concat(F.lit("https://"), "host", "path")
    whole = own.select(loc.alias("url"))
    lists = {"sitemap": whole, "page": own.filter("NOT contains(url, '?')").select(loc.alias("url")), "links": own.filter("NOT contains(url, '#')").select(loc.alias("url"))}
    return listings.listing_parity(lists).select("url", "mask", F.array_join("listed", "|").alias("listed"), F.array_join("missing", "|").alias("missing"))


def run_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of two runs, of which the first one was repeated, and what changed."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    own = _pages(spark, folder)
    checks = site.expectations(spark, [("s", "en", "", "contains", 'lang="en"', None, None), ("s", "nav", "", "contains", "<nav", None, None), ("s", "ad", "", "not_contains", 'class="ad"', None, None)]).drop("subject")
    wanted = own.select(F.col("url").alias("subject"), F.inline(F.array(*[F.struct(*[F.lit(v).cast("int" if name == "n" else "string").alias(name) for name, v in r.asDict().items()]) for r in checks.collect()])))
    later = own.withColumn("html", F.replace(F.replace("html", F.lit("<nav"), F.lit("<div")), F.lit('class="ad"'), F.lit("")))
    for run, state in (("1", own), ("2", later), ("1", own)):
        site.write_run(rules.check_literals(state.select(F.col("url").alias("path"), F.col("html").alias("value")), wanted), path, run)
    return site.compare_runs(site.read_runs(spark, path), "1", "2").select("check_id", "subject", "state")


def zoned_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Feed dates with one-digit days, short years, named and numeric zones beside dates of structured data, by stated dates and by instants."""
    own = _pages(spark, folder).select("page_id", (F.col("page_id") % 6).alias("k"), (F.col("page_id") % 27 + 1).alias("day"))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    k, day = F.col("k"), F.col("day").cast("string")
    two, next_day = F.lpad(day, 2, "0"), F.lpad((F.col("day") + 1).cast("string"), 2, "0")
    url = say("https://site.test/", F.col("page_id").cast("string"))
    fed = F.when(k == 0, say("Sat, ", day, " Aug 2026 00:00:00 GMT")).when(k == 1, say(day, " Aug 26 23:30 EST")).when(k == 2, say("Sat, ", two, " Aug 2026 23:30:00 -0500")).when(k == 3, say("Sun, ", next_day, " Aug 2026 01:00:00 +0200")).when(k == 4, say(two, " August 2026 12:00:00 PDT")).otherwise(say(two, " Aug 2026 25:00:00 GMT"))
    published = F.when(k == 1, say("2026-08-", next_day, "T04:30:00Z")).when(k == 2, say("2026-08-", two, "T23:30:00-05:00")).when(k == 3, say("2026-08-", two, "T23:00:00Z")).when(k == 4, say("2026-08-", two, "T18:00:00Z")).otherwise(say("2026-08-", two))
    html = say('<script type="application/ld+json">{"datePublished":"', published, '"}</script>')
    nodes = P.jsonld_nodes(own.select("page_id", url.alias("url"), html.alias("html")))
    feed = own.select(url.alias("link"), fed.alias("pubDate"))
    listed = own.select(url.alias("loc"), F.lit(None).cast("date").alias("lastmod"))
    both = [P.date_conflicts(nodes, feed, listed, instants=x).select("url", F.lit("instants" if x else "dates").alias("basis"), F.col("published").cast("string").alias("published"), F.col("fed").cast("string").alias("fed")) for x in (False, True)]
    return both[0].unionByName(both[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        site_broken_links, site_redirect_lookup, site_redirected_listed, site_chains, redirect_walks, site_headers, policy_sources, page_rules, literal_index, parity_of_lists,
        run_changes, zoned_dates,
    )
}


def oracles(links_sql: str, candidates: Callable[[str], str], collapse: Callable[[str], str], external: str) -> dict[str, str]:
    """The SQL, from the parts that all site queries share."""
    host = lambda u: f"regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/?#:]+)', 1)), '^(?:www|m)\\.', '')"
    path = lambda u: f"coalesce(nullif(regexp_extract({u}, '(?i)^https?://[^/?#]*([^?#]*)', 1), ''), '/')"
    checked = f"""c AS (SELECT page_id, pos, raw, {host("url")} AS host, CASE WHEN prefix(clean, '/') THEN clean ELSE {collapse(f"regexp_extract('/' || ltrim({path('url')}, '/'), '^.*/') || clean")} END AS path
  FROM (SELECT *, regexp_extract(raw, '^[^?#]*') AS clean FROM ({links_sql})) WHERE clean <> '' AND NOT regexp_matches(raw, {external}))"""
    own = f"own AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path FROM pages)"
    title = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
    step = """CASE WHEN prefix(at_, 'http://') THEN 'https://' || substr(at_, 8) WHEN prefix(at_, 'https://www.') THEN 'https://' || substr(at_, 13)
  WHEN length(h) % 2 = 0 AND prefix(p, '/en/') THEN o || '/english/' || substr(p, 5) WHEN length(h) % 6 = 0 AND prefix(p, '/english/') THEN o || '/en/' || substr(p, 10)
  WHEN length(h) % 5 = 0 AND prefix(p, '/de/') THEN o || '/de/x/' || substr(p, 5) WHEN suffix(p, '.html') THEN o || p[:-6] || '/' END"""
    site_of = f"{host('at_')} AS h, {path('at_')} AS p, regexp_extract(at_, '^https?://[^/?#]*') AS o"
    resources = ", ".join(f"""({k}, '{x.replace("'", "''")}')""" for k, x in enumerate(RESOURCES))
    days = "page_id % 6 AS k, page_id % 27 + 1 AS d FROM pages"
    return {
        "site_broken_links": f"""WITH {checked}, f AS (SELECT DISTINCT host, ({candidates("path")})[1] AS key FROM c WHERE pos = 1), g AS (SELECT DISTINCT host, path, unnest({candidates("path")}) AS key FROM c),
k AS (SELECT DISTINCT g.host, g.path FROM g JOIN f ON f.host = g.host AND f.key = g.key)
SELECT page_id, pos::BIGINT AS pos, raw, host, path FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.host = c.host AND k.path = c.path) AND ((length(path) + length(host)) % 2 <> 0 OR contains(path, ' '))""",
        "site_redirect_lookup": f"""WITH {checked} SELECT DISTINCT host, path, CASE WHEN (length(path) + length(host)) % 3 = 0 AND NOT contains(path, ' ') THEN path || CASE WHEN length(host) % 2 = 0 THEN '?newer' ELSE '?new' END END AS target FROM c""",
        "site_redirected_listed": f"WITH {own} SELECT DISTINCT host AS site, path AS src, 'https://' || host || path AS loc FROM own WHERE contains(url, '#')",
        "site_chains": f"""WITH RECURSIVE {own}, w AS (SELECT page_id, host, page_id AS at_, 0 AS hops FROM own WHERE page_id > 1 AND page_id // 2 IN (SELECT page_id FROM own) UNION ALL SELECT page_id, host, at_ // 2, hops + 1 FROM w WHERE at_ > 1 AND at_ // 2 IN (SELECT page_id FROM own)),
l AS (SELECT page_id, host, arg_max(at_, hops) AS at_, max(hops) AS hops FROM w GROUP BY 1, 2)
SELECT l.host AS site, '/p' || l.page_id AS src, l.hops::BIGINT AS hops, o.host AS final_site, '/p' || l.at_ AS final, false AS loops FROM l JOIN own o ON o.page_id = l.at_""",
        "redirect_walks": f"""WITH RECURSIVE s AS (SELECT DISTINCT regexp_extract(url, '^[^?#]*') AS url FROM pages),
w AS (SELECT url, url AS at_, 0 AS hops, [url] AS seen, false AS back FROM s
  UNION ALL SELECT url, target, hops + 1, list_append(seen, target), list_contains(seen, target) FROM (SELECT url, hops, seen, {step} AS target FROM (SELECT *, {site_of} FROM w WHERE NOT back AND hops < {WALK_HOPS})) WHERE target IS NOT NULL),
l AS (SELECT url, arg_max(at_, hops) AS at_, max(hops) AS hops, bool_or(back) AS back FROM w GROUP BY url)
SELECT url, hops::BIGINT AS hops, at_ AS final, CASE WHEN back THEN 'loops' WHEN {step} IS NOT NULL THEN 'endless' ELSE 'ends' END AS outcome FROM (SELECT *, {site_of} FROM l)""",
        "site_headers": f"""WITH {own}, p AS (SELECT DISTINCT host AS site, path FROM own), r AS (SELECT site, path, n, v, k FROM (
SELECT site, path, 'X-Site' AS n, site AS v, 1 AS k FROM p UNION ALL SELECT site, path, 'X-Kind', 'page', 3 FROM p WHERE suffix(path, '.html') UNION ALL SELECT site, path, 'X-One', '1', 5 FROM p WHERE length(site) % 2 = 0 AND regexp_matches(path, '^/.*/1')
UNION ALL SELECT site, path, 'X-Kind', 'de', 7 FROM p WHERE length(site) % 2 = 0 AND prefix(path, '/de/') UNION ALL SELECT site, path, 'X-Kind', 'en', 5 FROM p WHERE length(site) % 2 = 1 AND prefix(path, '/en/')))
SELECT site, path, n AS name, string_agg(v, '|' ORDER BY k) AS values FROM r GROUP BY 1, 2, 3""",
        "policy_sources": f"""WITH {own}, r AS (SELECT DISTINCT path, lower(regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1)) AS whole, prefix(lower(url), 'http://') AS plain, i, replace(replace(x, '%s', whole), '%h', regexp_extract(whole, '://(.*)$', 1)) AS origin
  FROM own, (VALUES {resources}) v(i, x))
SELECT DISTINCT path, directive, origin FROM r, (VALUES ('script-src-elem'), ('img-src'), ('style-src'), ('font-src'), ('connect-src')) d(directive) WHERE NOT CASE directive
  WHEN 'script-src-elem' THEN i IN (0, 2, 4, 8, 9) OR (i = 1 AND plain) WHEN 'img-src' THEN i = 11 WHEN 'style-src' THEN false WHEN 'font-src' THEN i = 12 OR (i = 13 AND plain) ELSE i <> 11 END""",
        "page_rules": f"""WITH t AS (SELECT DISTINCT ON (url) page_id, url, html, {title} AS title, len(regexp_extract_all(html, '<p>')) AS n FROM pages), h AS (SELECT *, '(?i)<h1[^>]*>' || substr(regexp_extract(title, '^[A-Za-z]+'), 1, 3) AS heading FROM t)
SELECT 'word' AS check_id, url AS subject, rtrim('not_contains ' || substr(title, 1, 4)) AS detail FROM h WHERE contains(html, substr(title, 1, 4) || ' ')
UNION ALL SELECT 'links', url, 'contains /p' || page_id FROM h WHERE NOT contains(html, '/p' || page_id) UNION ALL SELECT 'paragraphs', url, 'found ' || n FROM h WHERE page_id % 3 <> 1
UNION ALL SELECT 'heading', url, 'matches ' || heading FROM h WHERE NOT regexp_matches(html, heading) UNION ALL SELECT 'if-nav', url, '<nav needs p' || page_id FROM h WHERE contains(html, '<nav') AND NOT contains(html, 'p' || page_id)
UNION ALL SELECT 'nav', url, 'contains <nav' FROM h WHERE NOT contains(html, '<nav')""",
        "literal_index": f"""WITH l AS (SELECT DISTINCT unnest(['>' || substr({title}, 1, 9), substr({title}, 5, 7), {path("url")} || '"', substr({title}, 1, 3)]) AS literal FROM pages)
SELECT DISTINCT url AS subject, literal AS detail FROM pages JOIN l ON length(literal) > 2 AND contains(html, literal)""",
        "parity_of_lists": f"""WITH {own}, a AS (SELECT DISTINCT 'https://' || host || path AS url FROM own), b AS (SELECT DISTINCT 'https://' || host || path AS url FROM own WHERE NOT contains(url, '?')), c AS (SELECT DISTINCT 'https://' || host || path AS url FROM own WHERE NOT contains(url, '#')),
j AS (SELECT coalesce(a.url, b.url, c.url) AS url, a.url IS NOT NULL AS x, b.url IS NOT NULL AS y, c.url IS NOT NULL AS z FROM a FULL JOIN b ON a.url = b.url FULL JOIN c ON c.url = coalesce(a.url, b.url))
SELECT url, (x::INT + 2 * y::INT + 4 * z::INT)::BIGINT AS mask, concat_ws('|', CASE WHEN x THEN 'sitemap' END, CASE WHEN y THEN 'page' END, CASE WHEN z THEN 'links' END) AS listed,
  concat_ws('|', CASE WHEN NOT x THEN 'sitemap' END, CASE WHEN NOT y THEN 'page' END, CASE WHEN NOT z THEN 'links' END) AS missing FROM j WHERE NOT (x AND y AND z)""",
        "run_changes": """WITH a AS (SELECT DISTINCT 'en' AS check_id, url AS subject, 1 AS r FROM pages WHERE NOT contains(html, 'lang="en"') UNION SELECT 'nav', url, 1 FROM pages WHERE NOT contains(html, '<nav') UNION SELECT 'ad', url, 1 FROM pages WHERE contains(html, 'class="ad"')),
b AS (SELECT check_id, subject FROM a WHERE check_id = 'en' UNION SELECT 'nav', url FROM pages)
SELECT coalesce(a.check_id, b.check_id) AS check_id, coalesce(a.subject, b.subject) AS subject, CASE WHEN a.subject IS NULL THEN 'new' WHEN b.subject IS NULL THEN 'fixed' ELSE 'open' END AS state FROM a FULL JOIN b ON a.check_id = b.check_id AND a.subject = b.subject""",
        "zoned_dates": f"""WITH t AS (SELECT page_id, {days}), s AS (SELECT 'https://site.test/' || page_id AS url, k, DATE '2026-08-01' + (d - 1)::INT AS day, DATE '2026-08-01' + d::INT AS after FROM t)
SELECT url, 'dates' AS basis, strftime(CASE WHEN k = 1 THEN after ELSE day END, '%Y-%m-%d') AS published, strftime(CASE WHEN k = 3 THEN after ELSE day END, '%Y-%m-%d') AS fed FROM s WHERE k IN (1, 3)
UNION ALL SELECT url, 'instants', strftime(day, '%Y-%m-%d'), strftime(day, '%Y-%m-%d') FROM s WHERE k = 4""",
    }
