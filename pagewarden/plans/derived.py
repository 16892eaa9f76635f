"""Queries of the operators whose inputs the given tables don't have as such: their files, rules and markup are derived from every row of ``pages``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators import headers, listings, rules
from pagewarden.operators import links as L
from pagewarden.operators import pages as P
from pagewarden.sources import site
from pagewarden.sources.tables import shared_folder

SITE = "site.test"


def _own(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, html, host, path, k (0 to 6, by the number) and day (1 to 28)."""
    rows = site.read_pages(spark, f"{folder}/pages.parquet")
    return rows.select("page_id", "url", "html", urls.host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"), (F.col("page_id") % 7).alias("k"), (F.col("page_id") % 28 + 1).alias("day"))


def _day(add: Column | int = 0) -> Column:
    return F.concat(F.lit("2026-08-"), F.lpad((F.col("day") + add).cast("string"), 2, "0"))


def _loc() -> Column:
    return F.concat(F.lit(f"https://{SITE}/p/"), F.col("page_id").cast("string"))


def _rich(own: DataFrame) -> DataFrame:
    """Pages with markup that follows from their number: head markers, images, frames, contacts, labels, structured data."""
    k = F.col("k")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.col("page_id").cast("string")
    late = F.when(k == 3, 1).otherwise(0)
    parts = [
        F.when(k != 1, say('<link rel="canonical" href="', F.when(k == 2, F.lit("https://else.test/")).otherwise(_loc()), '">')),
        F.when(k == 4, F.lit('<meta name="robots" content="noindex">')),
        F.when(k != 5, say('<script type="application/ld+json">{"@type":"Article","datePublished":"', _day(late), '","timeRequired":"PT', (k + 3).cast("string"), 'M"}</script>')),
        F.when(k == 6, F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Person"},{"@type":"Organization"}]}</script>')),
        say("<p>", (F.when(k == 2, k + 9).otherwise(k + 3)).cast("string"), " min read</p>"),
        F.when(k < 5, say('<img src="/i/', k.cast("string"), '.webp" loading="', F.when(k % 2 == 0, F.lit("lazy")).otherwise(F.lit("eager")), '" width="9">')),
        F.when(k == 0, F.lit('<iframe src="https://frames.test/x"></iframe>')).when(k == 1, F.lit('<iframe data-src="https://frames.test/x"></iframe>')),
        F.when(k != 3, F.lit('<link rel="preconnect" href="https://fonts.gstatic.com">')),
        F.when(k == 4, F.lit('<link rel="preconnect" href="https://fonts.gstatic.com">')),
        F.when(k > 4, F.lit('<script src="https://stats.test/s.js"></script>')),
        say('<a href="tel:', F.when(k == 6, F.lit("2")).otherwise(F.lit("1")), '">call</a><a href="/more/', number, '">More</a><a href="/more/', F.when(k == 2, F.lit("x")).otherwise(number), '">More</a>'),
    ]
    html = F.concat(F.coalesce("html", F.lit("")), *[F.coalesce(p, F.lit("")) for p in parts])
    return own.select("page_id", _loc().alias("url"), html.alias("html"), "host", "path", "k", "day")


def _sql_rich() -> str:
    loc = f"'https://{SITE}/p/' || page_id"
    day = lambda add: f"'2026-08-' || lpad((day + {add})::VARCHAR, 2, '0')"
    parts = [
        f"""CASE WHEN k <> 1 THEN '<link rel="canonical" href="' || CASE WHEN k = 2 THEN 'https://else.test/' ELSE {loc} END || '">' ELSE '' END""",
        """CASE WHEN k = 4 THEN '<meta name="robots" content="noindex">' ELSE '' END""",
        f"""CASE WHEN k <> 5 THEN '<script type="application/ld+json">{{"@type":"Article","datePublished":"' || {day("CASE WHEN k = 3 THEN 1 ELSE 0 END")} || '","timeRequired":"PT' || (k + 3) || 'M"}}</script>' ELSE '' END""",
        """CASE WHEN k = 6 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Person"},{"@type":"Organization"}]}</script>' ELSE '' END""",
        "'<p>' || CASE WHEN k = 2 THEN k + 9 ELSE k + 3 END || ' min read</p>'",
        """CASE WHEN k < 5 THEN '<img src="/i/' || k || '.webp" loading="' || CASE WHEN k % 2 = 0 THEN 'lazy' ELSE 'eager' END || '" width="9">' ELSE '' END""",
        """CASE WHEN k = 0 THEN '<iframe src="https://frames.test/x"></iframe>' WHEN k = 1 THEN '<iframe data-src="https://frames.test/x"></iframe>' ELSE '' END""",
        """CASE WHEN k <> 3 THEN '<link rel="preconnect" href="https://fonts.gstatic.com">' ELSE '' END""",
        """CASE WHEN k = 4 THEN '<link rel="preconnect" href="https://fonts.gstatic.com">' ELSE '' END""",
        """CASE WHEN k > 4 THEN '<script src="https://stats.test/s.js"></script>' ELSE '' END""",
        """'<a href="tel:' || CASE WHEN k = 6 THEN '2' ELSE '1' END || '">call</a><a href="/more/' || page_id || '">More</a><a href="/more/' || CASE WHEN k = 2 THEN 'x' ELSE page_id::VARCHAR END || '">More</a>'""",
    ]
    return f"own AS (SELECT *, {_HOST('url')} AS host, {_PATH('url')} AS path, page_id % 7 AS k, page_id % 28 + 1 AS day FROM pages), rich AS (SELECT page_id, {loc} AS url, coalesce(html, '') || {' || '.join(parts)} AS html, host, path, k, day FROM own)"


_HOST = lambda u: f"regexp_replace(lower(regexp_extract({u}, '(?i)^https?://([^/?#:]+)', 1)), '^(?:www|m)\\.', '')"
_PATH = lambda u: f"coalesce(nullif(regexp_extract({u}, '(?i)^https?://[^/?#]*([^?#]*)', 1), ''), '/')"


def onsite_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of links to the site itself, with dots as URLs have them, and of others (null)."""
    own = _own(spark, folder).select("page_id", "path")
    tails = F.explode(F.array(*map(F.lit, ("", "/.", "/..", "/../x", "/./y/", "//z", "/../../../w", "?q=/../a", "#/.."))))
    raw = own.select("page_id", "path", tails.alias("tail")).select("page_id", F.concat(F.lit(f"https://{SITE}"), "path", "tail").alias("raw"))
    raw = raw.union(own.select("page_id", F.concat(F.lit("HTTPS://"), F.lit(SITE), "path")))
    return raw.select("page_id", "raw", urls.onsite_path(F.col("raw"), SITE).alias("path")).distinct()


def folders(spark: SparkSession, folder: str) -> DataFrame:
    """Files named like the pages' paths, and the folders above them."""
    own = _own(spark, folder)
    files = own.groupBy(F.concat("host", F.rtrim("path", F.lit("/")), F.lit("/index.html")).alias("path")).agg(F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("bytes"))
    return site.inventory(files).select("path", "bytes", "kind")


def _header_rules(spark: SparkSession, folder: str) -> DataFrame:
    """file, line_no, pattern, name, value: a rule file for each host, written from its pages."""
    lines = F.concat_ws("\n", F.lit("# rules\n/*\n  Strict-Transport-Security: max-age=31536000"), F.concat(F.lit("/"), F.col("lang"), F.lit("/*\n  Cache-Control: public, max-age="), F.col("n").cast("string"), F.when(F.col("n") % 2 == 0, F.lit(", immutable")).otherwise(F.lit(""))))
    lang = F.element_at(F.split("path", "/"), 2)
    files = _own(spark, folder).groupBy("host").agg(F.min(lang).alias("lang"), F.count("*").alias("n")).select(F.col("host").alias("file"), lines.alias("value"))
    return site.parse_headers(site.numbered_lines(files))


_SQL_RULES = f"""h AS (SELECT {_HOST("url")} AS file, min(string_split({_PATH("url")}, '/')[2]) AS lang, count(*) AS n FROM pages GROUP BY 1),
rules AS (SELECT file, 2 AS line_no, '/*' AS pattern, 'Strict-Transport-Security' AS name, 'max-age=31536000' AS value FROM h
UNION ALL SELECT file, 4, '/' || lang || '/*', 'Cache-Control', 'public, max-age=' || n || CASE WHEN n % 2 = 0 THEN ', immutable' ELSE '' END FROM h)"""


def header_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Rule files of all hosts."""
    return _header_rules(spark, folder).select("file", F.col("line_no").cast("int").alias("line_no"), "pattern", "name", "value")


def header_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Each host's rules beside what is expected of them."""
    known = _header_rules(spark, folder).withColumn("pattern", F.concat("file", "pattern"))
    wanted = known.select("file").distinct().select(F.lit("s").alias("suite"), F.explode(F.array(*[F.struct(F.lit(a).alias("check_id"), F.concat("file", F.lit(b)).alias("pattern"), F.lit(c).alias("name"), F.lit(d).alias("op"), F.lit(e).cast("string").alias("literal")) for a, b, c, d, e in EXPECTED])).alias("e")).select("suite", "e.*")
    return headers.check_headers(known, wanted).select("check_id", "subject", "detail")


EXPECTED = [
    ("hsts", "/*", "strict-transport-security", "present", "max-age=31536000"),
    ("upper", "/*", "Strict-Transport-Security", "present", "Max-Age"),
    ("cached", "/en/*", "Cache-Control", "present", None),
    ("frozen", "/en/*", "Cache-Control", "absent", "immutable"),
]


def headers_in_force(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of every path under one rule file."""
    text = "/*\n  X-A: 1\n/en/*\n  X-A: 2\n  X-B: en\n/*/\n  X-C: folder\n/de/1*\n  X-B: ten"
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([(text,)], "value string")))
    found = headers.effective_headers(_own(spark, folder), known)
    return found.select("path", "name", F.array_join("values", "|").alias("values"))


def policy_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What the pages' paths load, beside a policy for all and one for a part."""
    text = "/*\n  Content-Security-Policy: default-src 'self' https://*.example.com; script-src https://a.example.net\n/en/*\n  Content-Security-Policy-Report-Only: img-src https:"
    known = site.parse_headers(site.numbered_lines(spark.createDataFrame([(text,)], "value string")))
    scheme = F.concat(F.regexp_extract("url", "^(https?)://", 1), F.lit("://"), "host")
    used = _own(spark, folder).select("path", F.explode(F.array(*map(F.lit, ("script-src-elem", "img-src", "frame-src")))).alias("directive"), scheme.alias("origin"), F.col("url").alias("page"))
    return headers.csp_violations(used, known)


def violations_written(spark: SparkSession, folder: str) -> DataFrame:
    """Expectations of every page, and the findings written and read again."""
    path = f"{shared_folder(spark)}/violations-{uuid.uuid4().hex}"
    site.write_violations(_rule_findings(spark, folder), path)
    return spark.read.parquet(path).select("suite", "check_id", "subject", "detail")


RULES = [  # check_id, op, literal, any_group, n
    ("frame-eager", "not_matches", r"(?i)<iframe\b[^>]*\ssrc=", None, None),
    ("one-preconnect", "count", r'rel="preconnect" href="https://fonts\.gstatic\.com"', None, 1),
    ("stats-consent", "contains_if", "consent", "https://stats.test/", None),
    ("no-noindex", "not_contains_if", "noindex", 'rel="canonical"', None),
    ("image-lazy", "tag_contains", 'loading="lazy"', r"<img[^>]+src=[^>]+>", None),
    ("image-size", "tag_not_contains", 'width="9"', r"<img[^>]+[02]\.webp[^>]*>", None),
]


def _rule_findings(spark: SparkSession, folder: str) -> DataFrame:
    rich = _rich(_own(spark, folder))
    corpus = rich.select(F.col("url").alias("path"), F.col("html").alias("value"))
    table = site.expectations(spark, [("s", a, "", op, literal, group, n) for a, op, literal, group, n in RULES]).drop("subject")
    rows = [F.struct(*[F.lit(v).cast("int" if name == "n" else "string").alias(name) for name, v in r.asDict().items()]) for r in table.collect()]
    wanted = rich.select(F.col("url").alias("subject"), F.inline(F.array(*rows)))
    return rules.check_rules(corpus, wanted)


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """A20, A22, A24, A25 from one table of expectations."""
    return _rule_findings(spark, folder).select("check_id", "subject", "detail")


def marked_heads(spark: SparkSession, folder: str) -> DataFrame:
    """A26 where pages have the markers, and where they lack one."""
    return rules.check_head_markers(_rich(_own(spark, folder))).select("check_id", "subject")


def unlisted(spark: SparkSession, folder: str) -> DataFrame:
    """A sitemap names the pages of the first half of each month."""
    own = _own(spark, folder)
    listed = own.filter("day <= 14").select(_loc().alias("loc"))
    return listings.unlisted_pages(P.head_metadata(_rich(own)), listed).select("page_id", "url")


def contact_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Telephone numbers that aren't their host's usual one."""
    found = L.extract_links(_rich(_own(spark, folder)).withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/"))))
    return P.contact_outliers(found).select("host", "kind", "raw", F.col("n").cast("bigint").alias("n"), "usual")


def image_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Local files that each page names, with a size for each image."""
    rich = _rich(_own(spark, folder))
    used = L.checked_paths(L.extract_links(rich).withColumn("base", F.lit("/")), "base").select("page_id", "path")
    files = used.select(F.ltrim("path", F.lit("/")).alias("path")).distinct().select("path", (F.length("path") * 100).cast("bigint").alias("bytes"), F.lit("file").alias("kind"))
    return listings.page_weight(used, files, 900, 9000).select("page_id", F.col("image_bytes").cast("bigint").alias("image_bytes"), F.col("total_bytes").cast("bigint").alias("total_bytes"), "heavy")


def third_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Other hosts that pages load at once."""
    return P.third_party_origins(L.extract_links(_rich(_own(spark, folder)))).select("page_id", "n_third", "n_font", "ok")


def graded_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by size, beside two limits; pages of the last days have no file."""
    own = _own(spark, folder).select("page_id", F.col("url").alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("bytes"), F.lit("file").alias("kind"), "day")
    budgets = own.select("page_id", F.lit("page").alias("asset_class"), "path", F.lit(5000).alias("limit_bytes"), F.lit(2500).alias("preferred_bytes"))
    return listings.grade_budgets(own.filter("day < 27"), budgets, keys=("page_id",))


def label_targets(spark: SparkSession, folder: str) -> DataFrame:
    """B14 on pages that use a label twice, for one target or for two."""
    return P.ambiguous_labels(P.extract_anchors(_rich(_own(spark, folder)))).filter("label = 'More'").select("page_id", "label", "n_targets")


def differing_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in structured data, feed and sitemap."""
    own = _own(spark, folder)
    date = F.concat(F.lit("Sat, "), F.lpad(F.col("day").cast("string"), 2, "0"), F.lit(" Aug 2026 00:00:00 +0000"))
    feed = own.filter("k <> 6").select(_loc().alias("link"), date.alias("pubDate"))
    listed = own.select(_loc().alias("loc"), F.to_date(_day(F.when(F.col("k") == 1, 1).otherwise(0))).alias("lastmod"))
    found = P.date_conflicts(P.jsonld_nodes(_rich(own)), feed, listed)
    return found.select("url", *[F.col(c).cast("string").alias(c) for c in ("published", "fed", "listed")])


def differing_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Stated and visible reading times."""
    return P.duration_conflicts(_rich(_own(spark, folder))).select("page_id", "stated", "shown")


def declared_origins(spark: SparkSession, folder: str) -> DataFrame:
    """Third parties that a policy names, beside those that pages use."""
    rich = _rich(_own(spark, folder))
    found = L.extract_links(rich).select(urls.host(F.col("raw")).alias("origin")).filter("origin <> ''").distinct()
    declared = rich.select(F.when(F.col("k") < 3, F.lit("stats.test")).otherwise(F.concat(F.lit("old"), F.col("k").cast("string"), F.lit(".test"))).alias("origin")).distinct()
    return listings.inventory_diff(declared, found).select("origin", "declared", "observed")


def structured_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of structured data, flat and in graphs, by type."""
    nodes = P.jsonld_nodes(_rich(_own(spark, folder)))
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


def sitemap_read(spark: SparkSession, folder: str) -> DataFrame:
    """A sitemap of all pages, written and read again."""
    path = f"{shared_folder(spark)}/sitemap-{uuid.uuid4().hex}"
    _own(spark, folder).select(_loc().alias("loc"), _day().alias("lastmod")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return site.read_sitemap(spark, path).select("loc", F.col("lastmod").cast("string").alias("lastmod"))


def feed_read(spark: SparkSession, folder: str) -> DataFrame:
    """A feed of all pages, written and read again, with its dates."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    date = F.concat(F.lit("Sat, "), F.lpad(F.col("day").cast("string"), 2, "0"), F.lit(" Aug 2026 00:00:00 +0000"))
    guid = F.struct(F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("_VALUE"), F.lit(True).alias("_isPermaLink"))
    items = _own(spark, folder).select(F.lit("t").alias("title"), _loc().alias("link"), guid.alias("guid"), date.alias("pubDate"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return site.read_feed(spark, path).select("link", F.col("guid._VALUE").alias("guid"), P.feed_date(F.col("pubDate")).cast("string").alias("day"))


def robots_read(spark: SparkSession, folder: str) -> DataFrame:
    """A robots file of the hosts' sitemaps, written and read again."""
    path = f"{shared_folder(spark)}/robots-{uuid.uuid4().hex}"
    _own(spark, folder).select("host").distinct().select(F.concat(F.lit("User-agent: *\nSitemap: https://"), "host", F.lit("/sitemap.xml")).alias("value")).write.text(path)
    return site.read_robots(spark, path).filter("sitemap IS NOT NULL").select("sitemap")


def link_lists(spark: SparkSession, folder: str) -> DataFrame:
    """A10: a list of each host's pages under headings, as lines of one text a host."""
    line = F.concat(F.lit("## Part "), F.col("k").cast("string"), F.lit("\n- [Page "), F.col("page_id").cast("string"), F.lit("]("), _loc(), F.lit("): "), F.when(F.col("k") == 0, F.lit("first")).otherwise(F.lit("")))
    texts = _own(spark, folder).groupBy(F.col("host").alias("file")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("value"))
    return site.parse_llms(site.numbered_lines(texts)).select("file", "section", "title", "url", "note")


def link_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """A13 with the attribute of each link."""
    return L.extract_links(_rich(_own(spark, folder))).groupBy("attr").agg(F.count("*").alias("n"), F.count_distinct("raw").alias("n_values"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        onsite_paths, folders, header_parse, header_checks, headers_in_force, policy_violations, violations_written, rule_table, marked_heads, unlisted,
        contact_differences, image_weight, third_parties, graded_budgets, label_targets, differing_dates, differing_durations, declared_origins,
        structured_nodes, sitemap_read, feed_read, robots_read, link_lists, link_attributes,
    )
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMED = """regexp_extract_all(html, '[\\w-]*\\b(?:href|src)=["''][^"'']+["'']')"""
_RAW = """regexp_extract(m, '=["''](.*)["'']$', 1)"""
_RICH_LINKS = f"l AS (SELECT page_id, url, host, k, string_split(m, '=')[1] AS attr, {_RAW} AS raw FROM (SELECT page_id, url, host, k, unnest({_NAMED}) AS m FROM rich))"
_TAILS = ", ".join(f"({_q(x)})" for x in ("", "/.", "/..", "/../x", "/./y/", "//z", "/../../../w", "?q=/../a", "#/.."))
_FOLD = """list_reduce(list_prepend([]::VARCHAR[], list_transform(range(1, len(s) + 1), lambda i: [s[i], CASE WHEN i = len(s) THEN '1' ELSE '' END])),
  lambda a, x: CASE WHEN x[1] = '.' THEN CASE WHEN x[2] = '1' THEN list_append(a, '') ELSE a END WHEN x[1] = '..' THEN CASE WHEN x[2] = '1' THEN list_append(a[1:greatest(len(a) - 1, 0)], '') ELSE a[1:greatest(len(a) - 1, 0)] END ELSE list_append(a, x[1]) END)"""
_FINDINGS = f"""WITH {_sql_rich()}, t AS (SELECT *, regexp_extract(html, {_q(RULES[4][3])}) AS t1, regexp_extract(html, {_q(RULES[5][3])}) AS t2, len(regexp_extract_all(html, {_q(RULES[1][2])})) AS n FROM rich),
f AS (SELECT 'frame-eager' AS check_id, url AS subject, {_q("not_matches " + RULES[0][2])} AS detail FROM t WHERE regexp_matches(html, {_q(RULES[0][2])})
UNION ALL SELECT 'one-preconnect', url, 'found ' || n FROM t WHERE n <> 1
UNION ALL SELECT 'stats-consent', url, 'https://stats.test/ needs consent' FROM t WHERE contains(html, 'https://stats.test/') AND NOT contains(html, 'consent')
UNION ALL SELECT 'no-noindex', url, 'rel="canonical" forbids noindex' FROM t WHERE contains(html, 'rel="canonical"') AND contains(html, 'noindex')
UNION ALL SELECT 'image-lazy', url, CASE WHEN t1 = '' THEN {_q("no tag " + RULES[4][3])} ELSE 'tag_contains loading="lazy"' END FROM t WHERE t1 = '' OR NOT contains(t1, 'loading="lazy"')
UNION ALL SELECT 'image-size', url, CASE WHEN t2 = '' THEN {_q("no tag " + RULES[5][3])} ELSE 'tag_not_contains width="9"' END FROM t WHERE t2 = '' OR contains(t2, 'width="9"'))"""
_SHORT = f"'https://{SITE}/p/' || page_id"
_BASE = f"own AS (SELECT *, {_HOST('url')} AS host, {_PATH('url')} AS path, page_id % 7 AS k, page_id % 28 + 1 AS day FROM pages)"
_PADDED = "lpad(day::VARCHAR, 2, '0')"

ORACLES: dict[str, str] = {
    "onsite_paths": f"""WITH {_BASE}, r AS (SELECT page_id, 'https://{SITE}' || path || t AS raw FROM own, (VALUES {_TAILS}) v(t) UNION ALL SELECT page_id, 'HTTPS://{SITE}' || path FROM own),
p AS (SELECT page_id, raw, string_split({_PATH("raw")}, '/')[2:] AS s FROM r) SELECT DISTINCT page_id, raw, CASE WHEN prefix(raw, 'https://{SITE}/') THEN '/' || array_to_string({_FOLD}, '/') END AS path FROM p""",
    "folders": f"""WITH {_BASE}, f AS (SELECT host || rtrim(path, '/') || '/index.html' AS path, sum(octet_length(encode(coalesce(html, ''))))::BIGINT AS bytes FROM own GROUP BY 1), s AS (SELECT string_split(path, '/') AS s FROM f)
SELECT path, bytes, 'file' AS kind FROM f UNION ALL SELECT DISTINCT array_to_string(s[1:i], '/'), NULL::BIGINT, 'dir' FROM (SELECT s, unnest(range(1, len(s))) AS i FROM s)""",
    "header_parse": f"WITH {_SQL_RULES} SELECT file, line_no::INT AS line_no, pattern, name, value FROM rules",
    "header_checks": f"""WITH {_SQL_RULES}, e AS (SELECT DISTINCT file, c.* FROM rules, (VALUES {", ".join(f"({_q(a)}, {_q(b)}, {_q(c)}, {_q(d)}, {_q(e) if e else 'NULL'})" for a, b, c, d, e in EXPECTED)}) c(check_id, p, nm, op, literal)),
s AS (SELECT e.file, check_id, p, nm, op, coalesce(bool_or(r.value IS NOT NULL AND (literal IS NULL OR contains(r.value, literal))), false) AS seen FROM e LEFT JOIN rules r ON r.file = e.file AND r.pattern = e.p AND lower(r.name) = lower(nm) GROUP BY ALL)
SELECT check_id, file || p AS subject, op || ' ' || lower(nm) AS detail FROM s WHERE (op = 'present') <> seen""",
    "headers_in_force": f"""WITH {_BASE}, p AS (SELECT DISTINCT path FROM own), r AS (SELECT * FROM (VALUES (1, '%', 'X-A', '1'), (3, '/en/%', 'X-A', '2'), (4, '/en/%', 'X-B', 'en'), (6, '/%/', 'X-C', 'folder'), (8, '/de/1%', 'X-B', 'ten')) v(line_no, g, name, value))
SELECT path, name, string_agg(value, '|' ORDER BY line_no) AS values FROM p JOIN r ON path LIKE g GROUP BY 1, 2""",
    "policy_violations": f"""WITH {_BASE}, u AS (SELECT DISTINCT path, directive, host, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) = host AS itself FROM own, (VALUES ('script-src-elem'), ('img-src'), ('frame-src')) d(directive))
SELECT DISTINCT path, directive, scheme || '://' || host AS origin FROM u WHERE CASE WHEN directive = 'script-src-elem' THEN NOT (scheme = 'https' AND host = 'a.example.net') ELSE NOT itself AND NOT (scheme = 'https' AND suffix(host, '.example.com')) END
  OR (prefix(path, '/en/') AND directive = 'img-src' AND scheme <> 'https')""",
    "violations_written": f"{_FINDINGS} SELECT 's' AS suite, check_id, subject, detail FROM f",
    "rule_table": f"{_FINDINGS} SELECT check_id, subject, detail FROM f",
    "marked_heads": f"""WITH {_sql_rich()} SELECT 'canonical' AS check_id, url AS subject FROM rich WHERE NOT contains(html, 'rel="canonical"') UNION ALL SELECT 'structured-data', url FROM rich WHERE NOT contains(html, 'application/ld+json')""",
    "unlisted": f"WITH {_BASE} SELECT page_id, {_SHORT} AS url FROM own WHERE k NOT IN (1, 2, 4) AND day > 14",
    "contact_differences": f"""WITH {_BASE}, c AS (SELECT host, 'tel' AS kind, CASE WHEN k = 6 THEN 'tel:2' ELSE 'tel:1' END AS raw, count(*) AS n FROM own GROUP BY 1, 2, 3),
u AS (SELECT host, first(raw ORDER BY n DESC, raw) AS usual FROM c GROUP BY host) SELECT host, kind, raw, n, usual FROM c JOIN u USING (host) WHERE raw <> usual""",
    "image_weight": f"""WITH {_sql_rich()}, {_RICH_LINKS}, p AS (SELECT DISTINCT page_id, ltrim(CASE WHEN prefix(raw, '/') THEN raw ELSE '/' || raw END, '/') AS path FROM (SELECT page_id, regexp_extract(raw, '^[^?#]*') AS raw, raw AS whole FROM l) WHERE raw <> '' AND NOT regexp_matches(whole, {_q(urls.EXTERNAL)})),
s AS (SELECT page_id, coalesce(sum(length(path) * 100) FILTER (suffix(path, '.webp')), 0)::BIGINT AS image_bytes, sum(length(path) * 100)::BIGINT AS total_bytes FROM p GROUP BY 1) SELECT *, image_bytes >= 900 OR total_bytes >= 9000 AS heavy FROM s""",
    "third_parties": f"""WITH {_BASE} SELECT page_id, CASE WHEN k = 0 OR k > 4 THEN 1 ELSE 0 END::BIGINT AS n_third, CASE WHEN k <> 3 THEN 1 ELSE 0 END::BIGINT AS n_font, k IN (1, 2, 3, 4) AS ok FROM own WHERE k <> 3""",
    "graded_budgets": f"""WITH {_BASE}, b AS (SELECT url AS path, CASE WHEN day < 27 THEN octet_length(encode(coalesce(html, '')))::BIGINT END AS bytes FROM own)
SELECT path, bytes, CASE WHEN bytes IS NULL THEN 'missing' WHEN bytes < 2500 THEN 'good' WHEN bytes < 5000 THEN 'fair' ELSE 'over' END AS grade FROM b""",
    "label_targets": f"WITH {_BASE} SELECT page_id, 'More' AS label, 2::BIGINT AS n_targets FROM own WHERE k = 2",
    "differing_dates": f"""WITH {_BASE}, d AS (SELECT {_SHORT} AS url, CASE WHEN k <> 5 THEN DATE '2026-08-01' + (day - 1 + CASE WHEN k = 3 THEN 1 ELSE 0 END)::INT END AS p, CASE WHEN k <> 6 THEN DATE '2026-08-01' + (day - 1)::INT END AS f, DATE '2026-08-01' + (day - 1 + CASE WHEN k = 1 THEN 1 ELSE 0 END)::INT AS l FROM own)
SELECT url, strftime(p, '%Y-%m-%d') AS published, strftime(f, '%Y-%m-%d') AS fed, strftime(l, '%Y-%m-%d') AS listed FROM d WHERE p <> f OR p <> l OR f <> l""",
    "differing_durations": f"WITH {_BASE} SELECT page_id, 5::INT AS stated, 11::INT AS shown FROM own WHERE k = 2",
    "declared_origins": f"""WITH {_BASE}, u AS (SELECT DISTINCT o FROM (SELECT 'frames.test' AS o FROM own WHERE k < 2 UNION ALL SELECT 'fonts.gstatic.com' FROM own WHERE k <> 3 UNION ALL SELECT 'stats.test' FROM own WHERE k > 4 UNION ALL SELECT 'else.test' FROM own WHERE k = 2 UNION ALL SELECT '{SITE}' FROM own WHERE k NOT IN (1, 2))),
d AS (SELECT DISTINCT CASE WHEN k < 3 THEN 'stats.test' ELSE 'old' || k || '.test' END AS o FROM own)
SELECT coalesce(d.o, u.o) AS origin, d.o IS NOT NULL AS declared, u.o IS NOT NULL AS observed FROM d FULL JOIN u ON d.o = u.o WHERE d.o IS NULL OR u.o IS NULL""",
    "structured_nodes": f"""WITH {_BASE} SELECT 'Article' AS type, count(*) AS n, count(*) AS n_pages FROM own WHERE k <> 5 HAVING count(*) > 0 UNION ALL SELECT t, count(*), count(*) FROM own, (VALUES ('Person'), ('Organization')) v(t) WHERE k = 6 GROUP BY t""",
    "sitemap_read": f"WITH {_BASE} SELECT {_SHORT} AS loc, '2026-08-' || {_PADDED} AS lastmod FROM own",
    "feed_read": f"WITH {_BASE} SELECT {_SHORT} AS link, 'g' || page_id AS guid, '2026-08-' || {_PADDED} AS day FROM own",
    "robots_read": f"WITH {_BASE} SELECT DISTINCT 'https://' || host || '/sitemap.xml' AS sitemap FROM own",
    "link_lists": f"WITH {_BASE} SELECT host AS file, 'Part ' || k AS section, 'Page ' || page_id AS title, {_SHORT} AS url, CASE WHEN k = 0 THEN 'first' ELSE '' END AS note FROM own",
    "link_attributes": f"WITH {_sql_rich()}, {_RICH_LINKS} SELECT attr, count(*) AS n, count(DISTINCT raw) AS n_values FROM l GROUP BY attr",
}
