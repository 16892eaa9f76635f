"""Facts about pages: head and heading metadata, titles, contacts, labels, structured data, dates and likeness."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import markup, urls
from pagewarden.operators import likeness
from pagewarden.sources.tables import cut, dealt_join


def _attr(tag: str, attr: str) -> Column:
    """Value of an attribute in the first tag that a pattern finds; '' without one."""
    return F.regexp_extract(F.regexp_extract("html", tag, 0), rf"""(?i)\b{attr}=["']([^"']*)["']""", 1)


def head_metadata(pages: DataFrame) -> DataFrame:
    """page_id, url, title, description, canonical, robots, lang, n_h1, n_h2, n_images, n_images_without_alt; null where a page lacks one."""
    images = F.regexp_extract_all("html", F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    empty = lambda c: F.nullif(c, F.lit(""))
    return pages.select(
        "page_id",
        "url",
        empty(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("title"),
        empty(_attr(r"""(?i)<meta\b[^>]*name=["']description["'][^>]*>""", "content")).alias("description"),
        empty(_attr(r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*>""", "href")).alias("canonical"),
        empty(_attr(r"""(?i)<meta\b[^>]*name=["']robots["'][^>]*>""", "content")).alias("robots"),
        empty(_attr(r"(?i)<html\b[^>]*>", "lang")).alias("lang"),
        F.regexp_count("html", F.lit(r"(?i)<h1\b")).cast("bigint").alias("n_h1"),
        F.regexp_count("html", F.lit(r"(?i)<h2\b")).cast("bigint").alias("n_h2"),
        F.size(images).cast("bigint").alias("n_images"),
        F.size(F.filter(images, lambda x: ~x.rlike(r"(?i)\balt="))).cast("bigint").alias("n_images_without_alt"),
    )


def duplicate_titles(heads: DataFrame) -> DataFrame:
    """host, title, n_pages of titles that several pages of a host have."""
    return heads.filter("title IS NOT NULL").groupBy(urls.host(F.col("url")).alias("host"), "title").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


def contact_outliers(links: DataFrame) -> DataFrame:
    """host, kind, raw, n, usual: ``tel:`` and ``mailto:`` values that differ from their host's most frequent one (the smallest of equals)."""
    kind = F.lower(F.regexp_extract("raw", r"(?i)^(tel|mailto):", 1))
    counts = links.select(urls.host(F.col("url")).alias("host"), kind.alias("kind"), "raw").filter("kind <> ''").groupBy("host", "kind", "raw").agg(F.count("*").alias("n"))
    usual = counts.groupBy("host", "kind").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("usual"))
    return counts.join(usual, ["host", "kind"]).filter("raw <> usual")


def ambiguous_labels(anchors: DataFrame) -> DataFrame:
    """page_id, label, n_targets of labels that lead to several targets on a page; the same label twice to one target is fine."""
    return anchors.groupBy("page_id", "label").agg(F.count_distinct("href").alias("n_targets")).filter("n_targets > 1")


def extract_anchors(pages: DataFrame) -> DataFrame:
    """page_id, href, label (aria-label, else the text without tags) of links."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("tag"))
    head = F.regexp_extract("tag", r"(?is)^<a\b[^>]*>", 0)
    text = F.trim(F.regexp_replace(F.regexp_replace("tag", r"<[^>]*>", " "), r"\s+", " "))
    aria = F.regexp_extract(head, r"""(?i)aria-label=["']([^"']*)["']""", 1)
    return tags.select("page_id", F.regexp_extract(head, r"""(?i)\bhref=["']([^"']*)["']""", 1).alias("href"), F.when(aria != "", aria).otherwise(text).alias("label"))


# Hosts that serve fonts, and endings of font files.
FONT_HOSTS = ("fonts.googleapis.com", "fonts.gstatic.com", "use.typekit.net", "fonts.bunny.net")
FONT_FILE = r"(?i)\.(?:eot|otf|ttf|woff2?)(?:[?#]|$)"


def third_party_origins(links: DataFrame, site_of: Column | None = None, font_origins: int = 2, font_hosts: tuple[str, ...] = FONT_HOSTS) -> DataFrame:
    """page_id, n_third, n_font, ok: other hosts that a page loads before interaction (columns page_id, url, raw and, from extract_links, attr).

    Values of ``src`` are loaded; those of ``data-src`` and the like wait for interaction, and ``href`` counts for font hosts and files alone. Without ``attr`` all values count as loaded.
    """
    own = site_of if site_of is not None else urls.host(F.col("url"))
    other = urls.host(F.col("raw"))
    font = other.isin(*font_hosts) | other.rlike(r"^fonts?\.") | F.col("raw").rlike(FONT_FILE)
    loaded = (F.lower("attr") == "src") | ((F.lower("attr") == "href") & font) if "attr" in links.columns else F.lit(True)
    used = links.filter(loaded & (other != "") & (other != own)).groupBy("page_id", other.alias("origin")).agg(F.bool_or(font).alias("font"))
    out = used.groupBy("page_id").agg(F.count_if(~F.col("font")).alias("n_third"), F.count_if("font").alias("n_font"))
    return out.withColumn("ok", (F.col("n_third") == 0) & (F.col("n_font") <= font_origins))


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """page_id, url, node, type: nodes of structured data, flat or in ``@graph``; invalid text keeps a row with a null type."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    parsed = pages.select("page_id", "url", F.explode(blocks).alias("text")).withColumn("v", F.try_parse_json("text"))
    nodes = parsed.select("page_id", "url", F.explode_outer(F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array("v"))).alias("node"))
    return nodes.withColumn("type", F.try_variant_get("node", "$['@type']", "string"))


def iso_minutes(text: Column) -> Column:
    """Minutes of a duration such as PT1H8M; null for other text."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"^PT(?:(\d+)H)?(?:(\d+)M)?$", k).try_cast("int"), F.lit(0))
    return F.when(text.rlike(r"^PT(?:\d+H)?(?:\d+M)?$") & (text != "PT"), part(1) * 60 + part(2))


# The zones that RFC 822 names, in hours; single letters but J are those of the military, and count as UTC, since their sign was given wrongly there.
ZONES = {"UT": 0, "GMT": 0, "UTC": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_DATE = r"(?i)^\s*(?:[a-z]+\s*,\s*)?([0-9]{1,2})\s+([a-z]{3})[a-z]*\s+([0-9]{4}|[0-9]{2})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*([a-z]+|[+-][0-9]{4})?\s*(?:\(.*\))?\s*$"


def _local_time(text: Column) -> tuple[Column, Column, Column]:
    """Date and time as an RFC 822 text has them, and the minutes that its zone is ahead of UTC; null for other text."""
    part = lambda k: F.regexp_extract(text, _DATE, k)
    at = F.instr(F.lit(MONTHS), F.lower(part(2)))
    month = F.when(at % 3 == 1, F.lpad(((at + 2) / 3).cast("int").cast("string"), 2, "0"))
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) < "50", F.concat(F.lit("20"), part(3))).otherwise(F.concat(F.lit("19"), part(3)))
    day = F.when(text.rlike(_DATE), F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0")).try_cast("date"))
    second = F.when(part(6) == "", F.lit("00")).otherwise(part(6))
    time = F.concat(F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), second)
    zone = F.upper(part(7))
    named = F.create_map(*[x for k, v in ZONES.items() for x in (F.lit(k), F.lit(60 * v))])
    signed = F.concat(F.substr(zone, F.lit(1), F.lit(1)), F.lit("1")).try_cast("int") * (F.substr(zone, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(zone, F.lit(4), F.lit(2)).try_cast("int"))
    ahead = F.when(zone == "", F.lit(0)).when(zone.rlike("^[+-]"), signed).when(F.length(zone) == 1, F.when(zone != "J", F.lit(0))).otherwise(named[zone])
    return day, time, ahead


def feed_date(text: Column) -> Column:
    """The date that an RFC 822 time states, in its own zone: one- and two-digit days, years of two digits (from 1950 on), zones by name or number, seconds or none."""
    return _local_time(text)[0]


def feed_instant(text: Column) -> Column:
    """The instant of an RFC 822 time; null where its zone isn't known."""
    day, time, ahead = _local_time(text)
    stated = F.concat(day.cast("string"), F.lit("T"), time, F.lit("Z")).try_cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(stated) - 60 * ahead)


def _iso_instant(text: Column) -> Column:
    """The instant of an ISO 8601 time with a zone; null for a date alone."""
    return F.when(text.rlike(r"T[0-9:.]+(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), text.try_cast("timestamp"))


def date_conflicts(nodes: DataFrame, feed: DataFrame, sitemap: DataFrame, later_listed: bool = False, instants: bool = False) -> DataFrame:
    """url, published, fed, listed of URLs whose dates in structured data, feed and sitemap differ; missing ones don't count. With ``later_listed`` a sitemap may give a later date, as of a change.

    Dates are those that each text states, in its own zone. With ``instants`` structured data and feed conflict where both give a time and the instants differ (otherwise by their dates), so that
    23:30 in New York and 04:30 of the next day in UTC agree.
    """
    stated = F.try_variant_get("node", "$.datePublished", "string")
    published = nodes.select("url", F.struct(stated.substr(1, 10).try_cast("date").alias("day"), _iso_instant(stated).alias("at")).alias("p")).filter("p.day IS NOT NULL").groupBy("url").agg(F.min("p").alias("p"))
    fed = feed.select(F.col("link").alias("url"), F.struct(feed_date(F.col("pubDate")).alias("day"), feed_instant(F.col("pubDate")).alias("at")).alias("f")).filter("f.day IS NOT NULL").groupBy("url").agg(F.min("f").alias("f"))
    listed = sitemap.select(F.col("loc").alias("url"), F.col("lastmod").alias("listed")).groupBy("url").agg(F.max("listed").alias("listed"))
    met = published.join(fed, "url", "full").join(listed, "url", "full").select("url", F.col("p.day").alias("published"), F.col("f.day").alias("fed"), "listed", F.col("p.at").alias("p"), F.col("f.at").alias("f"))
    off = (lambda x: F.col(x) > F.col("listed")) if later_listed else (lambda x: F.col(x) != F.col("listed"))
    apart = F.col("published") != F.col("fed")
    if instants:
        apart = F.when(F.col("p").isNotNull() & F.col("f").isNotNull(), F.col("p") != F.col("f")).otherwise(apart)
    return met.filter(apart | off("published") | off("fed")).select("url", "published", "fed", "listed")


def duration_conflicts(pages: DataFrame) -> DataFrame:
    """page_id, url, stated, shown of pages whose structured data gives other minutes than their visible reading time."""
    stated = jsonld_nodes(pages).select("page_id", "url", iso_minutes(F.try_variant_get("node", "$.timeRequired", "string")).alias("stated")).filter("stated IS NOT NULL").groupBy("page_id", "url").agg(F.max("stated").alias("stated"))
    shown = pages.select("page_id", F.regexp_extract(F.regexp_replace("html", r"<[^>]*>", " "), r"(?i)(\d+)\s*-?\s*min(?:ute)?s?\s+read", 1).try_cast("int").alias("shown")).filter("shown IS NOT NULL")
    return stated.join(shown, "page_id").filter("stated <> shown")


def page_words(html: Column) -> Column:
    """Words of the visible text in lower case, without navigation."""
    for name in ("nav", "script", "style"):
        html = markup.mark_unclosed(html, rf"{name}\b", f"</{name}>")
    text = markup.strip(html, [(r"(?is)<nav\b.*?</nav>|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", " ")])
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _page_grams(pages: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """page_id, text_id of all pages with enough words (text_id: the smallest page_id with these words), and page_id, grams (hashes of word runs) of each text; both written once."""
    # A filter on the words would be moved below them, and so compute them twice.
    enough = F.filter(F.array(page_words(F.coalesce("html", F.lit("")))), lambda w: F.size(w) >= words)
    found = pages.select("page_id", F.explode(enough).alias("w"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(F.slice("w", i + 1, words))))
    each = cut(found.select("page_id", F.md5(F.array_join("w", " ")).alias("digest"), runs.alias("grams")))
    texts = each.groupBy("digest").agg(F.min("page_id").alias("text_id"))
    placed = cut(dealt_join(each.select("page_id", "digest"), texts, "digest", "page_id").select("page_id", "text_id"))  # a text may have very many copies
    return placed, each.join(placed.filter("page_id = text_id").select("page_id"), "page_id", "left_semi").select("page_id", "grams")


def _page_bands(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """page_id, keys: a hash for each MinHash band, from the least hashes over a page's runs in one aggregation."""
    least = [F.min(F.xxhash64("gram", F.lit(k))).alias(f"m{k}") for k in range(bands * rows)]
    values = sets.select("page_id", F.explode("grams").alias("gram")).groupBy("page_id").agg(*least)
    return values.select("page_id", F.array(*[F.xxhash64(F.lit(b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)]).alias("keys"))


def near_duplicates(pages: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 4, block: int = 256) -> DataFrame:
    """page_a, page_b, similarity: likeness of word runs between pages with different texts, each text by its smallest page_id.

    MinHash bands give the candidates: all pairs of a bucket (a pair at 0.8 shares none with a chance of 3e-6). A bucket's members are dealt to
    blocks of about ``block``, each of which meets the whole bucket, so that no large bucket lies in one task. Word runs travel as 64-bit hashes, and the similarity is that of the hash sets.
    The result has every pair, so it grows with the square of a group of variants; near_duplicate_classes() doesn't.
    """
    _, sets = _page_grams(pages, words)
    keyed = cut(_page_bands(sets, bands, rows).select("page_id", F.explode("keys").alias("bucket")))
    groups = keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = dealt_join(keyed, groups.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bucket", "page_id")
    dealt = shared.select("bucket", F.pmod(F.xxhash64("page_id"), "blocks").cast("int").alias("block"), F.col("page_id").alias("page_a"))
    whole = shared.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("page_id").alias("page_b"))
    pairs = cut(dealt.join(whole, ["bucket", "block"]).filter("page_a < page_b").select("page_a", "page_b").distinct())
    half = dealt_join(pairs, sets.select(F.col("page_id").alias("page_a"), F.col("grams").alias("x")), "page_a", "page_b")
    met = dealt_join(half, sets.select(F.col("page_id").alias("page_b"), F.col("grams").alias("y")), "page_b", "page_a", counted=pairs)
    both = F.size(F.array_intersect("x", "y"))
    return met.select("page_a", "page_b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).filter(F.col("similarity") >= threshold)


def near_duplicate_classes(pages: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 24, rows: int = 4, block: int = 512) -> DataFrame:
    """page_id, text_id, class_id, n_links of all pages with ``words`` words or more: the smallest page_id with the same words, that of the class, and the number of other texts at the threshold or above.

    A bucket's members are dealt to blocks, and each two blocks of a bucket are one group. There, a pair is looked at only in the first band that it
    shares, so no pair counts twice and none leaves its task: out come the numbers of links of each page and the few links that connect the block
    pair. Exact for buckets of any size, as far as the bands go (see near_duplicates()).
    """
    placed, sets = _page_grams(pages, words)
    keyed = cut(sets.join(_page_bands(sets, bands, rows), "page_id"))
    each = keyed.select("page_id", F.posexplode("keys").alias("band", "bucket"), "keys")  # the band is part of a bucket's hash
    # Where all members of a bucket agree in an earlier band, all its pairs are left to that one; three earlier bands are looked at.
    earlier = [F.when(F.col("band") > 0, F.get("keys", x)) for x in (F.lit(0), F.floor(F.col("band") / 2).cast("int"), F.col("band") - 1)]
    alike = reduce(lambda a, b: a | b, [F.coalesce(F.min(x) == F.max(x), F.lit(False)) for x in earlier])
    groups = each.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n"), alike.alias("alike")).filter("n > 1 AND NOT alike").drop("n", "alike")
    dealt = dealt_join(each.drop("keys"), groups, "bucket", "page_id")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("page_id", F.lit(1)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "page_id")
    met = dealt.join(keyed, "page_id")

    def work(table: pa.Table) -> pa.Table:
        return likeness.block_links(table, threshold)

    found = cut(met.groupBy("band", "bucket", "i", "j").applyInArrow(work, "page_id bigint, n bigint, other bigint"))
    counts = found.filter("n IS NOT NULL").groupBy(F.col("page_id").alias("text_id")).agg(F.sum("n").alias("n_links"))
    labels = likeness.components(found.filter("other IS NOT NULL").select(F.col("page_id").alias("a"), F.col("other").alias("b")))
    texts = sets.select(F.col("page_id").alias("text_id")).join(counts, "text_id", "left").join(labels.withColumnRenamed("node", "text_id"), "text_id", "left")
    texts = cut(texts.select("text_id", F.coalesce("label", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))
    return dealt_join(placed, texts, "text_id", "page_id").select("page_id", "text_id", "class_id", "n_links")
