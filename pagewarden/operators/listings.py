"""Comparisons of lists of URLs: coverage, exclusion, parity, budgets and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_from(required: DataFrame, artefact: DataFrame, column: str = "url") -> DataFrame:
    """Required URLs that an artefact doesn't list. Whole values are compared, so a longer URL doesn't stand for its beginning."""
    return required.join(artefact.select(column).distinct(), column, "left_anti")


def redirected_in_sitemap(rules: DataFrame, sitemap: DataFrame, origin: str | None = None) -> DataFrame:
    """src, loc: redirected sources that a sitemap lists, as whole values. Without ``origin`` each rule's ``site`` gives it (https://site), and is in the result."""
    keys = [] if origin else ["site"]
    sources = rules.select(*keys, "src", F.concat(F.lit(origin or "https://"), *keys, "src").alias("loc")).distinct()
    return sources.join(sitemap.select("loc").distinct(), "loc", "left_semi").select(*keys, "src", "loc")


def listing_diff(left: DataFrame, right: DataFrame, column: str = "url") -> DataFrame:
    """url, in_left, in_right: what one list has and the other hasn't."""
    a, b = left.select(column).distinct().withColumn("in_left", F.lit(True)), right.select(column).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, column, "full").na.fill(False, ["in_left", "in_right"])
    return both.filter(F.col("in_left") != F.col("in_right"))


def listing_parity(lists: dict[str, DataFrame], column: str = "url", partial: bool = True) -> DataFrame:
    """url, mask, listed, missing: every URL of any number of lists, with the names of those that have it and of those that lack it; with ``partial`` only URLs that some list lacks.

    ``mask`` has a bit for each list, the first one lowest. One aggregation does it: each list gives its bit, and the bits of a URL are joined before they are shuffled.
    """
    names = list(lists)
    rows = [df.select(F.col(column).alias("url"), F.lit(1 << k).cast("bigint").alias("bit")) for k, df in enumerate(lists.values())]
    found = reduce(DataFrame.unionByName, rows).groupBy("url").agg(F.bit_or("bit").alias("mask"))
    chosen = lambda has: F.array_compact(F.array(*[F.when((F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) == F.lit(has), F.lit(x)) for k, x in enumerate(names)]))
    some = found.filter(F.col("mask") != (1 << len(names)) - 1) if partial else found
    return some.select("url", "mask", chosen(True).alias("listed"), chosen(False).alias("missing"))


def inventory_diff(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """origin, declared, observed: third parties that are listed but not used, or used but not listed."""
    return listing_diff(declared, observed, "origin").withColumnsRenamed({"in_left": "declared", "in_right": "observed"})


def unlisted_pages(heads: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Pages (of head_metadata) that may be indexed, are their own canonical page, and aren't in the sitemap."""
    open_pages = heads.filter((F.col("canonical") == F.col("url")) & ~F.contains(F.lower(F.coalesce("robots", F.lit(""))), F.lit("noindex")))
    return open_pages.join(sitemap.select(F.col("loc").alias("url")).distinct(), "url", "left_anti").select("page_id", "url")


def _sized(inventory: DataFrame, budgets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Budgets with the bytes of their files, null without one. A file that is listed twice with one size is one."""
    on = [*keys, "path"]
    return budgets.join(inventory.filter("kind = 'file'").select(*on, "bytes").distinct(), on, "left")


def check_budgets(inventory: DataFrame, budgets: DataFrame, suite: str = "budget", keys: tuple[str, ...] = ()) -> DataFrame:
    """Assets (asset_class, path, limit_bytes) at their limit or over it, or not there. With ``keys``, such as a crawl's number of a page, a budget is for the file that agrees in them, and a path may stand for several."""
    met = _sized(inventory, budgets, keys)
    failed = met.filter(F.col("bytes").isNull() | (F.col("bytes") >= F.col("limit_bytes")))
    detail = F.when(F.col("bytes").isNull(), F.lit("no such file")).otherwise(F.concat(F.col("bytes").cast("string"), F.lit(" of "), F.col("limit_bytes").cast("string")))
    return failed.select(F.lit(suite).alias("suite"), F.col("asset_class").alias("check_id"), F.col("path").alias("subject"), detail.alias("detail"))


def grade_budgets(inventory: DataFrame, budgets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """path, bytes, grade: ``good`` below preferred_bytes, ``fair`` below limit_bytes, else ``over``; ``missing`` without a file. ``keys`` are as in check_budgets()."""
    met = _sized(inventory, budgets, keys)
    grade = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") < F.col("preferred_bytes"), "good").when(F.col("bytes") < F.col("limit_bytes"), "fair").otherwise("over")
    return met.select("path", "bytes", grade.alias("grade"))


def page_weight(links: DataFrame, inventory: DataFrame, image_limit: int = 1_000_000, total_limit: int = 2_000_000) -> DataFrame:
    """page_id, image_bytes, total_bytes, heavy: local files that a page (page_id, path) names, each once."""
    used = links.select("page_id", F.ltrim("path", F.lit("/")).alias("path")).distinct().join(inventory.filter("kind = 'file'"), "path")
    image = F.col("path").rlike(r"(?i)\.(?:avif|gif|ico|jpe?g|png|svg|webp)$")
    sums = used.groupBy("page_id").agg(F.coalesce(F.sum(F.when(image, F.col("bytes"))), F.lit(0)).alias("image_bytes"), F.sum("bytes").alias("total_bytes"))
    return sums.withColumn("heavy", (F.col("image_bytes") >= image_limit) | (F.col("total_bytes") >= total_limit))


def summarise(violations: DataFrame, checks: DataFrame) -> DataFrame:
    """suite, check_id, n_failed, ok for every check (suite, check_id), with or without findings."""
    counts = violations.groupBy("suite", "check_id").agg(F.count("*").alias("n_failed"))
    joined = checks.select("suite", "check_id").distinct().join(counts, ["suite", "check_id"], "left")
    return joined.select("suite", "check_id", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.col("n_failed").isNull().alias("ok"))
