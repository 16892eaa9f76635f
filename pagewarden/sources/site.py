"""Readers for a site's files and rule files, and the sink for findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.sources.tree import read_tree

FEED = "title string, link string, guid struct<_VALUE:string,_isPermaLink:boolean>, description string, pubDate string, category string"
MANIFEST = "name string, start_url string, icons array<struct<src:string,sizes:string,type:string,purpose:string>>"
EXPECTATIONS = "suite string, check_id string, subject string, op string, literal string, any_group string, n int"


def _relative(spark: SparkSession, root: str) -> Column:
    """Path below ``root`` (the file's name where ``root`` is one file), without the escapes of a file's URL."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    bare = "/" + re.sub(r"^[a-z][a-z0-9+.-]*:", "", whole).strip("/") + "/"
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(name, r"^[a-z][a-z0-9+.-]*:/+", "/")
    return F.when(F.startswith(name, F.lit(bare)), F.substr(name, F.lit(len(bare) + 1))).when(name == bare.rstrip("/"), F.lit(bare.rstrip("/").rsplit("/", 1)[-1])).otherwise(name)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """page_id, url, html of a table, or of a folder of files, each whole (the URL is then the path below it)."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("page_id", "url", "html")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path)
    name = _relative(spark, path)
    return files.select(F.xxhash64(name).alias("page_id"), name.alias("url"), F.col("value").alias("html"))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".html", ".xml", ".txt"), exclude_prefixes: tuple[str, ...] = ("node_modules/", ".git/")) -> DataFrame:
    """path, bytes of the files below ``root``, listed by the tasks; names that begin with ``_`` or ``.`` count too. An excluded prefix that ends in a slash is a folder that isn't entered."""
    return read_tree(spark, root, ",".join(f"*.{s.lstrip('.')}" for s in suffixes), exclude_prefixes)


def inventory(files: DataFrame) -> DataFrame:
    """path, bytes, kind of files and of the folders that hold them: a folder counts as existing."""
    parts = F.split("path", "/")
    above = F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>")))
    folders = files.select(above.alias("path")).distinct().select("path", F.lit(None).cast("bigint").alias("bytes"), F.lit("dir").alias("kind"))
    return files.select("path", F.col("bytes").cast("bigint").alias("bytes"), F.lit("file").alias("kind")).unionByName(folders)


def numbered_lines(text: DataFrame, column: str = "value") -> DataFrame:
    """line_no, line of whole texts, beside their other columns."""
    rest = [c for c in text.columns if c != column]
    return text.select(*rest, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "line"))


def _keys(lines: DataFrame) -> list[str]:
    """Columns that tell rule files and their sites apart."""
    return [c for c in ("site", "file") if c in lines.columns]


def parse_redirects(lines: DataFrame, status: str = "301") -> DataFrame:
    """line_no, src, dst, status of lines of three fields or more with this status; ``site`` and ``file`` of the lines stay."""
    fields = F.split(F.trim("line"), r"\s+")
    keys = _keys(lines)
    rows = lines.select(*keys, "line_no", fields.alias("f")).filter((F.size("f") >= 3) & (F.get("f", F.lit(2)) == status))
    return rows.select(*keys, "line_no", F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst"), F.get("f", F.lit(2)).cast("int").alias("status"))


def parse_headers(lines: DataFrame) -> DataFrame:
    """line_no, pattern, name, value: an indented ``Name: value`` line belongs to the last line without indent. Several files need a ``file`` or ``site`` column."""
    keys = _keys(lines)
    # One rule file is one small text; its lines stay together.
    w = W.partitionBy(*keys or [F.lit(0)]).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    blank = F.trim("line") == ""
    indented = F.col("line").rlike(r"^\s")
    rows = lines.filter(~blank & ~F.ltrim("line").startswith("#")).withColumn("pattern", F.last(F.when(~indented, F.trim("line")), ignorenulls=True).over(w))
    own = F.trim("line")
    return rows.filter(indented & own.contains(":")).select(*keys, "line_no", "pattern", F.trim(F.substring_index(own, ":", 1)).alias("name"), F.trim(F.regexp_replace(own, r"^[^:]*:", "")).alias("value"))


def read_rules(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """file, line_no, line of a rule file, or of all below a folder that match ``names``, such as ``_redirects``; ``file`` is the path below the folder. Without ``names`` Spark lists, which leaves out names that begin with ``_`` or ``.``."""
    if names or path.rstrip("/").rpartition("/")[2].startswith(("_", ".")):
        return numbered_lines(read_tree(spark, path, names or "", text=True).select(F.col("path").alias("file"), "value"))
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return numbered_lines(files.select(_relative(spark, path).alias("file"), "value"))


def with_site(lines: DataFrame) -> DataFrame:
    """Adds ``site``: the first folder of ``file``, in lower case, as a crawl keeps each host's files in a folder of its name; without ``www.`` and ``m.``, like urls.host()."""
    folder = F.lower(F.substring_index("file", "/", 1))
    return lines.withColumn("site", F.regexp_replace(folder, r"^(?:www|m)\.", ""))


def read_site_redirects(spark: SparkSession, root: str, name: str = "_redirects") -> DataFrame:
    """site, file, line_no, src, dst, status of the redirect rules of all sites below ``root`` (root/host/_redirects)."""
    return parse_redirects(with_site(read_rules(spark, root, name)))


def read_site_headers(spark: SparkSession, root: str, name: str = "_headers") -> DataFrame:
    """site, file, line_no, pattern, name, value of the header rules of all sites below ``root`` (root/host/_headers)."""
    return parse_headers(with_site(read_rules(spark, root, name)))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod date").load(path)


def check_sitemap_text(text: DataFrame) -> DataFrame:
    """suite, check_id, subject, detail where a sitemap's text is no sitemap (columns path, value)."""
    value = F.trim(F.regexp_replace("value", r"^\s+", ""))
    tests = {"xml-declaration": value.startswith("<?xml"), "urlset": value.contains("<urlset"), "no-html": ~value.contains("<html")}
    failed = F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()])
    return text.select(F.lit("sitemap").alias("suite"), F.explode(F.array_compact(failed)).alias("check_id"), F.col("path").alias("subject"), F.lit("sitemap text").alias("detail"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value and the sitemap that the line names, or null."""
    lines = read_rules(spark, path).withColumnRenamed("line", "value")
    return lines.withColumn("sitemap", F.nullif(F.regexp_extract("value", r"^Sitemap:\s*(\S+)", 1), F.lit("")))


def read_llms(spark: SparkSession, path: str) -> DataFrame:
    """section, title, url, note of the link lines ``- [title](url): note`` under ``##`` headings."""
    return parse_llms(read_rules(spark, path))


def parse_llms(lines: DataFrame) -> DataFrame:
    keys = _keys(lines)
    w = W.partitionBy(*keys or [F.lit(0)]).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    link = r"^\s*-\s*\[([^\]]*)\]\(([^)\s]*)\)(?::\s*(.*))?$"
    rows = lines.withColumn("section", F.last(F.nullif(F.regexp_extract("line", r"^##\s+(.*\S)\s*$", 1), F.lit("")), ignorenulls=True).over(w))
    return rows.filter(F.col("line").rlike(link)).select(*keys, "section", *[F.regexp_extract("line", link, k).alias(name) for k, name in ((1, "title"), (2, "url"), (3, "note"))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def expectations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A table of expectations from tuples in the order of its columns."""
    return spark.createDataFrame(rows, EXPECTATIONS)


def write_violations(violations: DataFrame, path: str, mode: str = "append") -> None:
    """Every finding, as Parquet: suite, check_id, subject, detail. With ``append`` a repeated run adds its findings again; write_run() doesn't."""
    violations.select("suite", "check_id", "subject", "detail").write.mode(mode).parquet(path)


def write_run(violations: DataFrame, path: str, run: str) -> None:
    """The findings of one run, each once, as a partition of a table of runs: a run that is repeated replaces its own partition and no other."""
    rows = violations.select("suite", "check_id", "subject", "detail").distinct().withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """suite, check_id, subject, detail, run of all runs; a run without findings has no rows."""
    return spark.read.schema("suite string, check_id string, subject string, detail string, run string").parquet(path)


def compare_runs(runs: DataFrame, before: str, after: str) -> DataFrame:
    """suite, check_id, subject, detail, state: ``new`` findings of the later run, ``fixed`` ones of the earlier, and ``open`` ones of both. One aggregation over both runs."""
    sides = runs.filter(F.col("run").isin(before, after)).groupBy("suite", "check_id", "subject", "detail").agg(F.bool_or(F.col("run") == before).alias("was"), F.bool_or(F.col("run") == after).alias("is"))
    return sides.select("suite", "check_id", "subject", "detail", F.when(F.col("was") & F.col("is"), F.lit("open")).when(F.col("is"), F.lit("new")).otherwise(F.lit("fixed")).alias("state"))
