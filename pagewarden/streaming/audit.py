"""The stateless checks on pages that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators import links, rules


def read_page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from Parquet files that are added to a folder."""
    return spark.readStream.schema("page_id bigint, url string, html string").parquet(folder)


def link_stream(pages: DataFrame) -> DataFrame:
    """Classified links of arriving pages."""
    return links.classify_links(links.extract_links(pages))


def audit_stream(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write head-marker findings of arriving pages to Parquet, each file's once."""
    return rules.check_head_markers(pages).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
