"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from.

A response is a row with record_id, target_uri, date, headers (a map of source headers) and payload (HTML). ``derive`` gives, for each,
a metadata record (the source headers, the title and the outgoing link count as warc-fields) and a conversion record (the page's
text). Both carry WARC-Refers-To with the response's id, WARC-Refers-To-Target-URI and -Date with its URI and date, and digests of their own block
and of the source's payload. ``serialise`` adds each record's bytes in WARC 1.1 form, and ``parse`` reads them back.

A null payload is an empty page, and null headers are none. A null URI, date or header value is left out. Line ends in a URI, a header or a title become
blanks, so that none of them adds a line. Elements, comments and tags that aren't closed stay tags or text, in linear time. Ids follow from content, so repeated rows give equal records; an empty table gives none. Very long pages
are converted whole. Extra columns, of any name, are left out. All of it is expressions on columns; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import markup

# What a plain-text view leaves out, what ends a line, and the entities that are written out.
HIDDEN = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->|head[^>]*>.*?</head>)"
BREAKS = r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/title|/nav|/header|/footer)[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
CRLF = "\r\n"


def _id(name: str, *parts: Column) -> Column:
    """A URN in the form of a version-5 UUID, from a hash of content."""
    h = F.sha1(F.concat_ws("\n", F.lit(name), *[F.coalesce(p, F.lit("")) for p in parts]))
    s = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), s(1, 8), F.lit("-"), s(9, 4), F.lit("-5"), s(14, 3), F.lit("-a"), s(18, 3), F.lit("-"), s(21, 12), F.lit(">"))


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a table of pages (page_id, url, html); ``date`` is given to all, as such a table has none."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        _id("response", F.col("url"), html).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(html).cast("string")).alias("headers"),
        html.alias("payload"),
    )


def plain_text(html: Column) -> Column:
    """Visible text: hidden parts and tags go, block ends become line ends, blanks shrink, entities are written out."""
    for name, end, tag_first in (("script", "</script>", True), ("style", "</style>", True), ("head", "</head>", True), ("!--", "-->", False)):
        html = markup.mark_unclosed(html, name, end, tag_first)
    text = F.replace(markup.strip(html, [(HIDDEN, " "), (BREAKS, "\n"), (r"<[^>]*>", " ")]), F.lit("<" + markup.MARK), F.lit("<"))
    for name, value in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(value))
    # A single blank stays as it is, so most words need no replacement.
    text = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    return F.btrim(F.regexp_replace(text, r"\x20*\n[\x20\n]*", "\n"), F.lit(" \n"))


def derive(rows: DataFrame) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, target_uri, date, content_type, block, block_digest, payload_digest, source_headers."""
    page = [c for c in ("page_id",) if c in rows.columns]
    rows = rows.select(*page, "record_id", "target_uri", "date", "headers", F.coalesce("payload", F.lit("")).alias("payload"))
    title = F.trim(_one_line(F.regexp_extract(markup.mark_unclosed(F.col("payload"), "title", "</title>", True), r"(?is)<title[^>]*>(.*?)</title>", 1)))
    entries = F.filter(F.map_entries("headers"), lambda e: e["value"].isNotNull())
    headers = F.coalesce(F.array_sort(F.transform(entries, lambda e: _one_line(F.concat(F.lit("source-"), F.lower(e["key"]), F.lit(": "), e["value"])))), F.array().cast("array<string>"))
    fields = F.concat(F.array(F.concat(F.lit("title: "), title), F.concat(F.lit("outlinks: "), markup.count_links(F.col("payload")).cast("string"))), headers)
    base = rows.withColumns({"fields": F.concat(F.array_join(fields, CRLF), F.lit(CRLF)), "text": plain_text(F.col("payload")), "payload_digest": _digest(F.col("payload"))})
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("record_type"), F.lit(c).alias("content_type"), F.col(b).alias("block")) for t, c, b in (("metadata", "application/warc-fields", "fields"), ("conversion", "text/plain; charset=utf-8", "text"))]))
    out = base.select(*page, "record_id", "target_uri", "date", "headers", "payload_digest", kinds.alias("d"))
    return out.select(
        *page,
        F.col("d.record_type").alias("record_type"),
        _id("derived", F.col("d.record_type"), F.col("record_id"), F.col("d.block")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("d.content_type").alias("content_type"),
        F.col("d.block").alias("block"),
        _digest(F.col("d.block")).alias("block_digest"),
        "payload_digest",
        F.col("headers").alias("source_headers"),
    )


def serialise(records: DataFrame) -> DataFrame:
    """Adds ``record``: the bytes of each derived record."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", _one_line(F.col("target_uri"))),
        line("WARC-Refers-To-Date", _one_line(F.col("date"))),
        line("WARC-Target-URI", _one_line(F.col("target_uri"))),
        line("WARC-Date", _one_line(F.col("date"))),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Refers-To-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    return records.withColumn("record", F.encode(F.concat(header, F.col("block"), F.lit(CRLF * 2)), "UTF-8"))


def parse(records: DataFrame, column: str = "record") -> DataFrame:
    """Header fields (the first of a repeated name) and block of serialised records; ``intact`` tells whether length and digest hold, false for null."""
    text = F.decode(column, "UTF-8")
    cut = F.instr(text, CRLF * 2)
    lines = F.filter(F.split(F.substr(text, F.lit(1), cut - 1), CRLF), lambda x: x.contains(": "))
    names = F.transform(lines, lambda x: F.substring_index(x, ": ", 1))
    first = F.array_distinct(names)
    values = F.transform(first, lambda n: F.regexp_replace(F.element_at(lines, F.array_position(names, n).cast("int")), r"^[^:]*: ", ""))
    parsed = records.select(F.map_from_arrays(first, values).alias("fields"), F.substr(text, cut + 4, F.length(text) - cut - 7).alias("block"))
    good = (F.octet_length("block").cast("string") == F.col("fields")["Content-Length"]) & (_digest(F.col("block")) == F.col("fields")["WARC-Block-Digest"])
    return parsed.withColumn("intact", F.coalesce(good, F.lit(False)))


def digest(records: DataFrame) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, content_length, block_digest, payload_digest, record_sha256."""
    out = serialise(records)
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", F.octet_length("block").cast("bigint").alias("content_length"), "block_digest", "payload_digest", F.sha2("record", 256).alias("record_sha256"))


def oracle_sql(date: str = "1970-01-01T00:00:00Z") -> str:
    """digest(derive(responses(pages))) in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    uid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(HIDDEN)}, ' ', 'g'), {q(BREAKS)}, chr(10), 'g'), '<[^>]*>', ' ', 'g')"
    for name, value in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(value)})"
    text = rf"regexp_replace({text}, '[\x20\x09\x0B-\x0D]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '\x20*\n[\x20\n]*', chr(10), 'g'), '^[\x20\n]+|[\x20\n]+$', '', 'g')"
    n = "chr(13) || chr(10)"
    line = lambda name, value: f"coalesce('{name}: ' || {value} || {n}, '')"
    size = lambda x: f"octet_length(encode({x}))"
    uri = "regexp_replace(url, '[\\r\\n]+', ' ', 'g')"
    return f"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, sha1('response' || chr(10) || coalesce(url, '') || chr(10) || payload) AS h, trim(regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\r\\n]+', ' ', 'g'), ' ') AS title,
  len(regexp_extract_all(payload, '(?i)<a\\s[^>]*href=')) AS outlinks, {text} AS plain FROM r),
t AS (SELECT *, {uid("h")} AS refers_to, 'title: ' || title || {n} || 'outlinks: ' || outlinks || {n} || 'source-content-length: ' || {size("payload")} || {n} || 'source-content-type: text/html; charset=utf-8' || {n} AS fields FROM s),
u AS (SELECT page_id, url, payload, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type, fields AS block FROM t
  UNION ALL SELECT page_id, url, payload, refers_to, 'conversion', 'text/plain; charset=utf-8', plain FROM t),
v AS (SELECT *, sha1('derived' || chr(10) || record_type || chr(10) || refers_to || chr(10) || block) AS h2, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(payload) AS payload_digest FROM u),
w AS (SELECT *, {uid("h2")} AS record_id FROM v)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, {size("block")}::BIGINT AS content_length, block_digest, payload_digest,
  sha256('WARC/1.1' || {n} || {line("WARC-Type", "record_type")} || {line("WARC-Record-ID", "record_id")} || {line("WARC-Refers-To", "refers_to")} || {line("WARC-Refers-To-Target-URI", uri)}
    || {line("WARC-Refers-To-Date", q(date))} || {line("WARC-Target-URI", uri)} || {line("WARC-Date", q(date))} || {line("WARC-Block-Digest", "block_digest")} || {line("WARC-Refers-To-Payload-Digest", "payload_digest")} || {line("Content-Type", "content_type")}
    || {line("Content-Length", size("block"))} || {n} || block || {n} || {n}) AS record_sha256
FROM w"""
