"""Column expressions on link values and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link value, and as a link that leaves the site.
LINK = r"""\b(?:href|src)=["']([^"']+)["']"""
# The same matches with the whole name of the attribute, such as data-src.
NAMED_LINK = r"""[\w-]*\b(?:href|src)=["'][^"']+["']"""
EXTERNAL = r"(?i)^(?:https?:|mailto:|tel:|sms:|data:|javascript:|#)"


def is_external(raw: Column) -> Column:
    return raw.rlike(EXTERNAL)


def strip_suffix(raw: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_extract(raw, r"^[^?#]*", 0)


def host(url: Column) -> Column:
    """Host in lower case, without a leading ``www.`` or ``m.``; '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1)), r"^(?:www|m)\.", "")


def url_path(url: Column) -> Column:
    """Path of an absolute URL, '/' where it has none."""
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def collapse_dots(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts; ``..`` stops at the root, and a trailing slash stays. ``/a/b/..`` is ``/a``."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when((joined != "/") & path.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def collapse_url_dots(path: Column) -> Column:
    """A URL's path without ``.`` and ``..``, by the rules of URLs: a last one leaves a trailing slash (``/a/b/..`` is ``/a/``), and empty parts stay."""
    parts = F.slice(F.split(path, "/"), 2, 1_000_000)
    last = F.size(parts) - 1
    marked = F.transform(parts, lambda x, k: F.struct(x.alias("part"), (k == last).alias("last")))
    ended = lambda acc, x: F.when(x["last"], F.array_append(acc, F.lit(""))).otherwise(acc)
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x["part"] == ".", ended(acc, x)).when(x["part"] == "..", ended(up(acc), x)).otherwise(F.array_append(acc, x["part"]))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))


def resolve_path(base: Column, clean: Column) -> Column:
    """A link's path on the directory of the page path ``base``; a path from the root is kept as it is."""
    directory = F.regexp_extract(F.concat(F.lit("/"), F.ltrim(base, F.lit("/"))), r"^.*/", 0)
    return F.when(clean.startswith("/"), clean).otherwise(collapse_dots(F.concat(directory, clean)))


def onsite_path(raw: Column, site: str) -> Column:
    """Normalised path of a link that starts with https://site/, in this case; null for others."""
    return F.when(raw.startswith(f"https://{site}/"), collapse_url_dots(url_path(raw)))


def candidate_keys(path: Column) -> Column:
    """Files that could answer a path, without leading slashes."""
    bare = F.ltrim(path, F.lit("/"))
    open_path = F.array(bare, F.concat(bare, F.lit(".html")), F.concat(bare, F.lit("/index.html")))
    return F.when(bare == "", F.array(F.lit("index.html"))).when(bare.endswith("/"), F.array(F.concat(bare, F.lit("index.html")))).otherwise(open_path)


def glob_like(pattern: Column) -> Column:
    """A path pattern with ``*`` as a LIKE pattern, with ``!`` as the escape character."""
    plain = F.replace(F.replace(F.replace(pattern, F.lit("!"), F.lit("!!")), F.lit("%"), F.lit("!%")), F.lit("_"), F.lit("!_"))
    return F.replace(plain, F.lit("*"), F.lit("%"))
