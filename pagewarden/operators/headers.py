"""Response-header rules: content, effective headers of a URL, and the origins that a policy allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.operators.globs import MAX_BROADCAST_RULES, SALTS, glob_join
from pagewarden.sources.tables import cut

#: So many verdicts at most on a policy and a resource are sent to every task.
MAX_BROADCAST_VERDICTS = 100_000


def _shared(keys: tuple[str, ...], *tables: DataFrame) -> list[str]:
    return [k for k in keys if all(k in t.columns for t in tables)]


def check_headers(header_rules: DataFrame, expectations: DataFrame) -> DataFrame:
    """Expectations (suite, check_id, pattern, name, op, literal, and site where both tables have one): ``present`` needs a rule whose value contains the literal (null: any value), ``absent`` forbids one.

    Names are compared without regard to case, as headers are; values with it.
    """
    keys = _shared(("site",), header_rules, expectations)
    rules = header_rules.select(*keys, "pattern", F.lower("name").alias("name"), "value")
    wanted = expectations.withColumn("name", F.lower("name"))
    met = wanted.join(rules, [*keys, "pattern", "name"], "left")
    ok = F.col("value").isNotNull() & (F.col("literal").isNull() | F.contains("value", F.col("literal")))
    seen = met.groupBy("suite", "check_id", *keys, "pattern", "name", "op").agg(F.bool_or(ok).alias("seen"))
    failed = seen.filter(F.when(F.col("op") == "present", ~F.col("seen")).otherwise(F.col("seen")))
    return failed.select("suite", "check_id", F.concat(*keys, "pattern").alias("subject"), F.concat_ws(" ", "op", "name").alias("detail"))


def effective_headers(urls: DataFrame, header_rules: DataFrame, column: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """path, name, values (and keys): for each path and header, the values of all rules that match, by line. With ``keys``, such as a site, a rule holds for the paths that agree in them."""
    own = _shared(keys, urls, header_rules)
    found = glob_join(urls.select(*own, column).distinct(), header_rules.select(*own, "line_no", "pattern", "name", "value"), column, "pattern", tuple(own))
    lists = found.groupBy(*own, column, "name").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("v"))
    return lists.select(*own, column, "name", F.col("v.value").alias("values"))


def csp_sources(header_rules: DataFrame) -> DataFrame:
    """line_no, pattern (and site, file), directive, source of the content-security policies, report-only ones too. A directive without sources has a null one and allows nothing; of a repeated directive the first counts."""
    keys = _shared(("site", "file"), header_rules)
    policies = header_rules.filter(F.lower("name").startswith("content-security-policy"))
    parts = policies.select(*keys, "line_no", "pattern", F.posexplode(F.split("value", ";")).alias("k", "d")).select(*keys, "line_no", "pattern", "k", F.split(F.trim("d"), r"\s+").alias("w"))
    named = parts.filter(F.get("w", F.lit(0)) != "").select(*keys, "line_no", "pattern", "k", F.lower(F.get("w", F.lit(0))).alias("directive"), F.slice("w", 2, 1000000).alias("sources"))
    first = named.groupBy(*keys, "line_no", "pattern", "directive").agg(F.min_by("sources", "k").alias("sources"))
    return first.select(*keys, "line_no", "pattern", "directive", F.explode_outer("sources").alias("source"))


# The directives that stand in for a missing one, in order.
FALLBACKS = {
    "script-src-elem": ["script-src", "default-src"],
    "script-src-attr": ["script-src", "default-src"],
    "style-src-elem": ["style-src", "default-src"],
    "style-src-attr": ["style-src", "default-src"],
    "worker-src": ["child-src", "script-src", "default-src"],
    "frame-src": ["child-src", "default-src"],
    **{f"{x}-src": ["default-src"] for x in ("child", "connect", "font", "img", "manifest", "media", "object", "script", "style")},
}


# Ports that a scheme has by default, and schemes that a named one also stands for.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443"}
STANDS_FOR = {"http": ["http", "https"], "ws": ["ws", "wss", "http", "https"], "wss": ["wss", "https"]}
_URL = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#:]*|\[[^\]]*\])(?::([0-9]+))?([^?#]*)"
_SOURCE = r"(?i)^(?:([a-z][a-z0-9+.-]*)://)?(\*|(?:\*\.)?[^/?#:*]+)(?::([0-9]+|\*))?(/[^?#]*)?$"


def _covers(named: Column, actual: Column) -> Column:
    """Whether a named scheme stands for another: itself, and what it may be upgraded to."""
    table = F.create_map(*[x for k, v in STANDS_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (named == actual) | F.coalesce(F.array_contains(table[named], actual), F.lit(False))


def _default_port(scheme: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])[scheme]


def _parts(url: Column, prefix: str) -> list[Column]:
    """Scheme, host, port and path of a URL or origin; other schemes (data:, blob:) have no host."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    scheme = F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*):", 1))
    port = F.when(part(3) != "", part(3)).otherwise(_default_port(scheme))
    return [scheme.alias(f"{prefix}scheme"), F.lower(part(2)).alias(f"{prefix}host"), port.alias(f"{prefix}port"), F.when(part(4) == "", F.lit("/")).otherwise(part(4)).alias(f"{prefix}path")]


def _source_parts(sources: DataFrame, keys: list[str]) -> DataFrame:
    """Sources by the host that they name: '' for a scheme alone. ``'self'`` is ``self``; other quoted ones (nonces, hashes, ``'none'``) allow no URL."""
    text = F.col("source")
    scheme_only = text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:$")
    part = lambda k: F.regexp_extract(text, _SOURCE, k)
    none = F.lit("")
    known = sources.filter(F.lower(text).eqNullSafe("'self'") | (~text.startswith("'") & (scheme_only | text.rlike(_SOURCE))))
    own = F.lower(text) == "'self'"
    return known.select(
        *keys,
        "line_no",
        F.col("directive").alias("rule"),
        F.when(own, F.lit("'self'")).when(scheme_only, none).otherwise(F.lower(part(2))).alias("named"),
        F.when(own, none).when(scheme_only, F.lower(F.rtrim(text, F.lit(":")))).otherwise(F.lower(part(1))).alias("s_scheme"),
        F.when(own | scheme_only, none).otherwise(part(3)).alias("s_port"),
        F.when(own | scheme_only, none).otherwise(part(4)).alias("s_path"),
    ).distinct()


def _allows() -> Column:
    """Whether a source whose named host fits allows the resource."""
    c = F.col
    same_port = (c("r_port") == c("p_port")) | ((c("p_port") == _default_port(c("p_scheme"))) & (c("r_port") == _default_port(c("r_scheme"))))
    own = c("p_host").isNotNull() & (c("r_host") == c("p_host")) & _covers(c("p_scheme"), c("r_scheme")) & same_port
    network = c("r_scheme").isin(*PORTS)
    of_page = F.coalesce(_covers(c("p_scheme"), c("r_scheme")), F.lit(False))
    anything = (c("named") == "*") & (c("s_scheme") == "") & (c("s_port") == "") & (c("s_path") == "")
    # Without a scheme of its own a source takes the page's; where the page isn't known, those of the network.
    scheme = F.when(c("s_scheme") != "", _covers(c("s_scheme"), c("r_scheme"))).otherwise(F.when(c("p_scheme").isNotNull(), of_page).otherwise(network))
    port = F.when(c("s_port") == "*", F.lit(True)).when(c("s_port") == "", c("r_port").eqNullSafe(_default_port(c("r_scheme")))).otherwise((c("s_port") == c("r_port")) | ((c("s_port") == "80") & (c("r_port") == "443")))
    path = F.when(c("s_path").isin("", "/"), F.lit(True)).when(F.endswith("s_path", F.lit("/")), F.startswith("r_path", c("s_path"))).otherwise(c("r_path") == c("s_path"))
    return F.when(c("named") == "'self'", own).when(c("named") == "", _covers(c("s_scheme"), c("r_scheme"))).when(anything, network | of_page).otherwise(scheme & port & path)


def csp_violations(origins: DataFrame, header_rules: DataFrame, directive: str = "default-src") -> DataFrame:
    """Origins in use that a policy forbids. ``origins`` has origin (an origin or a whole URL), and may have path and directive (what is loaded; ``directive`` without it), page (the URL of the page that loads it) and site.

    Each policy is judged alone, and only for the paths that its rule matches (for all without a path): what one rule allows counts nowhere else; with a site in both tables, only for the paths of its site. A
    missing directive is replaced by those that stand in for it; a policy that has none of them allows everything.

    Sources are matched by their parts: ``'self'`` is the page's own origin (nothing, where the page isn't known), a scheme stands for those it may be upgraded to (http for https), no scheme for the page's, no port for the
    default one, ``*`` for any; a path that ends in a slash covers what is below it, another one only itself, and an origin without a path stands for its root. ``'none'``, nonces and hashes allow no URL.
    """
    keys = _shared(("site",), origins, header_rules)
    own = [c for c in ("path", "directive") if c in origins.columns]
    page = F.coalesce(F.regexp_extract("page", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0), F.lit("")) if "page" in origins.columns else F.lit("")
    used = origins.select(*keys, *own, "origin", page.alias("page"))
    if "directive" not in own:
        used = used.withColumn("directive", F.lit(directive))
    sources = csp_sources(header_rules)
    # A policy is a line of a file of a site; those that aren't keys get other names.
    names = [f"of_{c}" for c in _shared(("site", "file"), sources) if c not in keys]
    sources = sources.withColumnsRenamed({x[3:]: x for x in names})
    policies = sources.groupBy(*keys, *names, "line_no", "pattern").agg(F.collect_set("directive").alias("has"))
    if "path" in own:
        met = glob_join(used, policies, "path", "pattern", tuple(keys))
    else:  # without a path every policy (of the site) is asked, in groups
        spread = policies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = used.withColumn("salt", F.pmod(F.xxhash64("origin"), F.lit(SALTS)).cast("int")).join(spread, [*keys, "salt"]).drop("salt")
    chains = F.create_map(*[x for k, v in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    chain = F.concat(F.array("directive"), F.coalesce(chains[F.col("directive")], F.array().cast("array<string>")))
    placed = met.withColumn("rule", F.get(F.filter(chain, lambda x: F.array_contains("has", x)), F.lit(0))).filter(F.col("rule").isNotNull())
    policy = [*keys, *names, "line_no", "rule"]
    # What a policy says of a resource depends on neither path nor directive: it is judged once for all paths, and the verdicts meet the paths again.
    asked = [*policy, "origin", "page"]
    judged = placed.select(*asked).distinct()
    known = F.when(F.col("page") != "", F.col("page"))
    # A resource meets the sources that name its host, the end of it behind ``*.``, any host, a scheme, or the page itself.
    split = judged.select("*", *_parts(F.col("origin"), "r_"), *_parts(known, "p_"))
    labels = F.split("r_host", r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: F.concat(F.lit("*."), F.array_join(F.slice(labels, n, F.size(labels)), ".")))
    each = split.withColumn("named", F.explode(F.array_distinct(F.concat(F.array(F.col("r_host"), F.lit("*"), F.lit(""), F.lit("'self'")), ends))))
    allowed = _source_parts(sources, [*keys, *names])
    if allowed.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        allowed = F.broadcast(allowed)
    good = each.join(allowed, [*policy, "named"]).filter(_allows()).select(*asked).distinct()
    bad = cut(judged.join(good, asked, "left_anti").toDF(*[f"bad_{c}" for c in asked]))
    if bad.limit(MAX_BROADCAST_VERDICTS + 1).count() <= MAX_BROADCAST_VERDICTS:
        bad = F.broadcast(bad)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"bad_{c}")) for c in asked])
    return placed.join(bad, same, "left_semi").select(*keys, *own, "origin").distinct()
