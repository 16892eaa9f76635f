"""Links of pages: extraction, resolution, broken ones, redirects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.functions import urls
from pagewarden.operators.globs import glob_join, pattern_kinds
from pagewarden.sources.tables import cut


def extract_links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, attr, raw: every link value of the text as it stands, scripts and comments too, with its attribute (href, src, data-src ...); the page text goes no further."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(urls.NAMED_LINK), F.lit(0))).alias("pos", "found"))
    attr = F.substring_index("found", "=", 1)
    return found.select("page_id", "url", "pos", attr.alias("attr"), F.substr("found", F.length(attr) + 3, F.length("found") - F.length(attr) - 3).alias("raw"))


def classify_links(links: DataFrame) -> DataFrame:
    return links.withColumn("external", urls.is_external(F.col("raw")))


def checked_paths(links: DataFrame, base: str, site: str | None = None, strict: bool = False) -> DataFrame:
    """Adds ``path`` and keeps the links that are checked: local ones, and those to https://site/. ``base`` names the column with the page's path.

    ``strict`` leaves out ``//host/x``, which otherwise counts as local.
    """
    clean = urls.strip_suffix(F.col("raw"))
    local = F.when(~urls.is_external(F.col("raw")) & (clean != ""), urls.resolve_path(F.col(base), clean))
    if strict:
        local = F.when(~F.col("raw").startswith("//"), local)
    path = F.coalesce(urls.onsite_path(F.col("raw"), site), local) if site else local
    return links.withColumn("path", path).filter(F.col("path").isNotNull())


def _shared(keys: tuple[str, ...], rules: DataFrame) -> list[str]:
    """The keys that rules have, too; without any, rules hold for all."""
    return [k for k in keys if k in rules.columns]


def broken_links(links: DataFrame, inventory: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Links (with ``path``) for which no candidate file exists and that no redirect names. ``keys`` are further columns that must agree with the inventory, such as a site, and with the rules, where these have them.

    Navigation repeats on every page, so each distinct path is looked up once; two semi joins stand for the alternatives. The distinct paths are written, so links are made twice only: for these, and for the result.
    """
    targets = cut(links.select(*keys, "path").distinct())
    candidates = targets.select(*keys, "path", F.explode(urls.candidate_keys(F.col("path"))).alias("key"))
    files = inventory.select(*keys, F.col("path").alias("key")).distinct()
    found = candidates.join(files, [*keys, "key"], "left_semi").select(*keys, "path").distinct()
    own = _shared(keys, rules)
    missing = targets.join(found, [*keys, "path"], "left_anti").join(rules.select(*own, F.col("src").alias("path")).distinct(), [*own, "path"], "left_anti")
    return links.join(missing, [*keys, "path"], "left_semi")


def last_rules(rules: DataFrame, wins: str = "last", keys: tuple[str, ...] = ()) -> DataFrame:
    """src, dst (and keys): one target a source; of several the last (or first) line wins."""
    choose = F.max_by if wins == "last" else F.min_by
    return rules.groupBy(*keys, "src").agg(choose("dst", "line_no").alias("dst"))


def apply_redirects(paths: DataFrame, rules: DataFrame, column: str = "path", wins: str = "last", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``target``: where an exact rule (of the same site, if the rules have ``keys``) sends the path, or null. Wildcards are literal here."""
    own = _shared(keys, rules)
    return paths.join(last_rules(rules, wins, tuple(own)).select(*own, F.col("src").alias(column), F.col("dst").alias("target")), [*own, column], "left")


def _splat(column: str, src: Column) -> Column:
    """What the ``*`` of a pattern stands for."""
    head = F.substring_index(src, "*", 1)
    tail = F.when(src.contains("*"), F.substring_index(src, "*", -1)).otherwise(F.lit(""))
    return F.substr(F.col(column), F.length(head) + 1, F.length(column) - F.length(head) - F.length(tail))


def apply_splat_redirects(paths: DataFrame, rules: DataFrame, column: str = "url", keys: tuple[str, ...] = ()) -> DataFrame:
    """The first rule by line (of the same site, if the rules have ``keys``) whose pattern matches each path, with ``:splat`` in its target replaced by what ``*`` stands for."""
    own = _shared(keys, rules)
    found = glob_join(paths.select(*own, column).distinct(), rules.select(*own, "line_no", "src", "dst"), column, "src", tuple(own))
    first = found.groupBy(*own, column).agg(F.min_by(F.struct("src", "dst"), "line_no").alias("rule"))
    target = F.replace(F.col("rule.dst"), F.lit(":splat"), _splat(column, F.col("rule.src")))
    return paths.join(first.select(*own, column, F.col("rule.src").alias("rule"), target.alias("target")), [*own, column])


def _step(urls_: DataFrame, rules: DataFrame, kinds: list[Row]) -> DataFrame:
    """at, target: the first rule by line that matches each URL ``at`` as a whole or by its path."""
    own = _shared(("site",), rules)
    clean = urls.strip_suffix(F.col("at"))
    forms = urls_.select("at", urls.host(F.col("at")).alias("site"), F.explode(F.array(clean, urls.url_path(F.col("at")))).alias("form"))
    met = glob_join(forms.select("at", *own, "form"), rules.select(*own, "line_no", "src", "dst"), "form", "src", tuple(own), kinds)
    first = met.groupBy("at").agg(F.min_by(F.struct("src", "dst", "form"), F.struct("line_no", "form")).alias("r")).select("at", F.col("r.src").alias("src"), F.col("r.dst").alias("dst"), F.col("r.form").alias("form"))
    target = F.replace(F.col("dst"), F.lit(":splat"), _splat("form", F.col("src")))
    origin = F.regexp_extract("at", r"(?i)^https?://[^/?#]*", 0)
    return first.select("at", F.when(F.startswith(target, F.lit("/")), F.concat(origin, target)).otherwise(target).alias("target"))


def follow_redirects(starts: DataFrame, rules: DataFrame, column: str = "url", max_hops: int = 20) -> DataFrame:
    """url, hops, final, outcome: where every URL ends under exact and wildcard rules.

    Rules (line_no, src, dst) may have a ``site``: they then hold for the URLs of that host alone, with or without ``www.``. A source is a path or a whole URL, ``*`` in it anything; of all that match, the first line wins. A target
    that begins with a slash stays on the host. Query and fragment of a URL aren't matched, nor carried on.

    ``outcome`` is ``ends`` where no rule matches further, ``loops`` where a URL comes back (``final`` is that URL, ``hops`` the steps until then), and ``endless`` where after ``max_hops`` steps a rule still
    matches: wildcards can make ever new URLs, so that needs a bound, as browsers have one. Each round looks up only the different URLs that were reached last; those that no rule matches leave the walk.
    """
    walk = cut(starts.select(F.col(column).alias("start")).distinct().select("start", F.col("start").alias("at"), F.array("start").alias("seen")))
    rules = cut(rules)
    kinds, done = pattern_kinds(rules, "src"), []
    for hop in range(max_hops + 1):
        if not walk.limit(1).count():
            break
        met = cut(walk.join(_step(walk.select("at").distinct(), rules, kinds), "at", "left"))
        ended = met.filter("target IS NULL")
        done.append(ended.select("start", F.lit(hop).alias("hops"), F.col("at").alias("final"), F.lit("ends").alias("outcome")))
        goes = met.filter("target IS NOT NULL")
        if hop == max_hops:
            done.append(goes.select("start", F.lit(hop).alias("hops"), F.col("at").alias("final"), F.lit("endless").alias("outcome")))
            break
        back = F.array_contains("seen", F.col("target"))
        done.append(goes.filter(back).select("start", F.lit(hop + 1).alias("hops"), F.col("target").alias("final"), F.lit("loops").alias("outcome")))
        walk = goes.filter(~back).select("start", F.col("target").alias("at"), F.array_append("seen", F.col("target")).alias("seen"))
    if not done:
        done = [walk.select("start", F.lit(0).alias("hops"), F.col("at").alias("final"), F.lit("ends").alias("outcome"))]
    return reduce(DataFrame.unionByName, done).withColumnRenamed("start", column)


def _follow(walk: DataFrame) -> DataFrame:
    """src, at, hops two times as far as before; ``open`` tells where the way goes on. A place without a way on stays."""
    ahead = walk.select(F.col("src").alias("at"), F.col("at").alias("further"), F.col("hops").alias("more"), F.col("open").alias("still"))
    met = walk.join(ahead, "at", "left")
    goes = F.col("open") & F.col("further").isNotNull()
    return met.select("src", F.when(goes, F.col("further")).otherwise(F.col("at")).alias("at"), (F.col("hops") + F.when(goes, F.col("more")).otherwise(F.lit(0))).alias("hops"), (goes & F.col("still")).alias("open"))


def redirect_chains(rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """src, hops, final, loops: where each source ends after following exact rules. ``loops`` where the way comes back to a path, after ``hops`` steps, at ``final``.

    With a key that rules have, such as a site, each site's rules are followed for themselves, and the site is in the result; a target that names another host goes on by that host's rules (``final_site``, ``final``).
    Ways are followed by doubling: each round joins the walk with itself and takes every source twice as far, so a chain of n steps takes log2(n) rounds.
    """
    own = _shared(keys, rules)
    if own:
        return _site_chains(rules, own)
    one = cut(last_rules(rules))
    ends = one.join(one.select(F.col("src").alias("dst")), "dst", "left_semi").select("dst").distinct().withColumn("on", F.lit(True))
    walk = cut(one.join(ends, "dst", "left").select("src", F.col("dst").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.coalesce("on", F.lit(False)).alias("open")))
    total, reach = one.count(), 1
    while reach < total and walk.filter("open").limit(1).count():
        walk, reach = cut(_follow(walk)), 2 * reach
    done = walk.filter("NOT open").select("src", "hops", F.col("at").alias("final"), F.lit(False).alias("loops"))
    looping = walk.filter("open")
    if not looping.limit(1).count():
        return done
    # After as many steps as there are rules, a way that is still open is in its loop; all places of the loop are such places.
    inside = cut(looping.select(F.col("at").alias("src")).distinct())
    ring = cut(one.join(inside, "src", "left_semi").select("src", F.col("dst").alias("at"), F.least("src", "dst").alias("least")))
    reach = 1
    while reach < total:
        ahead = ring.select(F.col("src").alias("at"), F.col("at").alias("further"), F.col("least").alias("other"))
        ring, reach = cut(ring.join(ahead, "at").select("src", F.col("further").alias("at"), F.least("least", "other").alias("least"))), 2 * reach
        if not ring.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") > reach).limit(1).count():
            break
    around = ring.select("src", F.count("*").over(W.partitionBy("least")).alias("around"))
    entered = one.join(looping.select("src"), "src", "left_semi").join(inside.select(F.col("src").alias("dst"), F.lit(True).alias("there")), "dst", "left")
    tails = cut(entered.join(inside, "src", "left_anti").select("src", F.col("dst").alias("at"), F.lit(1).cast("bigint").alias("hops"), F.col("there").isNull().alias("open")))
    while tails.filter("open").limit(1).count():
        tails = cut(_follow(tails))
    loops = tails.select("src", F.col("at").alias("entry"), "hops").unionByName(inside.select("src", F.col("src").alias("entry"), F.lit(0).cast("bigint").alias("hops")))
    met = loops.join(around.withColumnRenamed("src", "entry"), "entry")
    return done.unionByName(met.select("src", (F.col("hops") + F.col("around")).alias("hops"), F.col("entry").alias("final"), F.lit(True).alias("loops")))


def _site_chains(rules: DataFrame, keys: list[str]) -> DataFrame:
    """redirect_chains() over places that hold their site."""
    site, *more = keys
    absolute = F.col("dst").rlike(r"(?i)^https?://")
    place = lambda where, path: F.struct(where.alias("site"), *[F.col(k) for k in more], path.alias("path"))
    there = place(F.when(absolute, urls.host(F.col("dst"))).otherwise(F.col(site)), F.when(absolute, urls.url_path(F.col("dst"))).otherwise(F.col("dst")))
    chains = redirect_chains(rules.select("line_no", place(F.col(site), F.col("src")).alias("src"), there.alias("dst")))
    return chains.select(F.col("src.site").alias(site), *[F.col(f"src.{k}").alias(k) for k in more], F.col("src.path").alias("src"), "hops", F.col("final.site").alias(f"final_{site}"), F.col("final.path").alias("final"), "loops")
