"""Patterns with ``*`` joined to texts: an equi join on a literal part of each pattern, whatever its place in the pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagewarden.functions import urls

#: So many keys of rules at most are sent to every task.
MAX_BROADCAST_RULES = 10_000
#: Beyond that, rules meet the texts of a common key in so many groups.
SALTS = 16
#: Characters of a key from the inside of a pattern, and the least of one from its begin or end.
GRAM, LEAST = 4, 2


def _grams(text: Column) -> Column:
    """Keys of all runs of GRAM characters."""
    return F.transform(F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.lit("inside").alias("kind"), F.substr(text, k, F.lit(GRAM)).alias("text")))


def _pattern_keys(pattern: Column) -> Column:
    """Every key that a pattern could be found by: its literal begin and end, and runs inside."""
    parts = F.split(pattern, r"\*")
    n = F.size(parts)
    key = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    begin, end, none = F.get(parts, F.lit(0)), F.element_at(parts, -1), F.array().cast("array<struct<kind:string,text:string>>")
    inside = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), _grams))
    return F.concat(F.when((n == 1) | (F.length(begin) >= LEAST), key("begin", begin)).otherwise(none), F.when((n > 1) & (F.length(end) >= LEAST), key("end", end)).otherwise(none), inside)


def _text_keys(text: Column, lengths: dict[str, list[int]]) -> Column:
    """Every key of the lengths at hand that a text has."""
    key = lambda kind, part: F.struct(F.lit(kind).alias("kind"), part.alias("text"))
    fits = lambda kind: F.filter(F.array(*map(F.lit, lengths[kind])), lambda n: n <= F.length(text))
    found = []
    if lengths.get("begin"):
        found.append(F.transform(fits("begin"), lambda n: key("begin", F.substr(text, F.lit(1), n))))
    if lengths.get("end"):
        found.append(F.transform(fits("end"), lambda n: key("end", F.substr(text, F.length(text) - n + 1, n))))
    if lengths.get("inside"):
        found.append(F.array_distinct(_grams(text)))
    return F.concat(*found)


def pattern_kinds(rules: DataFrame, pattern: str) -> list[Row]:
    """kind, n, count: the kinds and lengths of the keys that patterns have (null: patterns without any); as many rows as there are lengths."""
    return rules.select(F.explode_outer(_pattern_keys(F.col(pattern))).alias("g")).groupBy("g.kind", F.length("g.text").alias("n")).count().collect()


def glob_join(paths: DataFrame, rules: DataFrame, column: str, pattern: str, keys: tuple[str, ...] = (), kinds: list[Row] | None = None) -> DataFrame:
    """Pairs of rows whose text matches the rule's pattern (``*`` is anything), and that agree in ``keys``, such as a site.

    A rule is found by one literal part of its pattern: its begin, its end or four characters inside, the one that the fewest texts have (of equals the longest). Texts are looked up under their parts of
    these kinds and of the lengths that rules have, so this stays an equi join for any number of rules, and a common begin such as ``/`` is no key of a rule that ends in something rare.
    Patterns without such a part (``/*``) match nearly every text; they stay out of that join and are tried on all texts that agree in ``keys``. ``kinds`` are those of pattern_kinds(), for rules that are joined again and again.
    """
    keyed = rules.withColumn("glob_keys", _pattern_keys(F.col(pattern)))
    kinds = pattern_kinds(rules, pattern) if kinds is None else kinds
    lengths: dict[str, list[int]] = {}
    for r in kinds:
        if r.kind is not None:
            lengths.setdefault(r.kind, []).append(r.n)
    like = F.like(F.col(column), urls.glob_like(F.col(pattern)), F.lit("!"))
    few = sum(r["count"] for r in kinds) <= MAX_BROADCAST_RULES
    found = []
    if lengths:
        lengths = {kind: sorted(n) for kind, n in lengths.items()}
        each = paths.withColumn("glob_key", F.explode(_text_keys(F.col(column), lengths)))
        possible = keyed.select(*keys, pattern, F.explode("glob_keys").alias("glob_key")).distinct()
        wanted = possible.select(*keys, "glob_key").distinct()
        counts = each.select(*keys, "glob_key").join(F.broadcast(wanted) if few else wanted, [*keys, "glob_key"]).groupBy(*keys, "glob_key").agg(F.count("*").alias("glob_n"))
        rank = F.struct("glob_n", -F.length("glob_key.text"), "glob_key")
        # Without any text that has one of its parts a rule meets nothing.
        whole = possible.join(counts, [*keys, "glob_key"], "left").groupBy(*keys, pattern).agg(F.min_by("glob_key", F.when(F.col("glob_n").isNotNull(), rank)).alias("glob_key"), F.bool_and(F.col("glob_n").isNotNull()).alias("glob_all"))
        chosen = whole.filter("glob_all").select(*keys, pattern, "glob_key")
        own, on = keyed.drop("glob_keys").join(chosen, [*keys, pattern]), [*keys, "glob_key"]
        if few:
            own = F.broadcast(own)
        else:
            on.append("glob_salt")
            each = each.withColumn("glob_salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))
            own = own.withColumn("glob_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found.append(_columns(each.join(own, on).filter(like), paths, rules, keys))
    if any(r.kind is None for r in kinds) or not kinds:
        weak = keyed.filter(F.size("glob_keys") == 0).drop("glob_keys").withColumn("glob_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = paths.withColumn("glob_salt", F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int"))
        found.append(_columns(salted.join(F.broadcast(weak) if few else weak, [*keys, "glob_salt"]).filter(like), paths, rules, keys))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _columns(pairs: DataFrame, paths: DataFrame, rules: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return pairs.select(*paths.columns, *[c for c in rules.columns if c not in keys])
