"""Quality rules by distribution divergence, in DataFrame functions alone.

Each language's reference is the sum of the histograms of all its documents that are long enough. A document is
rejected if it fails the base rules or if its character classes or its common words lie too far from the reference
(Jensen-Shannon distance, base 2).

The texts are measured once: measures and histograms are written to a table in the shared folder, the references are summed
from it, and verdicts follow from both without the texts.

Null text is empty and fails (too few words). A null or unlisted language has no reference: such documents are judged
by the base rules alone. Repeated rows are judged alike, very long texts are measured whole, and an empty table gives an empty result.
Extra columns pass through; one that is named like a result gives way to it in judge(), and keep() returns all columns as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import materialize, place, plain, restored

# Frequent function words by language, in lower case; 16 of each.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "ist", "in", "mit", "eine", "sich", "des", "auf", "nicht", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "as", "be", "with", "by"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "las", "un", "por", "con", "no", "una", "para", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
# The ASCII part of each character class, in the order in which they are counted.
CLASSES = [
    ("lower", r"[a-z]+"),
    ("blank", r"[\x20\x09-\x0D]+"),
    ("upper", r"[A-Z]+"),
    ("digit", r"[0-9]+"),
    ("mark", r"[.,;:!?'\x22()-]+"),
    ("symbol", r"[\x21-\x7E]+"),
]
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rules:
    """Limits. A text of fewer than ``guard_words`` words is too short to judge by divergence and passes that part.

    Short texts lie farther from any reference by chance, so a distance may be ``base + slack / sqrt(words)`` at most.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 50
    class_base: float = 0.12
    class_slack: float = 1.6
    common_base: float = 0.12
    common_slack: float = 1.3
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _count(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(word))).cast("double")


def histograms(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds the words and two histograms: ``q_classes`` (7 counts) and ``q_common`` (listed words of the language, then the rest)."""
    df = docs.withColumn("q_left0", F.coalesce(F.col("text"), F.lit("")))
    counts = []
    for k, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"q_left{k + 1}", F.regexp_replace(f"q_left{k}", pattern, ""))
        counts.append((F.length(f"q_left{k}") - F.length(f"q_left{k + 1}")).cast("double"))
    counts.append(F.length(f"q_left{len(CLASSES)}").cast("double"))
    listed = sorted({w for words in rules.common_words.values() for w in words})
    df = df.withColumns({"q_words": F.regexp_extract_all("q_left0", F.lit(WORD), F.lit(0)), "q_classes": F.array(*counts), "q_length": F.length("q_left0").cast("bigint")})
    df = df.withColumns({"q_n": F.size("q_words").cast("bigint"), "q_seen": F.filter(F.transform("q_words", F.lower), lambda w: w.isin(*listed))})
    hist = None
    for lang, words in sorted(rules.common_words.items()):
        each = [_count("q_seen", w) for w in words]
        hist = (F if hist is None else hist).when(F.col("lang") == lang, F.array(*each))
    df = df.withColumn("q_hits", hist)
    rest = F.col("q_n") - F.aggregate("q_hits", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("q_common", F.concat("q_hits", F.array(rest)))


def _shares(counts: Column) -> Column:
    return F.transform(counts, lambda x: x / F.aggregate(counts, F.lit(0.0), lambda a, y: a + y))


def references(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each listed language: ``r_classes`` and ``r_common`` shares over all its measured documents with enough words."""
    df = measured.filter(F.col("n_words") >= rules.guard_words).filter(F.col("lang").isin(*rules.common_words))
    n_classes, n_common = len(CLASSES) + 1, len(next(iter(rules.common_words.values()))) + 1
    sums = df.groupBy("lang").agg(
        F.array(*[F.sum(F.col("q_classes")[i]) for i in range(n_classes)]).alias("r0"),
        F.array(*[F.sum(F.col("q_common")[i]) for i in range(n_common)]).alias("r1"),
    )
    return sums.select(F.col("lang").alias("r_lang"), _shares(F.col("r0")).alias("r_classes"), _shares(F.col("r1")).alias("r_common"))


def _distance(counts: str, total: Column, reference: str) -> Column:
    """Jensen-Shannon distance between counts and reference shares."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)

    terms = F.zip_with(F.transform(counts, lambda x: x / total), reference, term)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept")


def measure(docs: DataFrame, rules: Rules = Rules(), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of plain(docs) that ``keep`` names (all of them without it), lang, the histograms and the base measures."""
    own = [f"d{place(docs, x)}" for x in (docs.columns if keep is None else keep)]
    df = plain(docs).withColumns({x: F.col(f"d{place(docs, x)}") for x in ("text", "lang")})
    df = histograms(df, rules)
    # Windows of three words, by hash; only texts in which one comes twice are sorted.
    grams = F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), lambda i: F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)))
    df = df.withColumn("q_grams", F.when(F.size("q_words") >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("q_grams")) < F.size("q_grams")
    df = df.withColumn("q_sorted", F.when(repeats, F.sort_array(F.transform("q_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce(F.get("q_sorted", k)["h"] == x["h"], F.lit(False))
    df = df.withColumn("q_starts", F.sort_array(F.transform(F.filter("q_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    # Each start covers three words, or those up to the next start.
    covered = F.transform("q_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("q_starts", k + 1) - s, F.lit(3))))
    df = df.withColumn("q_lines", F.filter(F.split("q_left0", "\n"), lambda x: x.rlike(WORD)))
    return df.select(
        *own,
        "lang",
        "q_classes",
        "q_common",
        "q_length",
        F.col("q_n").alias("n_words"),
        (F.col("q_length") - F.col("q_classes")[1].cast("bigint")).alias("word_chars"),
        # Symbols are in no class before ``symbol``, so only what is left by then has them.
        (F.length("q_left5") - F.length(F.regexp_replace("q_left5", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_repeat_words"),
    )


def _verdicts(docs: DataFrame, rules: Rules, keep: tuple[str, ...] | None = None) -> DataFrame:
    """plain(docs), as far as ``keep`` goes, with MEASURES. The references are as many rows as there are listed languages, whatever the input, so they are broadcast."""
    measured = materialize(measure(docs, rules, keep), "measures")
    df = measured.join(F.broadcast(references(measured, rules)), F.col("lang") == F.col("r_lang"), "left")
    df = df.withColumns(
        {
            "class_distance": _distance("q_classes", F.greatest(F.col("q_length"), F.lit(1)), "r_classes"),
            "common_distance": _distance("q_common", F.greatest(F.col("n_words"), F.lit(1)), "r_common"),
            "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        }
    )
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    far = (F.col("class_distance") > rules.class_base + rules.class_slack / root) | (F.col("common_distance") > rules.common_base + rules.common_slack / root)
    far = (F.col("n_words") >= rules.guard_words) & far
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def judge(docs: DataFrame, rules: Rules = Rules(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Columns of ``docs`` (those named, if any are) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, common_distance, base_failed, kept."""
    found = _verdicts(docs, rules, columns)
    if columns is None:
        return restored(found, docs, MEASURES)
    taken = {x.lower() for x in MEASURES}
    return found.select(*[F.col(f"d{place(docs, x)}").alias(x) for x in columns if x.lower() not in taken], *MEASURES)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return restored(_verdicts(docs, rules).filter("kept"), docs)


def oracle_sql(rules: Rules = Rules()) -> str:
    """The same verdicts in DuckDB SQL over ``documents``."""
    steps, left = [], "s"
    for k, (_, pattern) in enumerate(CLASSES):
        steps.append(f"regexp_replace({left}, '{pattern.replace("'", "''")}', '', 'g')")
        left = f"l{k + 1}"
    chain = "".join(f", a{k} AS (SELECT *, {x} AS l{k + 1} FROM {'t' if not k else f'a{k - 1}'})" for k, x in enumerate(steps))
    classes = ", ".join([f"length({'s' if not k else f'l{k}'}) - length(l{k + 1})" for k in range(len(CLASSES))] + [f"length(l{len(CLASSES)})"])
    listed = ", ".join(f"'{w}'" for w in sorted({w for words in rules.common_words.values() for w in words}))
    hits = " ".join(f"WHEN '{lang}' THEN [{', '.join(f"len(list_filter(seen, lambda x: x = '{w}'))" for w in words)}]" for lang, words in sorted(rules.common_words.items()))
    n_classes, n_common = len(CLASSES) + 1, len(next(iter(rules.common_words.values()))) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"
    distance = lambda c, total, r, n: f"sqrt(greatest(0.0, list_sum(list_transform(range(1, {n + 1}), lambda i: {term(f'({c}[i]::DOUBLE / {total})', f'{r}[i]')})) / 2))"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS s FROM documents){chain},
b AS (SELECT rid, doc_id, lang, s, [{classes}] AS classes, regexp_extract_all(s, '{WORD}') AS words FROM a{len(CLASSES) - 1}),
c AS (SELECT *, len(words) AS n, list_filter(list_transform(words, lambda x: lower(x)), lambda x: x IN ({listed})) AS seen FROM b),
d AS (SELECT *, CASE lang {hits} END AS hits FROM c),
e AS (SELECT *, list_append(hits, n - list_sum(hits)::BIGINT) AS common FROM d),
r0 AS (SELECT lang AS r_lang, {sums("classes", n_classes)} AS r0, {sums("common", n_common)} AS r1 FROM e WHERE n >= {rules.guard_words} AND hits IS NOT NULL GROUP BY lang),
r AS (SELECT r_lang, list_transform(r0, lambda x: x::DOUBLE / list_sum(r0)) AS r_classes, list_transform(r1, lambda x: x::DOUBLE / list_sum(r1)) AS r_common FROM r0),
g AS (SELECT rid, unnest(range(1, n - 1)) AS i, words FROM e WHERE n >= 3),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c FROM g),
k AS (SELECT rid, count(DISTINCT i + o) AS n_repeat FROM h, (VALUES (0), (1), (2)) v(o) WHERE c >= 2 GROUP BY rid),
m AS (SELECT e.*, coalesce(k.n_repeat, 0) AS n_repeat, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM e LEFT JOIN k USING (rid)),
o AS (SELECT m.*, {distance("classes", "greatest(length(s), 1)", "r_classes", n_classes)} AS dc, {distance("common", "greatest(n, 1)", "r_common", n_common)} AS dw, n < {rules.min_words} OR 100 * n_repeat > {rules.max_repeat_percent} * n AS failed FROM m LEFT JOIN r ON lang = r_lang)
SELECT doc_id, n::BIGINT AS n_words, (length(s) - classes[2])::BIGINT AS word_chars, (length(s) - length(regexp_replace(s, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT coalesce(n >= {rules.guard_words} AND (dc > {rules.class_base} + {rules.class_slack} / sqrt(greatest(n, 1)) OR dw > {rules.common_base} + {rules.common_slack} / sqrt(greatest(n, 1))), false) AS kept
FROM o"""
