"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and non-ASCII characters. A benchmark item gives
each run of ``n`` consecutive words; an item of fewer words, but at least one, gives one run of all its words. The runs
form hash sets of word tuples; a lookup compares the words themselves, so a hit is a verified one. Document words that
are in no benchmark item end every run, and only runs that are long enough are looked up.

The set is broadcast if its runs number at most ``max_broadcast_runs``; beyond that, runs of documents and of items meet
in a shuffled join on the run's words, with the same results.

Null texts have no words. Benchmark rows with a null id or text are left out. Repeated benchmark rows count once per id,
repeated documents are each reported, an empty benchmark hits nothing, and very long texts are scanned whole. Extra columns of
``docs`` pass through: decontaminate() returns them all, and in scan() one that is named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, bound_batches, materialize, place, plain, restored, with_fields

# Fixed value: a word of letters, digits and non-ASCII characters, on lower-cased UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bound of the broadcast: runs of ten words take about 1 KB each as Python tuples, so 200 MB at most in a worker.
MAX_BROADCAST_RUNS = 200_000

Runs = dict[int, dict[tuple[int, ...], tuple[int, ...]]]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def _runs(words: list, n: int) -> list[tuple]:
    """The runs of an item's words: all of ``n`` words, or the whole of a shorter item."""
    if not words:
        return []
    return list({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})


class Matcher:
    """The hash set of a benchmark's runs: word numbers, then per length a map from runs to places in ``items``."""

    def __init__(self, rows: list[tuple[str, bytes]], n: int):
        self.items = sorted({x for x, _ in rows})
        place = {x: k for k, x in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in rows:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for run in _runs(numbers, n):
                found.setdefault(len(run), {}).setdefault(run, set()).add(place[item])
        self.runs: Runs = {k: {run: tuple(sorted(v)) for run, v in x.items()} for k, x in found.items()}

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a run, and the places of the items that occur."""
        hit = np.zeros(len(words), dtype=bool)
        occurring: set[int] = set()
        get = self.vocabulary.get
        numbers = [get(w, -1) for w in words]
        unknown = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(np.array(numbers, dtype=np.int64) < 0, out=unknown[1:])
        for length, known in self.runs.items():
            if len(words) < length:
                continue
            for i in np.flatnonzero(unknown[length:] == unknown[:-length]).tolist():
                if items := known.get(tuple(numbers[i : i + length])):
                    hit[i : i + length] = True
                    occurring.update(items)
        return hit, occurring


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text")).dropna().distinct()


REPORT = ("n_words", "n_hit", "items", "spans")
REPORT_TYPES = "n_words bigint, n_hit bigint, items array<string>, spans array<int>"


def _append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _spans(hit: np.ndarray) -> list[int]:
    """Word ranges as first, end, first, end ..."""
    return np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_runs: int = MAX_BROADCAST_RUNS) -> DataFrame:
    """Columns of ``docs`` and n_words, n_hit, items (ids as text, sorted) and spans (hit ranges of words, flat)."""
    return restored(_scan(docs, benchmark, n, max_broadcast_runs), docs, REPORT)


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, max_broadcast_runs: int) -> DataFrame:
    """plain(docs) and the report."""
    bound_batches(docs.sparkSession)
    items = _items(benchmark)
    # The benchmark's own size decides: white-space parts bound the number of words, and so of runs.
    size = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    if size <= 4 * max_broadcast_runs * n:
        rows = [(r.item, r.item_text.encode()) for r in items.toLocalIterator()]
        if sum(len(words_of(x)) for _, x in rows) <= max_broadcast_runs:
            return _scan_broadcast(docs, Matcher(rows, n))
    return _scan_shuffled(docs, items, n)


def _scan_broadcast(docs: DataFrame, matcher: Matcher) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(matcher)
    at = place(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for text in as_bytes(batch.column(at)):
                words = words_of(text)
                hit, occurring = m.scan(words)
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                items.append(sorted(m.items[k] for k in occurring))
                spans.append(_spans(hit) if occurring else [])
            yield _append(batch, n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), items=pa.array(items, pa.list_(pa.string())), spans=pa.array(spans, pa.list_(pa.int32())))

    return plain(docs).mapInArrow(work, with_fields(docs, REPORT_TYPES))


#: A run that very many documents hold meets its items in so many groups.
SALTS = 16


def _scan_shuffled(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """For a benchmark of any size: runs of documents and items joined by their words; spans are merged per document."""
    at = place(docs, "text")

    def item_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b" ".join(run), item, len(run)) for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("item_text")), strict=True) for run in _runs(words_of(text), n)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.int32()))], names=["run", "item", "size"])

    known = materialize(items.mapInArrow(item_runs, "run binary, item string, size int"), "runs")
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most n values

    def doc_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                for size in sizes:
                    starts = range(len(words) - size + 1)
                    if starts:
                        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(words[i : i + size]) for i in starts], pa.binary()), pa.array([row] * len(starts), pa.int64()), pa.array(starts, pa.int32())], names=["run", "row", "first"])

    rows = materialize(plain(docs).withColumn("row", F.monotonically_increasing_id()), "docs")
    runs = rows.select("row", F.col(f"d{at}").alias("text")).mapInArrow(doc_runs, "run binary, row bigint, first int")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = runs.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["run", "salt"])
    per_doc = found.groupBy("row").agg(F.collect_set("item").alias("found_items"), F.collect_set(F.struct("first", "size")).alias("found_runs"))
    width = len(docs.columns)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for text, some, places in zip(as_bytes(batch.column(f"d{at}")), batch.column("found_items").to_pylist(), batch.column("found_runs").to_pylist(), strict=True):
                hit = np.zeros(len(words_of(text)), dtype=bool)
                for x in places or []:
                    hit[x["first"] : x["first"] + x["size"]] = True
                n_words.append(len(hit))
                n_hit.append(int(hit.sum()))
                items.append(sorted(some or []))
                spans.append(_spans(hit))
            kept = batch.select([f"d{k}" for k in range(width)])
            yield _append(kept, n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), items=pa.array(items, pa.list_(pa.string())), spans=pa.array(spans, pa.list_(pa.int32())))

    return rows.join(per_doc, "row", "left").mapInArrow(merge, with_fields(docs, REPORT_TYPES))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", max_broadcast_runs: int = MAX_BROADCAST_RUNS) -> DataFrame:
    """``docs`` without contamination: hit documents go, or with remove="spans" the text from a hit range's first to its last word goes."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    scanned = _scan(docs, benchmark, n, max_broadcast_runs)
    if remove == "documents":
        return restored(scanned.filter(F.col("n_hit") == 0), docs)
    at, width = place(docs, "text"), len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for old, spans in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if not spans:
                    texts.append(old)
                    continue
                data = old.encode()
                words = [m.span() for m in WORD.finditer(data.lower())]
                pieces, last = [], 0
                for first, end in zip(spans[::2], spans[1::2], strict=True):
                    pieces.append(data[last : words[first][0]])
                    last = words[end - 1][1]
                texts.append(b"".join([*pieces, data[last:]]).decode())
            batch = batch.select([f"d{k}" for k in range(width)])
            yield batch.set_column(at, f"d{at}", pa.array(texts, pa.string()))

    return restored(scanned.mapInArrow(cut, plain(docs).schema), docs)


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def reference_digest(text: bytes | None, rows: list[tuple[str, bytes]], n: int = 10) -> tuple[int, int, int, str]:
    """The plain definition for one document, for tests: n_words, n_hit, n_items, items_sha256."""
    words, hit, found = words_of(text or b""), set(), set()
    for item, other in rows:
        mine = words_of(other)
        size = min(n, len(mine))
        for run in {tuple(mine[j : j + size]) for j in range(len(mine) - size + 1)} if size else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == run:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def oracle_sql(n: int = 10) -> str:
    """digest(scan(documents, benchmark)) in DuckDB SQL."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    pattern = WORD.pattern.decode()
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), {letters}), '{pattern}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item, least(len(w), {n}) AS size, unnest(list_transform(range(1, greatest(len(w) - {n} + 1, 1) + 1), lambda k: array_to_string(w[k:k + least(len(w), {n}) - 1], ' '))) AS run FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM i),
r AS (SELECT rid, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, s WHERE len(w) >= size),
x AS (SELECT rid, k, r.size, item FROM r JOIN i ON i.size = r.size AND i.run = array_to_string(w[k:k + r.size - 1], ' ')),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS p FROM x) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM x) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
