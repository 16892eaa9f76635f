"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time: short lists are summed into accumulators, which then stand as one bounded list beside the long ones.

Documents are indexed where they are read, in shards that hold the postings of the queries' terms (document places and occurrences) and every document's length. Sums over all shards
give the number of documents, of terms, and the documents of each term; from these come the weights. Then every shard is searched on its own, and the best of all shards are the result.

In a shard, for one query: the lists are ordered by length, and the short ones (together at most ``short`` postings) are merged and summed: the accumulators. They are
one list with a bound, as each long list has a bound, both as a whole and for each run of ``RUN`` documents. Documents are then visited in ascending order, a window of runs at a time; runs whose
bounds together can't reach the least score among the best k are skipped in all lists. In a window, lists are taken by falling bound; a document is dropped as soon as its sum and the bounds of the lists to come stay
below that least score, and when few documents are left the long lists are only probed for these.

Null text, and text without a term, has no terms: such a document isn't counted and never found. Texts are read whole, in slices where they are long. Equal scores go by smaller doc_id (null last);
repeated documents are documents of their own, and repeated queries get their own results (with the same item_id). A query without terms has no results. Empty tables give no rows. Other columns are left out.

Queries are broadcast in batches of at most ``query_bytes`` of text (a longer query is a batch of its own); each batch is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, bounded_batches, materialize, remove_table, write_table

#: Documents in a run, which has bounds of its own, and runs in a window.
RUN, WINDOW = 256, 32
#: A shard is closed at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: A longer text is read in slices of about so many bytes.
SLICE = 1 << 22
INDEX = "n_docs bigint, n_terms bigint, term_ids array<int>, n_in array<bigint>, doc_ids binary, nulls binary, sizes binary, starts binary, docs binary, times binary"

#: From a byte to the lower-case byte of a term, or a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size unless one term is longer."""
    if len(text) <= SLICE:
        yield terms_of(text)
        return
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class _Shard:
    """Documents that wait to be written as one shard."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.n_waiting = self.n_postings = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        size, places = 0, []
        for terms in slices(text):
            size += len(terms)
            at = np.fromiter((self.vocabulary.get(x, -1) for x in terms), dtype=np.int32, count=len(terms))
            places.append(at[at >= 0])
        if not size:
            return
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.waiting += places
        self.lengths.append(sum(map(len, places)))
        self.n_waiting += self.lengths[-1]
        if self.n_waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        """Count the occurrences of the waiting documents' terms."""
        if not self.lengths:
            return
        first = len(self.ids) - len(self.lengths)
        doc = np.repeat(np.arange(first, len(self.ids), dtype=np.int64), self.lengths)
        keys, times = np.unique(np.concatenate(self.waiting) + (doc << 32), return_counts=True)
        self.found.append(((keys & 0xFFFFFFFF).astype(np.int32), (keys >> 32).astype(np.int32), times.astype(np.int64)))
        self.n_postings += len(keys)
        self.waiting, self.lengths, self.n_waiting = [], [], 0

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.n_postings >= SHARD_POSTINGS

    def row(self) -> dict:
        """The shard: documents by ascending doc_id, null last, and postings by term and document."""
        self.settle()
        nulls = np.array([x is None for x in self.ids], dtype=bool)
        ids = np.array([0 if x is None else x for x in self.ids], dtype=np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        term, doc, times = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, dtype=np.int32),) * 3
        by = np.lexsort((place[doc], term))
        term, doc, times = term[by], place[doc[by]], times[by]
        names, starts, counts = np.unique(term, return_index=True, return_counts=True)
        return {
            "n_docs": len(ids),
            "n_terms": sum(self.sizes),
            "term_ids": names.tolist(),
            "n_in": counts.tolist(),
            "doc_ids": ids[order].astype("<i8").tobytes(),
            "nulls": np.packbits(nulls[order]).tobytes(),
            "sizes": np.array(self.sizes, dtype="<i8")[order].tobytes(),
            "starts": starts.astype("<i8").tobytes(),
            "docs": doc.astype("<i4").tobytes(),
            "times": times.astype("<i8" if len(times) and times.max() >= 1 << 31 else "<i4").tobytes(),
        }


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs`` with the postings of the terms in ``vocabulary``, which is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    binary = {x: pa.binary() for x in ("doc_ids", "nulls", "sizes", "starts", "docs", "times")}
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("term_ids", pa.list_(pa.int32())), ("n_in", pa.list_(pa.int64())), *binary.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                shard.add(doc_id, text)
                if shard.full:
                    yield pa.RecordBatch.from_pylist([shard.row()], schema=schema)
                    shard.clear()
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], schema=schema)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(work, INDEX)


# -- search of a shard


class Postings:
    """A list of documents with their shares of the score, and bounds of the whole and of each run."""

    def __init__(self, docs: np.ndarray, shares: np.ndarray, n_runs: int):
        self.docs, self.shares = docs, shares
        self.bound = int(shares.max()) if len(shares) else 0
        self.runs = np.zeros(n_runs, dtype=np.int64)
        if len(docs):
            run = docs // RUN
            first = np.flatnonzero(np.diff(run, prepend=-1))
            self.runs[run[first]] = np.maximum.reduceat(shares, first)

    def add_to(self, total: np.ndarray, first: int, alive: np.ndarray) -> None:
        """Add the shares of the documents from ``first`` on that are alive; a list that is long beside them is only probed."""
        lo, hi = np.searchsorted(self.docs, [first, first + len(total)])
        if len(alive) * 8 < hi - lo:
            wanted = alive + first
            at = lo + np.searchsorted(self.docs[lo:hi], wanted)
            at[at == hi] = lo
            hit = self.docs[at] == wanted
            total[alive[hit]] += self.shares[at[hit]]
        else:
            total[self.docs[lo:hi] - first] += self.shares[lo:hi]


def accumulate(lists: list[Postings], n_runs: int) -> Postings:
    """Term-at-a-time: the sum of short lists, as one list."""
    docs = np.concatenate([x.docs for x in lists])
    shares = np.concatenate([x.shares for x in lists])
    order = np.argsort(docs, kind="stable")
    docs, shares = docs[order], shares[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return Postings(docs[first], np.add.reduceat(shares, first), n_runs)


def top(lists: list[Postings], n_docs: int, k: int, short: int, counter: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best documents with a score above 0, best first, smaller places before larger ones, and their scores."""
    n_runs = -(-n_docs // RUN)
    lists = sorted((x for x in lists if x.bound), key=lambda x: len(x.docs))
    ends = np.cumsum([len(x.docs) for x in lists])
    n_short = int(np.searchsorted(ends, short, side="right"))
    long = sorted(lists[n_short:], key=lambda x: -x.bound)
    best, scores, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1
    if n_short:
        accumulators = accumulate(lists[:n_short], n_runs)
        if len(accumulators.docs) >= k:  # so many documents have at least these scores
            least = max(least, int(np.partition(accumulators.shares, -k)[-k]))
        long = sorted([accumulators, *long], key=lambda x: -x.bound)
    if not long:
        return best, scores
    run_bounds = reduce(np.add, [x.runs for x in long])
    for w in range(0, n_runs, WINDOW):
        mine = run_bounds[w : w + WINDOW]
        if mine.max() < least:
            continue
        first = w * RUN
        width = min(WINDOW * RUN, n_docs - first)
        alive = np.flatnonzero(np.repeat(mine >= least, RUN)[:width])
        total = np.zeros(width, dtype=np.int64)
        # What lists to come can add in this window.
        rest = sum(int(x.runs[w : w + WINDOW].max()) for x in long)
        for x in long:
            rest -= int(x.runs[w : w + WINDOW].max())
            x.add_to(total, first, alive)
            if counter is not None:
                counter["alive"] = counter.get("alive", 0) + len(alive)
            alive = alive[total[alive] >= max(1, least) - rest]
            if not len(alive):
                break
        alive = alive[total[alive] >= least]
        if len(alive):
            best, scores = np.concatenate([best, alive + first]), np.concatenate([scores, total[alive]])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            if len(best) == k:
                least = max(least, int(scores[-1]))
    return best, scores


class Shard:
    """A shard whose postings carry their shares of the score."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.n = len(self.ids)
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=self.n).astype(bool)
        docs = np.frombuffer(row["docs"], "<i4").astype(np.int64)
        times = np.frombuffer(row["times"], "<i4" if len(row["times"]) == 4 * len(docs) else "<i8").astype(np.int64)
        starts = np.append(np.frombuffer(row["starts"], "<i8"), len(docs))
        # Integers of any size, once for each length that occurs.
        values, at = np.unique(sizes, return_inverse=True)
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in values], dtype=np.int64)[at]
        terms = np.array(row["term_ids"], dtype=np.int64)
        shares = 1_000_000_000 * times // (1000 * times + 20 * m[docs]) * np.repeat(weights[terms], np.diff(starts)) if len(docs) else times
        self.n_runs = -(-self.n // RUN)
        self.lists = {int(t): Postings(docs[a:b], shares[a:b], self.n_runs) for t, a, b in zip(terms, starts[:-1], starts[1:], strict=True)}


def weight(n_docs: int, n_in: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_in + 1)))


def _search(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int, short: int) -> DataFrame:
    """number, doc_id, score and rank of the best documents for each numbered list of terms."""
    spark = docs.sparkSession
    vocabulary = {t: j for j, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    shards, path = write_table(index(docs, vocabulary), "shards")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in shards.select(F.inline(F.arrays_zip("term_ids", "n_in"))).groupBy("term_ids").agg(F.sum("n_in").alias("n")).collect():  # at most the terms of the queries
        weights[r.term_ids] = weight(n_docs, r.n)
    shared = spark.sparkContext.broadcast((weights, [(number, sorted({vocabulary[t] for t in terms})) for number, terms in items]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights, n_docs, n_terms)
                for number, terms in wanted:
                    lists = [shard.lists[t] for t in terms if t in shard.lists]
                    best, scores = top(lists, shard.n, k, short or max(1024, shard.n // 8))
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), number)), pa.array(shard.ids[best], mask=shard.nulls[best]), pa.array(scores)], names=["number", "doc_id", "score"])

    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = shards.mapInArrow(work, "number bigint, doc_id bigint, score bigint").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = materialize(found, "found")
    remove_table(spark, path)
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = 50, short: int = 0, query_bytes: int = 1 << 24) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``queries`` (item_id, text). ``short``: postings of the short lists together (0: by the shard's size)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # Queries get numbers, which are kept with them: equal rows too stay apart.
    queries = queries.select(F.monotonically_increasing_id().alias("number"), "item_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered, path = write_table(queries, "queries")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batch = F.pmod(F.xxhash64("number"), F.lit(max(1, -(-2 * size // query_bytes)) if size > query_bytes else 1))
    sizes = numbered.groupBy(batch.alias("batch")).agg(F.sum(F.octet_length("text")).alias("n")).collect() if size > query_bytes else [(0, size)]
    found = []
    with bounded_batches(spark):
        for number, _ in sorted(tuple(x) for x in sizes):
            items = [(r.number, terms_of(r.text.encode())) for r in numbered.filter(batch == number).collect()]  # about ``query_bytes`` of text
            if any(terms for _, terms in items):
                found.append(_search(docs, items, k, short))
        if found:
            names = numbered.select("number", "item_id")
            out = reduce(DataFrame.union, found).join(names, "number").select("item_id", "rank", "doc_id", "score")
        else:
            kind = numbered.schema["item_id"].dataType.simpleString()
            out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
        out = materialize(out, "ranked")
    remove_table(spark, path)
    return out


def oracle_sql() -> str:
    """The ranking of the documents for the benchmark items in DuckDB SQL."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH words AS (
    SELECT d, doc_id, unnest(regexp_extract_all({folded}, '{pattern}')) AS term FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
), lengths AS (
    SELECT d, doc_id, count(*) AS n FROM words GROUP BY d, doc_id
), sums AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), wanted AS (
    SELECT DISTINCT i, item_id, term FROM (
        SELECT i, item_id, unnest(regexp_extract_all({folded}, '{pattern}')) AS term FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
    )
), postings AS (
    SELECT term, d, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY term, d
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sums GROUP BY term, n_docs
), scored AS (
    SELECT i, item_id, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (d), sums GROUP BY i, item_id, doc_id, d
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 50
"""
