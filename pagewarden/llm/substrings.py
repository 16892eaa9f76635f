"""Removal of repeated passages by difference-cover anchors.

A passage is ``n`` consecutive words. Two equal passages start at any two places, yet a difference cover modulo a period
holds an offset below the period at which both have a covered place; so if only runs of words ("anchors") that start at
covered places are hashed, equal passages share one. Anchors that occur twice anywhere are found by one shuffle of hashes. Each is
then extended to all passages that hold it, and only these are hashed whole; a second shuffle finds the first occurrence of each.

Hashes travel packed: a task sends, for each hash range, one row of arrays, in which a hash stands once however often the task has
met it. A hot passage so reaches its range as one entry for each task, and what the task itself knows goes along as a result.

Anchors only find places to look at, by 64-bit hashes; equal words have equal ones. Passages are told apart by 128 bits of a hash of their bytes, documents by 96 bits of SHA-256 of id and text.

Defined cases: null text has no words. Very long texts are taken whole. Rows with the same doc_id and text are one document and get the same result. Documents with the
same doc_id and other texts are ordered by a hash of the text; a null doc_id is the smallest. Later copies of a whole text lose
all words (if they have ``n`` at least) without being hashed again. An empty table gives an empty result. Extra columns, of any name, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, dealt_join, gram_hashes, materialize, row_key, runs, word_hashes

SMALLEST = -(1 << 63)


@dataclass(frozen=True)
class Cover:
    """``n`` words a passage; ``places`` modulo ``period`` differ by every remainder; an anchor has n - period + 1 words."""

    n: int = 20
    period: int = 13
    places: tuple[int, ...] = (0, 1, 3, 9)

    def __post_init__(self):
        if {(a - b) % self.period for a in self.places for b in self.places} != set(range(self.period)) or self.n < self.period:
            raise ValueError("not a difference cover that fits the passage length")

    @property
    def anchor(self) -> int:
        return self.n - self.period + 1


#: A document's key: so many bytes of SHA-256 of its id and text.
KEY = np.dtype("S12")
#: Words a hash range stands for: their anchors or passages, at 36 bytes each, are met at once. A task meets one range after the other, so there are TASKS tasks at most.
RANGE_WORDS, TASKS = 400_000, 8192
#: Bytes of texts that a task packs at once.
PACKED = 2 << 20


def _parts(n_words: int) -> int:
    """How many hash ranges: in proportion to the input, so that a range's size doesn't grow."""
    return max(1, -(-n_words // RANGE_WORDS))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by hash range (``part``), in order within each task."""
    return rows.repartitionById(min(parts, TASKS), F.pmod("part", F.lit(min(parts, TASKS)))).sortWithinPartitions("part")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one hash range after the other, without its number."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
            if row[0] != now and rows:
                yield rows
                rows = []
            now = row[0]
            rows.append(row[1:])
    if rows:
        yield rows


def _word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts with single blanks between words, one after the other, and begin and end of each word there."""
    joined = b"\n".join(b" ".join(x.split()) for x in texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(((data != 32) & (data != 10)).view(np.int8), prepend=np.int8(0)))
    return joined, edge[0::2], edge[1::2]


def _places(counts: np.ndarray) -> np.ndarray:
    """The place of each word in its text."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _anchors(words: np.ndarray, counts: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Positions among all words, and hashes, of the anchors at covered places."""
    hashes = gram_hashes(words, cover.anchor)
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), hashes
    place, left = _places(counts)[: len(hashes)], np.repeat(counts, counts)[: len(hashes)]
    covered = np.zeros(cover.period, dtype=bool)
    covered[list(cover.places)] = True
    at = np.flatnonzero(covered[place % cover.period] & (place + cover.anchor <= left))
    return at, hashes[at]


def _by_part(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each hash range that has any: its number, and the indices in it, in order."""
    if not len(hashes):
        return
    part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(part[order[a]]), order[a:b]


def padded(keys: np.ndarray) -> list[bytes]:
    """Keys in their whole length; numpy drops zeros at the end."""
    return [x.ljust(KEY.itemsize, b"\0") for x in keys.tolist()]


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
    if not len(keys):
        return [], []
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return padded(keys[cuts]), [values[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]


def _repeated_anchors(docs: DataFrame, cover: Cover, parts: int) -> DataFrame:
    """key, anchors: per document (and hash range) the hashes of its anchors that occur twice or more anywhere."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_bytes(batch.column("text")), np.array(batch.column("key").to_pylist(), dtype=KEY)
            for first, end in runs(texts, PACKED):
                words, counts = word_hashes(texts[first:end])
                at, hashes = _anchors(words, counts, cover)
                owner = np.repeat(keys[first:end], counts)[at]
                _, place, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                known = times[back] > 1
                sent = ~known
                sent[place] = True
                rows = []
                for part, idx in _by_part(hashes, parts):
                    out, mine = idx[sent[idx]], idx[known[idx]]
                    rows.append((part, hashes[out].tobytes(), owner[out].tobytes(), known[out].tobytes(), hashes[mine].tobytes(), owner[mine].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6)], names=["part", "hashes", "owners", "twice", "known", "known_owners"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges(batches):
            hashes, owners, twice, known, known_owners = (np.frombuffer(b"".join(r[k] for r in rows), dtype=kind) for k, kind in enumerate((np.uint64, KEY, bool, np.uint64, KEY)))
            _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
            again = (times[back] > 1) & ~twice  # those met twice in one task are in ``known``
            keys, values = _by_key(np.concatenate([owners[again], known_owners]), np.concatenate([hashes[again], known]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "anchors"])

    sent = docs.select("key", "text").mapInArrow(send, "part int, hashes binary, owners binary, twice binary, known binary, known_owners binary")
    return _dealt(sent, parts).mapInArrow(meet, "key binary, anchors binary")


def _later_passages(flagged: DataFrame, cover: Cover, parts: int) -> DataFrame:
    """key, starts: per document (and hash range) the starts of passages that also start earlier."""
    entry = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("key", KEY), ("start", "<u4")])

    def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted by hash and then by document and start, and which are the first with their hash."""
        order = np.lexsort((x["start"], x["key"], x["doc"], x["h2"], x["h1"]))
        x = x[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
        return x, new

    def later(x: np.ndarray, new: np.ndarray) -> np.ndarray:
        """All but the first; rows of one document twice over don't count against each other."""
        lead = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        return ~new & ((x["key"] != x["key"][lead]) | (x["start"] != x["start"][lead]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts, keys = as_bytes(batch.column("text")), np.array(batch.column("key").to_pylist(), dtype=KEY)
            ids = np.array([SMALLEST if x is None else x for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
            repeated = batch.column("anchors").to_pylist()
            for first, end in runs(texts, PACKED):
                words, counts = word_hashes(texts[first:end])
                at, hashes = _anchors(words, counts, cover)
                wanted = np.unique(np.frombuffer(b"".join(b"".join(x) for x in repeated[first:end]), dtype=np.uint64))
                if not len(at) or not len(wanted) or len(words) < cover.n:
                    continue
                at = at[wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes]
                # An anchor extends to the passages that begin up to period - 1 words before it.
                change = np.zeros(len(words) + 1, dtype=np.int64)
                place, total = _places(counts), np.repeat(counts, counts)
                np.add.at(change, at - np.minimum(place[at], cover.period - 1), 1)
                np.add.at(change, at + 1, -1)
                starts = np.flatnonzero((np.cumsum(change)[:-1] > 0) & (place + cover.n <= total))
                x = np.zeros(len(starts), dtype=entry)
                joined, begins, ends = _word_places(texts[first:end])
                whole = memoryview(joined)
                digests = b"".join([xxh3_128_digest(whole[a:b]) for a, b in zip(begins[starts].tolist(), ends[starts + cover.n - 1].tolist(), strict=True)])
                x["h1"], x["h2"] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
                x["doc"], x["key"], x["start"] = np.repeat(ids[first:end], counts)[starts], np.repeat(keys[first:end], counts)[starts], place[starts]
                x, new = firsts(x)
                known = later(x, new)
                rows = []
                for part, idx in _by_part(x["h1"], parts):
                    # In the order of documents, neighbours have ids in common, which compresses.
                    out = x[idx[new[idx]]]
                    out, mine = out[np.lexsort((out["start"], out["key"]))], x[idx[known[idx]]]
                    rows.append((part, *[np.ascontiguousarray(out[f]).tobytes() for f in entry.names], mine["key"].tobytes(), mine["start"].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 8)], names=["part", *entry.names, "known", "known_starts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _ranges(batches):
            columns = [b"".join(r[k] for r in rows) for k in range(7)]
            x = np.zeros(len(columns[0]) // 8, dtype=entry)  # eight bytes of h1 each
            for name, column in zip(entry.names, columns, strict=False):
                x[name] = np.frombuffer(column, dtype=entry[name])
            x, new = firsts(x)
            x = x[later(x, new)]
            keys, values = _by_key(np.concatenate([x["key"], np.frombuffer(columns[5], KEY)]), np.concatenate([x["start"], np.frombuffer(columns[6], "<u4")]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["key", "starts"])

    kinds = ", ".join(f"{name} binary" for name in (*entry.names, "known", "known_starts"))
    return _dealt(flagged.mapInArrow(send, f"part int, {kinds}"), parts).mapInArrow(meet, "key binary, starts binary")


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def dedup(docs: DataFrame, cover: Cover = Cover(), with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by spaces).

    With ``with_text``, ``text`` holds these words. ``docs`` is read three times, so it should be a table or cheap to make.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text"), KEY.itemsize))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [x.split() for x in as_bytes(batch.column("text"))]
            new = [pa.array([len(x) for x in split], pa.int64()), pa.array([_sha(x) for x in split], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *new], names=["doc_id", "key", "digest", "n_words", "whole_sha"])

    measured = keyed.select("doc_id", "key", "text", F.sha2("text", 256).alias("digest")).mapInArrow(measure, "doc_id bigint, key binary, digest string, n_words bigint, whole_sha string")
    measured = materialize(measured, "measured")
    lowest = F.coalesce("doc_id", F.lit(SMALLEST))
    # Texts of several documents alone have a first one; a hot text's copies are dealt.
    lead = measured.groupBy("digest").agg(F.min(lowest).alias("lead"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    met = dealt_join(measured, lead, "digest", "key", "left")
    measured = materialize(met.select("doc_id", "key", "n_words", "whole_sha", F.coalesce(lowest > F.col("lead"), F.lit(False)).alias("is_copy")), "copies")
    parts = _parts(measured.agg(F.sum("n_words")).first()[0] or 0)

    anchors = _repeated_anchors(keyed, cover, parts).groupBy("key").agg(F.collect_list("anchors").alias("anchors"))
    anchors = anchors.join(measured.filter("is_copy"), "key", "left_anti")
    flagged = materialize(keyed.join(anchors, "key").select("key", "doc_id", "text", "anchors"), "flagged")
    starts = _later_passages(flagged, cover, parts).groupBy("key").agg(F.collect_list("starts").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for text, places in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                at = np.frombuffer(b"".join(places), dtype="<u4").astype(np.int64)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + cover.n, -1)
                keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
                kept = [words[i] for i in keep]
                removed.append(len(words) - len(kept))
                shas.append(_sha(kept))
                texts.append(b" ".join(kept).decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["key", "cut", "cut_sha", "cut_text"])

    cuts = flagged.select("key", "text").dropDuplicates(["key"]).join(starts, "key").mapInArrow(cut, "key binary, cut bigint, cut_sha string, cut_text string")
    whole_copy = F.col("is_copy") & (F.col("n_words") >= cover.n)
    out = measured.join(cuts, "key", "left").select(
        "doc_id",
        "key",
        "n_words",
        F.when(whole_copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole_copy, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "whole_sha")).alias("kept_sha256"),
        F.when(whole_copy, F.lit("")).otherwise(F.col("cut_text")).alias("cut_text"),
    )
    if not with_text:
        return out.drop("key", "cut_text")
    whole = keyed.select("key", F.array_join(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ").alias("whole_text")).dropDuplicates(["key"])
    return out.join(whole, "key").select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("cut_text", "whole_text").alias("text"))


def reference(rows: list[tuple[int | None, str | None]], n: int = 20) -> list[tuple[int | None, int, int, str]]:
    """The plain definition, for tests on few rows without repeated doc_ids."""
    seen: set[tuple[bytes, ...]] = set()
    out = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc_id, len(words), len(words) - len(kept), _sha(kept)))
    return out


def oracle_sql(n: int = 20) -> str:
    """dedup(documents) in DuckDB SQL, for tables without repeated doc_ids."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, md5(array_to_string(w[k:k + {n - 1}], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM d WHERE len(w) >= {n})),
l AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY run ORDER BY doc_id, k) AS place FROM x) WHERE place > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM l),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
c AS (SELECT v.doc_id, count(*) FILTER (g.k IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY v.k) FILTER (g.k IS NULL), '') AS kept FROM v LEFT JOIN g USING (doc_id, k) GROUP BY v.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""
