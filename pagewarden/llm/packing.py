"""Best-fit packing by minimum bin slack: documents in as few sequences of at most ``capacity`` tokens as can be found.

Only lengths matter for packing, and there are at most ``capacity`` different ones. So the pieces are counted by length (a table of at most
``capacity`` rows), the bins are filled on these counts, and the pieces take their places by their rank among those of their length.

A bin holds the longest piece that is left; a subset-sum programme over the lengths that are left, as a bitset of reachable sums, finds the
fullest combination beside it. The combination is taken out as often as the counts allow, which is what bin after bin would give, since it stays
feasible and no other can be fuller. The work on the counts doesn't grow with the rows: each combination leaves some length with fewer pieces than it needs once more, so there are at most about
``capacity * ln(capacity)`` of them.

Texts stay where they are read; the pieces (without ids) are written once and joined with the counts of earlier parts of the table.

Null text is empty: a piece of the end id alone. Texts of any length are cut into pieces of ``capacity`` ids, the last one may be shorter. Rows with equal doc_id, and
equal rows, are packed each for itself; which of several pieces of one length comes where is left open, as are the numbers of sequences. A null doc_id stays
null. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, bounded_batches, materialize
from pagewarden.llm.tokenstore import ChunkEncoder, chunk_encoder

CAPACITY = 4096
#: Different parts of texts whose ids a worker keeps.
CACHED = 1_200_000
#: A longer text is encoded in slices of about so many bytes, cut at white space.
SLICE = 1 << 22
PIECES = "part int, local bigint, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"


def fullest(longest: int, counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of the lengths at hand that holds ``longest``: how often it takes each length.

    Lengths are tried from long to short, so of equally full combinations one with longer pieces comes first.
    """
    room = capacity - longest
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if reach >> room:
            break
        most = min(counts[length] - (length == longest), room // length)
        if most <= 0:
            continue
        steps.append((length, reach))
        done = 0
        while done < most:
            more = min(done + 1, most - done)
            reach |= reach << more * length & mask
            done += more
    target = reach.bit_length() - 1
    taken = {longest: 1}
    for length, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= length
            n += 1
        if n:
            taken[length] = taken.get(length, 0) + n
    return taken


def fill_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length: times) and the number of bins filled with each, for all pieces of these lengths."""
    left = {length: n for length, n in counts.items() if n > 0}
    out = []
    while left:
        taken = fullest(max(left), left, capacity)
        times = min(left[length] // n for length, n in taken.items())
        for length, n in taken.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
        out.append((taken, times))
    return out


class Plan:
    """The places of all pieces, from the counts of lengths: sorted ranges of (length, rank)."""

    SHIFT = 46

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        used: dict[int, int] = {}
        rows, self.n_sequences = [], 0
        for taken, times in fill_bins(counts, capacity):
            offset = 0
            for length, n in taken.items():
                rows.append((length << self.SHIFT | used.get(length, 0), used.get(length, 0), self.n_sequences, n, offset))
                used[length] = used.get(length, 0) + n * times
                offset += length * n
            self.n_sequences += times
        self.first, self.rank, self.sequence, self.times, self.offset = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these ranks among those of their length."""
        row = np.searchsorted(self.first, (length << self.SHIFT) + rank, side="right") - 1
        within = rank - self.rank[row]
        return self.sequence[row] + within // self.times[row], self.offset[row] + within % self.times[row] * length


def slices(text: bytes, most: int = SLICE) -> Iterator[bytes]:
    """Parts of a text, cut at ASCII white space where it is longer."""
    at = 0
    while len(text) - at > most:
        # One part of the tokenizer's work may be longer than a slice; it stays whole.
        ends = [x for x in (text.find(b, at + most) for b in (b" ", b"\n", b"\t")) if x >= 0]
        if not ends:
            break
        yield text[at : min(ends)]
        at = min(ends)
    yield text[at:] if at else text


def encode_document(encoder: ChunkEncoder, text: bytes) -> np.ndarray:
    """The ids of one text of any length."""
    return np.concatenate([encoder([x])[0] for x in slices(text)])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32; part and local number the pieces of one length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = chunk_encoder(tokenizer_path, CACHED)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts, doc_ids = as_bytes(batch.column("text")), batch.column("doc_id")
            k = 0
            while k < len(texts):
                n = 1
                if len(texts[k]) <= SLICE:
                    size = len(texts[k])
                    while n < 1024 and k + n < len(texts) and size + len(texts[k + n]) <= SLICE:
                        size += len(texts[k + n])
                        n += 1
                    ids, counts = encoder(texts[k : k + n])
                    own = np.split(ids, np.cumsum(counts)[:-1])
                else:
                    own = [encode_document(encoder, texts[k])]
                own = [np.concatenate([x, end]).astype("<u4", copy=False) for x in own]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                n_pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                crcs = [zlib.crc32(own[d][s : s + m]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                # The rank of each piece among those of its length in this part.
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                first = np.searchsorted(sorted_, sorted_, side="left")
                local = np.empty(len(doc), dtype=np.int64)
                local[order] = seen[sorted_] + np.arange(len(doc)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(local), doc_ids.slice(k, n).cast(pa.int64()).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crcs, pa.int64())],
                    names=["part", "local", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                k += n

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(work, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; sequences have no gaps."""
    spark = docs.sparkSession
    with bounded_batches(spark):
        cut = materialize(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    parts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    plan = Plan({r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(plan)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset = shared.value.place(length, batch.column("rank").to_numpy())
            kept = [batch.column(x) for x in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
