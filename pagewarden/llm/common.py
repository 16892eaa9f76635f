"""What the operators of this folder share: shared-folder tables, columns that can't clash, Arrow batches and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewarden.sources.tables import dealt_join, remove_table, shared_folder, write_table

__all__ = ["dealt_join", "remove_table", "shared_folder", "write_table"]

#: ASCII white space: the bytes that part words.
BLANKS = b" \t\n\x0b\x0c\r"


#: Bytes of texts that a Python worker gets at once, where the session doesn't say. Spark's own bound is 64 MB, which a worker and the JVM hold several times over.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Set the size of Arrow batches, where the session leaves it open; a longer text is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, size: str = BATCH_BYTES) -> Iterator[None]:
    """bound_batches() for the jobs that run inside; the session then has its own setting again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """write_table() for a table that the result still reads: the lineage ends there, and it survives lost executors."""
    return write_table(df, label)[0]


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc_id: Column, text: Column, size: int = 16) -> Column:
    """So many bytes of SHA-256 of a row's id and text."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text), 256)), 1, size)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named d0, d1 ..., so that no name of an operator's own can clash with them."""
    return docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> int:
    """The place of a column, with Spark's rule for upper and lower case; an exact match comes first."""
    names = docs.columns
    return names.index(name) if name in names else [x.lower() for x in names].index(name.lower())


def restored(df: DataFrame, docs: DataFrame, results: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``docs`` from those of plain(docs), then the results. A column of ``docs`` named like a result gives way to it."""
    taken = {x.lower() for x in results}
    own = [F.col(f"d{k}").alias(x) for k, x in enumerate(docs.columns) if x.lower() not in taken]
    return df.select(*own, *results)


def with_fields(docs: DataFrame, more: str) -> StructType:
    """The schema of plain(docs) and of further fields."""
    return StructType([*plain(docs).schema.fields, *StructType.fromDDL(more).fields])


def one_thread() -> None:
    """Let numpy's matrix products use one thread in this process: a worker has one core, and small products on several threads only wait for each other."""
    with open("/proc/self/maps") if os.path.exists("/proc/self/maps") else io.StringIO() as maps:
        paths = {line.split(None, 5)[5].strip() for line in maps if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


def keep_memory() -> None:
    """Let this process keep the memory of freed arrays of up to 32 MB for the next ones: glibc raises its limits to the size of a freed block, and then numpy's short-lived arrays no longer cost page faults."""
    np.empty((32 << 20) - 65_536, dtype=np.uint8)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    """Whether crc32 of the id as text falls in the held-out fold; a null id counts as the text ``null``."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % folds == fold


def runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each, so that the arrays made from one range stay small."""
    first = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(BLANKS)] = False
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 20)
        _tables["up"], _tables["down"] = powers(_BASE, size), powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def word_hashes(texts: list[bytes], fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, one after the other, and the number of words of each text.

    A word is a run without ASCII blanks. One pass of prefix sums gives every word's polynomial hash modulo 2**64.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if fold_case:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum(np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts)))
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def gram_hashes(words: np.ndarray, n: int, seed: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """The hash of each run of ``n`` word hashes; the last n-1 positions have none."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(seed | 1) + (words[k : k + len(out)] ^ np.uint64(seed >> 7))
    return mix64(out)


def flat_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ranges [start, start + length), one range after the other."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
