"""Secret scans: fixed patterns, and strings that compress badly against their surroundings.

The base finds assignments to secret names, access key ids and long hexadecimal strings. The method looks at every other run of
key characters, each once, that a sensitive word announces: one that begins at most ``near`` characters before the run, or in it (the
value is then what follows the last such word, where that is long enough). Values of ``min_length`` or more characters are compressed by zstandard with a
dictionary of the surrounding text and of common identifiers; what the value adds to the compressed size, in bytes per
character, is its novelty. Values at ``min_novelty`` or more are reported as ``novel``, if they mix character kinds as keys do.

Offsets are code points, ends exclusive; spans of the method overlap neither each other nor base ones. Null text is empty. Repeated rows are reported
alike, very long texts are scanned whole in one pass, and an empty table gives an empty result. Extra columns of ``docs`` pass
through: redact() returns them all, and in scan() one that is named like a result gives way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_text, bound_batches, place, plain, restored, with_fields

# The base patterns.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Words that announce a secret.
SENSITIVE = re.compile(r"(?i)\b(?:api|auth|bearer|client|credentials?|key|passphrase|passwd|password|private|pwd|secret|signature|token)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # at least as short as any min_length
JOINTS = "+/_=-"
# Identifiers that are common in code and settings.
IDENTIFIERS = (
    "access_key accessToken api_key apiKey authorization auth_token bearer client_id client_secret config connection_string "
    "credentials database_url default environment example false function getenv header host http https import localhost "
    "none null password placeholder private_key production public_key return secret_key session signature string test token true user username value "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"
)
KINDS = ["assign", "access", "hex"]


@dataclass(frozen=True)
class Limits:
    context: int = 256  # characters of surroundings, on either side
    near: int = 48  # a sensitive word begins at most so many characters before the run
    min_length: int = 16  # 16 at least
    min_novelty: float = 0.9  # added compressed bytes per character
    min_distinct: int = 8  # different characters


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs of hexadecimal digits are maximal, so the long ones alone are those that the plain pattern keeps.
    found += [(m.start(), m.end(), 2) for m in HEX_LONG.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _looks_like_key(value: str, limits: Limits) -> bool:
    kinds = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)))
    return kinds >= 2 and any(c.isdigit() for c in value) and len(set(value)) >= limits.min_distinct


def novelty(value: str, before: str, after: str) -> float:
    """Bytes that ``value`` adds to a frame primed with its surroundings and the identifiers, per character."""
    primed = zstandard.ZstdCompressionDict(f"{IDENTIFIERS} {after} {before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(coder.compress(value.encode())) - len(coder.compress(b""))) / max(1, len(value))


def value_of(text: str, a: int, b: int, words: list[tuple[int, int]], limits: Limits) -> tuple[int, int] | None:
    """The value in the run [a, b), given all sensitive words (start, end) of the text in order; None where none announces it."""
    k = bisect_left(words, (b, 0)) - 1  # the last that begins before the run's end
    if k < 0 or words[k][0] < a - limits.near:
        return None
    if words[k][0] >= a:
        start = words[k][1]
        while start < b and text[start] in JOINTS:
            start += 1
        if b - start >= limits.min_length:
            return start, b
    return (a, b) if b - a >= limits.min_length else None


def novel_spans(text: str, taken: list[tuple[int, int, str]], limits: Limits = Limits()) -> list[tuple[int, int, str]]:
    """Spans that the method adds: announced values, outside the spans taken, that their surroundings don't predict."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    found, taken, around = [], sorted(taken), limits.context
    reach, at = 0, 0  # the farthest end of the taken spans that begin before the run's end
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if (span := value_of(text, m.start(), m.end(), words, limits)) is None or reach > span[0]:
            continue
        a, b = span
        value = text[a:b]
        if _looks_like_key(value, limits) and novelty(value, text[max(0, a - around) : a], text[b : b + around]) >= limits.min_novelty:
            found.append((a, b, "novel"))
    return found


def scan_text(text: str, limits: Limits = Limits()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    return base, novel_spans(text, base, limits)


RESULTS = ("base", "added")
RESULT_TYPES = "base array<struct<start:bigint,stop:bigint,kind:string>>, added array<struct<start:bigint,stop:bigint,kind:string>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def scan(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Columns of ``docs`` and base, added: arrays of (start, stop, kind)."""
    bound_batches(docs.sparkSession)
    at = place(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(x, limits) for x in as_text(batch.column(at))]
            columns = [pa.array([[dict(zip(("start", "stop", "kind"), s, strict=True)) for s in x[k]] for x in found], SPANS) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *RESULTS])

    return restored(plain(docs).mapInArrow(work, with_fields(docs, RESULT_TYPES)), docs, RESULTS)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    order = F.array(*[F.lit(k) for k in [*KINDS, "novel"]])
    ranked = F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    counts = [F.size(F.filter("base", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(ranked)).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == F.lit(kind)


def redact(docs: DataFrame, limits: Limits = Limits(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; null texts stay null."""
    bound_batches(docs.sparkSession)
    at = place(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, added = scan_text(text, limits)
                    pieces, last = [], 0
                    for a, b, _ in sorted(base + added):
                        if b <= last:
                            continue
                        pieces += [text[last:a], mark] if a >= last else []
                        last = b
                    text = "".join([*pieces, text[last:]])
                texts.append(text)
            yield batch.set_column(at, f"d{at}", pa.array(texts, pa.string()))

    return restored(plain(docs).mapInArrow(work, plain(docs).schema), docs)


def reference_spans(text: str, limits: Limits = Limits()) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The plain definitions, for tests: base and added spans of one text."""
    base = []
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                base.append((m.start(), m.end(), kind))
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    keys = [c.isascii() and (c.isalnum() or c in JOINTS) for c in text]
    words = [m.span() for m in SENSITIVE.finditer(text)]
    added = []
    for a in range(len(text)):
        if not keys[a] or a and keys[a - 1]:
            continue
        b = next((k for k in range(a, len(text)) if not keys[k]), len(text))
        near = [w for w in words if a - limits.near <= w[0] < b]
        if b - a < limits.min_length or not near:
            continue
        inner = [w[1] + len(text[w[1] : b]) - len(text[w[1] : b].lstrip(JOINTS)) for w in near if w[0] >= a][-1:]
        start = inner[0] if inner and b - inner[0] >= limits.min_length else a
        free = not any(start < y and x < b for x, y, _ in base)
        if free and _looks_like_key(text[start:b], limits) and novelty(text[start:b], text[max(0, start - limits.context) : start], text[b : b + limits.context]) >= limits.min_novelty:
            added.append((start, b, "novel"))
    return base, added
