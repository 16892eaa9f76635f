"""Token ids in compressed files: context mixing with an entropy coder (rANS), in independent checksummed blocks.

A file row ("segment") holds whole documents in order: a header, the documents' lengths, a table of the segment's ids with their
frequencies, the mixture's weights, and the ids cut into blocks of ``BLOCK`` ids. Every block starts from an empty memory and carries a CRC-32 of its ids and code words, so that
blocks can be decoded alone (with the segment's table and weights); header, lengths, table, weights and sizes have a CRC-32 together, so any damage is found. Within a segment all blocks
advance together, one id a step, as columns of numpy arrays.

Every id is coded in one step, with the chance that a mixture gives it: order 2 (the last id seen after the two previous ids) and order 1 (after the
previous id) each put a weight on the id that they predict, and order 0, the table's frequencies, has the rest and gives every id of the segment a share. Predictions adapt in each block, and each has a
confidence, the number of times that it was right in a row. The weights are those that fit the segment: for each two confidences, and whether both orders agree, the shares of ids
that order 2 and order 1 alone foretold. Predictions don't depend on the coder, so the encoder finds all of them at once, by sorting each block by context; the decoder goes step by
step. All model arithmetic is in integers, so that any machine decodes alike.

Null text is empty (a document of its end id alone). Documents are ordered by doc_id, nulls first; rows with the same doc_id by
a hash of their text. A very long document is a segment of its own. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, flat_take, materialize

BLOCK = 1024
#: A segment is closed at so many ids, since steps over many blocks cost little more than over few; a longer document has one of its own.
SEGMENT_IDS = 1 << 22
MAGIC, VERSION = b"IDS4", 4
_HEAD, _CRC = struct.Struct("<4sBIIQ"), struct.Struct("<I")
TABLE_BITS = 10
_U = np.uint64

class Frequencies:
    """Order 0: a segment's ids in ascending order, and cumulated frequencies that sum to 2**bits."""

    #: Counts are kept as 8ths of their binary logarithm.
    FINE = 8

    def __init__(self, ids: np.ndarray, logs: np.ndarray):
        self.ids, self.logs = ids, logs
        if len(ids) > 1 << MOST_BITS:
            raise ValueError(f"more than {1 << MOST_BITS} different ids in a segment")
        self.bits = min(MOST_BITS, max(20, int(len(ids)).bit_length() + 3))
        # Sums in integers, in the same order everywhere: the table of powers is rounded once.
        weights = POWERS[logs]
        total, room = max(1, int(weights.sum())), (1 << self.bits) - len(ids)
        share = np.array([int(w) * room // total for w in weights], dtype=np.int64) + 1 if self.bits > 22 else (weights.astype(np.int64) * room // total) + 1
        if len(share):
            share[int(np.argmax(share))] += (1 << self.bits) - int(share.sum())
        self.ends = np.concatenate([[0], np.cumsum(share)]).astype(np.int64)
        # From a place below 2**bits to the id there.
        self.at = np.repeat(np.arange(len(share), dtype=np.uint16 if len(share) <= 1 << 16 else np.int32), share) if self.bits <= 22 else None

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Frequencies, np.ndarray]:
        """The table of these ids, and their places in it."""
        if len(ids) and int(ids.max()) < DENSE:
            counts = np.bincount(ids)
            values = np.flatnonzero(counts)
            place_of = np.zeros(len(counts), dtype=np.int64)
            place_of[values] = np.arange(len(values))
            places, counts = place_of[ids], counts[values]
        else:
            values, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return cls(values.astype(np.uint32), cls.logs_of(counts)), places.reshape(-1).astype(np.int64)

    @classmethod
    def logs_of(cls, counts: np.ndarray) -> np.ndarray:
        """The logarithms of counts that a table keeps; a count of 0 is taken for 1."""
        own = LOGS[np.clip(counts, 1, len(LOGS)) - 1]
        large = counts > len(LOGS)
        own[large] = [min(255, round(cls.FINE * math.log2(c))) for c in counts[large].tolist()]
        return own

    def pack(self) -> bytes:
        data = zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes() + self.logs.tobytes(), 9)
        return struct.pack("<II", len(self.ids), len(data)) + data

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[Frequencies, int]:
        """The table that begins at a place of ``data``, and the place after it."""
        n, size = struct.unpack_from("<II", data, at)
        raw = np.frombuffer(zlib.decompress(data[at + 8 : at + 8 + size]), dtype=np.uint8)
        ids = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1), dtype=np.uint32)
        return cls(ids, raw[4 * n :].copy()), at + 8 + size

    def find(self, place: np.ndarray) -> np.ndarray:
        return self.at.take(place).astype(np.int64) if self.at is not None else np.searchsorted(self.ends, place, side="right") - 1


POWERS = np.array([round(2.0 ** (x / Frequencies.FINE) * 16) for x in range(256)], dtype=object)
LOGS = np.array([min(255, round(Frequencies.FINE * math.log2(c))) for c in range(1, 4097)], dtype=np.uint8)
#: Ids below this are counted in an array.
DENSE = 1 << 22
#: The coder takes chances of 2**31 at most: those of order 0, and 6 bits for its least share.
MOST_BITS = 25

# A memory's slot holds a prediction's place times 8, plus its confidence: 1 to 4, by the times that it was right in a row; an empty one is 0.
SURE = 4
#: The confidence of a place after it was seen, by its slot's difference to the place's empty one: 0 (an empty slot), 1 to 4, and others (another place).
_NEXT = np.array([1, *[min(SURE, c + 1) for c in range(1, SURE + 1)], 1], dtype=np.int32)
#: Pairs of confidences (order 2, order 1), each for orders that differ and that agree.
CELLS = 2 * (SURE + 1) ** 2


def _slot_of(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a block's memories of orders 1 and 2 keep what follows the last ids (places plus 1; 0 before the begin), all of 32 bits."""
    shift = np.uint32(32 - TABLE_BITS)
    return last * np.uint32(0x9E3779B1) >> shift, (last * np.uint32(0x85EBCA6B) ^ before * np.uint32(0xC2B2AE35)) >> shift


def _cells(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return 2 * (SURE + 1) * (two & 7) + 2 * (one & 7) + (one >> 3 == two >> 3)


def _start_weights() -> np.ndarray:
    """Weights without a segment, in 65,536ths: rows of order 1 and order 2, by cell."""
    of1, of2 = (0, 6000, 16000, 28000, 40000), (0, 12000, 30000, 45000, 55000)
    return np.array([[of1[c1] * (65536 - of2[c2]) >> 16 for c2 in range(SURE + 1) for c1 in range(SURE + 1) for _ in range(2)], [of2[c2] for c2 in range(SURE + 1) for _ in range(SURE + 1) for _ in range(2)]], dtype=np.int64)


class _Model:
    """The mixture for ``lanes`` blocks at once, over places in the table."""

    def __init__(self, lanes: int, table: Frequencies, weights: np.ndarray | None = None):
        self.table = table
        self.shift = table.bits + 6  # chances are of 2**shift; order 0 keeps 1/64 at least
        rest = (1 << self.shift) - (1 << table.bits)
        one, two = rest * (_start_weights() if weights is None else weights.astype(np.int64)) >> 16
        # Where both orders agree there is one prediction.
        agree = np.arange(CELLS) % 2 == 1
        self.masses1, self.masses2 = np.where(agree, 0, one), np.where(agree, one + two, two)
        self.after = table.ends[1:]
        self.base = np.arange(lanes, dtype=np.int64) << TABLE_BITS
        self.memory1, self.memory2 = np.zeros(lanes << TABLE_BITS, dtype=np.int32), np.zeros(lanes << TABLE_BITS, dtype=np.int32)
        self.last, self.before = np.zeros((2, lanes), dtype=np.uint32)

    def predict(self) -> None:
        """Sets the predictions and their weights for the next id."""
        at1, at2 = _slot_of(self.last, self.before)
        self.at1, self.at2 = at1 + self.base, at2 + self.base
        self.see(self.memory1.take(self.at1), self.memory2.take(self.at2))

    def see(self, one: np.ndarray, two: np.ndarray) -> None:
        """Predictions from slots; an empty one predicts place 0 with no weight."""
        self.one, self.two = one, two
        cell = _cells(one, two)
        self.guess1, self.guess2 = one >> 3, two >> 3
        self.mass1, self.mass2 = self.masses1.take(cell), self.masses2.take(cell)
        self.mass0 = (1 << self.shift) - self.mass1 - self.mass2

    def interval(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the chance of a place: order 0's share, with the weights of predictions where they are."""
        begin = self.table.ends.take(place) * self.mass0 >> self.table.bits
        size = (self.after.take(place) * self.mass0 >> self.table.bits) - begin
        for guess, mass in ((self.guess1, self.mass1), (self.guess2, self.mass2)):
            begin += mass * (guess < place)
            size += mass * (guess == place)
        return begin, size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The place whose interval holds a value: without the weights of predictions that end before it order 0 tells it, up to the predictions that don't."""
        bits, total = self.table.bits, self.mass1 + self.mass2
        end1 = (self.after.take(self.guess1) * self.mass0 >> bits) + np.where(self.guess2 <= self.guess1, total, self.mass1)
        end2 = (self.after.take(self.guess2) * self.mass0 >> bits) + np.where(self.guess1 <= self.guess2, total, self.mass2)
        past1, past2 = end1 <= value, end2 <= value
        left = ((value - self.mass1 * past1 - self.mass2 * past2 + 1) << bits) - 1
        # Quotients of integers below 2**53 that aren't whole differ from whole ones by more than a double's rounding.
        place = (left / self.mass0).astype(np.int64) if bits + self.shift < 52 else left // self.mass0
        out = self.table.find(np.minimum(place, (1 << bits) - 1))
        return np.minimum(np.minimum(out, np.where(past1, len(self.after), self.guess1)), np.where(past2, len(self.after), self.guess2))

    def update(self, actual: np.ndarray) -> None:
        """``actual`` are places."""
        empty = (actual << 3).astype(np.int32)
        self.memory1[self.at1] = empty + _NEXT.take(np.minimum((self.one - empty).view(np.uint32), SURE + 1))
        self.memory2[self.at2] = empty + _NEXT.take(np.minimum((self.two - empty).view(np.uint32), SURE + 1))
        self.before, self.last = self.last, (actual + 1).astype(np.uint32)


def _seen(places: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each id of blocks (lanes, BLOCK) what its slot holds before it, as _Model.update() fills it: ids are sorted by slot and time, so that a slot's last id is the one before."""
    keys = slots << np.uint32(10)
    keys += np.arange(BLOCK, dtype=np.uint32)
    keys.sort(axis=1)
    at = (keys & (BLOCK - 1)).astype(np.int64)
    at += np.arange(len(places), dtype=np.int64)[:, None] * BLOCK
    actual = places.reshape(-1).take(at).astype(np.int32)
    same = np.zeros(places.shape, dtype=bool)
    same[:, 1:] = keys[:, 1:] >> 10 == keys[:, :-1] >> 10
    right = np.zeros(places.shape, dtype=bool)  # the slot's id came again
    right[:, 1:] = same[:, 1:] & (actual[:, 1:] == actual[:, :-1])
    sure, run = same.astype(np.int32), same
    for k in range(1, SURE):
        # A slot's first id is never right, so a run doesn't leave its slot.
        longer = np.zeros(places.shape, dtype=bool)
        longer[:, k:] = run[:, k:] & right[:, :-k]
        sure += longer
        run = longer
    held = np.zeros(places.shape, dtype=np.int32)
    held[:, 1:] = actual[:, :-1] << 3
    out = np.empty(places.size, dtype=np.int32)
    out[at.reshape(-1)] = np.where(same, held + sure, 0).reshape(-1)
    return out.reshape(places.shape)


def _lanes(n: int) -> tuple[int, int]:
    """Number of blocks, and the length of the last."""
    lanes = -(-n // BLOCK)
    return lanes, n - (lanes - 1) * BLOCK


#: A lane's state is from 2**31 to below 2**63; code words have 32 bits.
_LEAST, _32 = _U(1 << 31), _U(32)


#: Blocks whose predictions are found at once: few enough that their arrays stay in a core's cache.
AT_ONCE = 32


def _predictions(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of orders 1 and 2 that each id of blocks (lanes, BLOCK) meets."""
    last, before = np.zeros((2, *places.shape), dtype=np.uint32)
    last[:, 1:], before[:, 2:] = places[:, :-1] + 1, places[:, :-2] + 1
    one, two = _slot_of(last, before)
    return _seen(places, one), _seen(places, two)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes]:
    """A segment's blocks: number of ids, the table, the weights, per block its CRC-32 (of ids and code words) and its size; and the code words."""
    n = len(ids)
    if n == 0:
        return struct.pack("<I", 0), b""
    table, places = Frequencies.of(ids)
    lanes, short = _lanes(n)
    padded = np.zeros(lanes * BLOCK, dtype=np.int64)
    padded[:n] = places
    padded = padded.reshape(lanes, BLOCK)
    one, two = np.empty((2, lanes, BLOCK), dtype=np.int32)
    met, right1, right2 = np.zeros((3, CELLS), dtype=np.int64)
    foretold = np.zeros(lanes * BLOCK, dtype=bool)
    for k in range(0, lanes, AT_ONCE):
        some = slice(k, k + AT_ONCE)
        one[some], two[some] = _predictions(padded[some])
        real = slice(0, min(n, (k + AT_ONCE) * BLOCK) - k * BLOCK)
        a, b, actual = (x[some].reshape(-1)[real] for x in (one, two, padded))
        hit2 = (b >> 3 == actual) & (b > 0)
        hit1 = (a >> 3 == actual) & (a > 0) & ~hit2
        cell = _cells(a, b)
        met += np.bincount(cell, minlength=CELLS)
        right1 += np.bincount(cell[hit1], minlength=CELLS)
        right2 += np.bincount(cell[hit2], minlength=CELLS)
        foretold[k * BLOCK :][real] = hit1 | hit2
    weights = np.minimum(65535, np.stack([right1, right2]) * 65536 // np.maximum(1, met)).astype("<u2")
    # Order 0 is left with the ids that no order foretold.
    table = Frequencies(table.ids, table.logs_of(np.bincount(places[~foretold[:n]], minlength=len(table.ids))))
    model = _Model(0, table, weights)
    begins, sizes = np.empty((2, BLOCK, lanes), dtype=np.uint32)
    for k in range(0, lanes, AT_ONCE):
        some = slice(k, k + AT_ONCE)
        model.see(one[some], two[some])
        begin, size = model.interval(padded[some])
        begins[:, some], sizes[:, some] = begin.T, size.T
    del one, two, padded, places
    # The coder (rANS) begins at the last id, so that the decoder begins at the first; the words are turned round.
    out = np.zeros((lanes, BLOCK + 2), dtype="<u4")
    used = np.zeros(lanes, dtype=np.int64)
    every, shift, room = np.arange(lanes), _U(model.shift), _U(63 - model.shift)
    state = np.full(lanes, _LEAST)
    for t in range(BLOCK - 1, -1, -1):
        on = lanes - (t >= short)
        if not on:
            continue
        size, own = sizes[t, :on].astype(_U), state[:on]
        full = np.flatnonzero(own >= size << room)
        out[full, used[full]] = own[full]  # the lower 32 bits
        used[full] += 1
        own[full] >>= _32
        parts = own // size
        own -= parts * size
        own += (parts << shift) + begins[t, :on]
    for _ in range(2):
        out[every, used] = state
        used += 1
        state >>= _32
    raw = ids.astype("<u4")
    words = [out[i, : used[i]][::-1].tobytes() for i in range(lanes)]
    crcs = np.array([zlib.crc32(w, zlib.crc32(raw[i * BLOCK : (i + 1) * BLOCK].tobytes())) for i, w in enumerate(words)], dtype="<u4")
    return struct.pack("<I", n) + table.pack() + weights.tobytes() + crcs.tobytes() + used.astype("<u4").tobytes(), b"".join(words)


def decode_ids(data: bytes, code: bytes) -> np.ndarray:
    """The ids of encode_ids; raises ValueError where a block's checksum doesn't hold. The first part has to be whole (see unpack_segment())."""
    (n,) = struct.unpack_from("<I", data)
    if n == 0:
        if code:
            raise ValueError("code words without ids")
        return np.zeros(0, dtype=np.uint32)
    table, at = Frequencies.unpack(data, 4)
    weights = np.frombuffer(data, "<u2", 2 * CELLS, at).reshape(2, CELLS)
    at += 4 * CELLS
    lanes, short = _lanes(n)
    crcs = np.frombuffer(data, "<u4", lanes, at)
    sizes = np.frombuffer(data, "<u4", lanes, at + 4 * lanes).astype(np.int64)
    if len(code) != 4 * int(sizes.sum()):
        raise ValueError("the code words aren't as long as their sizes say")
    cuts = 4 * np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate([np.frombuffer(code, "<u4"), np.zeros(2, dtype="<u4")]).astype(_U)
    last_word = len(words) - 1
    place = np.cumsum(sizes) - sizes
    state = words[place] << _32 | words[place + 1]
    place += 2
    model = _Model(lanes, table, weights)
    most, shift = _U((1 << model.shift) - 1), _U(model.shift)
    out = np.zeros((BLOCK, lanes), dtype=np.int64)
    on = lanes
    for t in range(BLOCK):
        if t == short:
            on -= 1
            if not on:
                break
        model.predict()
        value = (state & most).view(np.int64)
        actual = model.find(value)
        begin, size = model.interval(actual)
        state = size.view(_U) * (state >> shift) + (value - begin).view(_U)
        low = np.flatnonzero(state < _LEAST)
        state[low] = state[low] << _32 | words[np.minimum(place[low], last_word)]
        place[low] += 1
        out[t] = actual
        model.update(actual)
    ids = table.ids[out.T.reshape(-1)[:n]].astype("<u4")
    for i in range(lanes):
        if zlib.crc32(memoryview(code)[cuts[i] : cuts[i + 1]], zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes())) != crcs[i]:
            raise ValueError(f"block {i}: the checksum doesn't hold")
    return ids


def pack_segment(documents: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in documents], dtype="<u8")
    about, code = encode_ids(np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint32))
    about = lengths.tobytes() + about
    head = _HEAD.pack(MAGIC, VERSION, BLOCK, len(documents), len(about))
    return head + _CRC.pack(zlib.crc32(about, zlib.crc32(head))) + about + code


def unpack_segment(data: bytes) -> list[np.ndarray]:
    """The documents of a segment. Any damage raises ValueError: the head, the lengths, the table and the blocks' sizes have one checksum, every block has its own."""
    if len(data) < _HEAD.size + _CRC.size:
        raise ValueError("not a segment of this format")
    head, (crc,) = data[: _HEAD.size], _CRC.unpack_from(data, _HEAD.size)
    magic, version, block, n, size = _HEAD.unpack(head)
    at = _HEAD.size + _CRC.size
    about = data[at : at + size]
    if (magic, version, block) != (MAGIC, VERSION, BLOCK) or zlib.crc32(about, zlib.crc32(head)) != crc:
        raise ValueError("not a segment of this format, or its head is damaged")
    lengths = np.frombuffer(about, "<u8", n).astype(np.int64)
    ids = decode_ids(about[8 * n :], data[at + size :])
    return np.split(ids, np.cumsum(lengths)[:-1]) if n else []


class _Places(dict):
    """Places of parts in a cache; a part that is looked up for the first time gets the next one."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        self.fresh.append(part)
        self[part] = place = len(self)
        return place


class ChunkEncoder:
    """Ids of whole texts from a cache of their white-space parts, which no token of these vocabularies crosses."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place = _Places()
        self.pool, self.sizes, self.starts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.n_ids = 0

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        ids, sizes, counts = self.by_word(texts)
        totals = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.cumsum(counts)
        return ids, totals[bounds] - totals[bounds - counts]

    def by_word(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each part, and the number of parts of each text."""
        at, counts = self.places(texts)
        sizes = self.sizes[at]
        return self.pool[flat_take(self.starts[at], sizes)], sizes, counts

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place in the cache of each part, and the number of parts of each text."""
        if len(self.place) > self.most:
            self._clear()
        split = [x.split() for x in texts]
        counts = np.array([len(x) for x in split], dtype=np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        if self.place.fresh:
            self._learn(self.place.fresh)
            self.place.fresh.clear()
        return at, counts

    def _ids_of(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these parts, and the number of ids of each."""
        ids = self.encode([w.decode() for w in fresh])
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _learn(self, fresh: list[bytes]) -> None:
        ids, sizes = self._ids_of(fresh)
        known, n_ids = len(self.place) - len(fresh), self.n_ids + len(ids)
        # Room is doubled, so that all copies together are linear.
        self.pool = _with_room(self.pool, n_ids)
        self.sizes, self.starts = _with_room(self.sizes, len(self.place)), _with_room(self.starts, len(self.place))
        self.pool[self.n_ids : n_ids] = ids
        self.sizes[known : len(self.place)] = sizes
        self.starts[known : len(self.place)] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids = n_ids


def _with_room(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) >= n:
        return x
    out = np.zeros(max(n, 2 * len(x)), dtype=x.dtype)
    out[: len(x)] = x
    return out


#: The tokenizer's settings under which SimpleWords holds, in its file's words.
_NORMALIZED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Classes of Latin-1 characters: those that other words hold, letters, digits, other printable ASCII characters, and ends of parts.
_OTHER, _LETTER, _DIGIT, _SIGN, _LINE = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
for _first, _last, _kind in ((0x30, 0x39, _DIGIT), (0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0xC0, 0xD6, _LETTER), (0xD8, 0xF6, _LETTER), (0xF8, 0xFF, _LETTER)):
    _CLASS[_first : _last + 1] = _kind
# An apostrophe may begin a word of its own ('s), and added tokens begin with the other.
_CLASS[[ord("'"), ord("<")]] = _OTHER
_CLASS[ord("\n")] = _LINE


class SimpleWords:
    """Ids of parts of plain Latin letters, digits and signs, for a BPE vocabulary whose file says that it lower-cases, splits runs of letters, digits and runs of other signs, and ends each with ``</w>``.

    Such parts are cut, lower-cased and spelled in bytes here, many at once, and go to the library's BPE without its normalizer and splitter, which take most of its time; the results are the same.
    """

    def __init__(self, settings: dict):
        from tokenizers import Tokenizer, pre_tokenizers

        vocabulary = settings["model"]["vocab"]
        self.tokenizer = Tokenizer.from_str(json.dumps(settings | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def fit(settings: dict) -> bool:
        """Whether a tokenizer's file is of this kind."""
        model = settings["model"]
        plain = all(settings.get(name) is None for name in ("truncation", "padding", "post_processor")) and settings["normalizer"] == _NORMALIZED and settings["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        bpe = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        return plain and bpe and all(t["content"].startswith("<") for t in settings["added_tokens"])

    def simple(self, parts: list[bytes]) -> tuple[np.ndarray, str]:
        """Which parts are simple, and these as Latin-1 text, a line each."""
        text = b"\n".join(parts).decode()
        try:
            data = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            data = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8).copy()
            # Characters beyond Latin-1 have become question marks.
            data[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) > 255] = 0
        kinds = _CLASS.take(data)
        line = np.concatenate([[0], np.cumsum(kinds == _LINE)])[:-1]
        good = np.ones(len(parts), dtype=bool)
        good[line[kinds == _OTHER]] = False
        keep = good[line]
        return good, data[keep].tobytes().decode("latin-1")

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the parts (a line each, with or without an end of the last), and the number of ids of each."""
        data = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        kinds = _CLASS.take(data)
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)) & (kinds[1:] != _LINE) & (kinds[:-1] != _LINE)
        words = np.diff(np.concatenate([[0], np.cumsum(cut)[kinds == _LINE], [int(cut.sum())]])) + 1
        spaced = np.insert(data, np.flatnonzero(cut), 32).tobytes().decode("latin-1").lower()
        # The alphabet of byte-level vocabularies: of the bytes that these letters have only three aren't characters themselves.
        spelled = spaced.encode().decode("latin-1").replace("\xa0", "\u0142").replace("\xad", "\u0143").replace("\x9f", "\u0141")
        ids = np.array(self.tokenizer.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype=np.uint32)
        last = np.flatnonzero(self.ends.take(ids))[np.cumsum(words) - 1]
        return ids, np.diff(last, prepend=-1)


class VocabularyChunks(ChunkEncoder):
    """Parts that SimpleWords takes go there, others to the whole tokenizer."""

    TOGETHER = 4096

    def __init__(self, path: str, most: int):
        super().__init__(vocabulary_encoder(path), most)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.words = SimpleWords(settings) if SimpleWords.fit(settings) else None

    def _ids_of(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.words is None:
            return super()._ids_of(fresh)
        found = [self._some(fresh[k : k + self.TOGETHER]) for k in range(0, len(fresh), self.TOGETHER)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _some(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        good, text = self.words.simple(parts)
        if not good.any():
            return super()._ids_of(parts)
        # The end of the last simple line goes, where another follows.
        ids, own = self.words(text.removesuffix("\n"))
        if good.all():
            return ids, own
        others, more = super()._ids_of([w for w, x in zip(parts, good.tolist(), strict=True) if not x])
        sizes = np.empty(len(parts), dtype=np.int64)
        sizes[good], sizes[~good] = own, more
        starts = np.cumsum(sizes) - sizes
        out = np.empty(len(ids) + len(others), dtype=np.uint32)
        out[flat_take(starts[good], own)], out[flat_take(starts[~good], more)] = ids, others
        return out, sizes


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str, most: int = 1_200_000) -> ChunkEncoder:
    """The encoder of this process for a tokenizer's file, with a cache of about ``most`` parts (some 200 bytes each): tasks that follow each other in a worker share it, and it never changes a result."""
    if path not in _encoders:
        _encoders[path] = VocabularyChunks(path, most)
    _encoders[path].most = most
    return _encoders[path]


def vocabulary_encoder(path: str, together: int = 1000) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each text. Many are encoded in one call, parted by a special token that ends every part of the tokenizer's work; texts that hold it are encoded alone."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = sorted((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
    if not special:
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    mark_id, mark = special[0]

    def encode(texts: list[str]) -> list[list[int]]:
        plain = [k for k, x in enumerate(texts) if mark not in x]
        out: list[list[int]] = [[] for _ in texts]
        for k in range(0, len(plain), together):
            some = plain[k : k + together]
            own: list[int] = []
            places = iter(some)
            for i in tokenizer.encode_batch_fast([mark.join(texts[j] for j in some)], add_special_tokens=False)[0].ids:
                if i == mark_id:
                    out[next(places)] = own
                    own = []
                else:
                    own.append(i)
            out[next(places)] = own
        for k in set(range(len(texts))) - set(plain):
            out[k] = tokenizer.encode(texts[k], add_special_tokens=False).ids
        return out

    return encode


SEGMENT = "part int, first bigint, n_ids bigint, ids array<bigint>, segment binary"


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` in ascending doc_id order as segments in the shared folder, and return the written table.

    Rows: part (files in order), first (ids of the part before the segment), n_ids, ids (the doc_ids) and the segment itself.
    """
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first = TaskContext.get().partitionId(), 0
        encoder = chunk_encoder(tokenizer_path)
        names: list = []
        waiting: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal names, waiting, size, first
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([pack_segment(waiting)], pa.binary())], names=["part", "first", "n_ids", "ids", "segment"])
            first, names, waiting, size = first + size, [], [], 0
            return row

        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts, doc_ids = as_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for k in range(0, len(texts), 1024):
                ids, counts = encoder(texts[k : k + 1024])
                for doc_id, own in zip(doc_ids[k : k + 1024], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    if size and size + len(own) >= SEGMENT_IDS:
                        yield close()
                    names.append(doc_id)
                    waiting.append(np.concatenate([own, end]))
                    size += len(own) + 1
        if names:
            yield close()

    return materialize(ordered.mapInArrow(work, SEGMENT), "ids")


def read(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids."""
    spark: SparkSession = segments.sparkSession
    # One row for each written part, as many as there are files.
    parts = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(parts):
        before[part], total = total, total + parts[part]
    shared = spark.sparkContext.broadcast(before)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                documents = unpack_segment(batch.column("segment")[row].as_py())
                sizes = np.array([len(x) for x in documents], dtype=np.int64)
                first = shared.value[batch.column("part")[row].as_py()] + batch.column("first")[row].as_py()
                columns = [
                    pa.array(batch.column("ids")[row].as_py(), pa.int64()),
                    pa.array(first + np.cumsum(sizes) - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in documents], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in documents], pa.list_(pa.int64())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", token_ids array<bigint>" if with_ids else "")
    return segments.mapInArrow(work, kind)
