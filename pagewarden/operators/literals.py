"""Which of very many literals are in which texts: places of texts are looked up in sorted keys of literals, 8 bytes at most, and whole literals are compared there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of whole texts that are matched at once, pairs that are compared at once, and those of one text and key from which on literals are looked for one by one.
RANGE, PAIRS, MANY_PAIRS = 1 << 20, 1 << 20, 1 << 16
#: Words of a literal that are compared in step with others'.
STEPS = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, but for the last 7 places."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def _offsets(values: pa.Array) -> np.ndarray:
    """Where the values of a binary column begin and end in its buffer."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, with 8 zeros behind them, and where its values begin and end."""
    offsets, buffer = _offsets(values), values.buffers()[2]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, dtype=np.uint8)
    if buffer is not None:
        data[:-8] = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _MULTIPLIER) >> np.uint64(64 - bits)).view(np.int64)


class Keys:
    """Sorted keys with the literals of each, behind a table of bits that tells most other keys."""

    def __init__(self, keys: np.ndarray, literals: np.ndarray, size: int):
        order = np.argsort(keys, kind="stable")
        self.mask = np.uint64((1 << 8 * size) - 1)
        self.keys, first = np.unique(keys[order], return_index=True)
        self.literals, self.starts = literals[order].astype(np.int32), np.append(first, len(keys)).astype(np.int32)
        self.bits = max(16, (32 * len(self.keys)).bit_length())
        slots = np.sort(_slot(self.keys, self.bits))
        step = 1 << min(self.bits, 22)
        bounds = np.searchsorted(slots, np.arange(0, (1 << self.bits) + 1, step))
        self.table = np.zeros((1 << self.bits) // 8, dtype=np.uint8)
        for k in range(len(bounds) - 1):
            there = np.zeros(step, dtype=bool)
            there[slots[bounds[k] : bounds[k + 1]] - k * step] = True
            self.table[k * step // 8 : (k + 1) * step // 8] = np.packbits(there, bitorder="little")

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``words`` that begin with a key, and the key's number."""
        words = words & self.mask
        slot = _slot(words, self.bits)
        place = np.flatnonzero((self.table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        words = words[place]
        key = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        same = self.keys[key] == words
        return place[same], key[same]


class Index:
    """Different literals (a binary column without nulls and empty values). One of less than 8 bytes is its own key. A longer one is met at the run of 8 of its bytes that the fewest literals have."""

    def __init__(self, values: pa.Array):
        self.values = values
        self.data, offsets = _parts(values)
        self.starts, self.sizes = offsets[:-1], np.diff(offsets)
        words = _words(self.data)
        self.short = []
        for size in range(1, 8):
            these = np.flatnonzero(self.sizes == size)
            if len(these):
                self.short.append(Keys(words[self.starts[these]] & np.uint64((1 << 8 * size) - 1), these, size))
        self.shift = np.zeros(len(values), dtype=np.int32)
        long = np.flatnonzero(self.sizes >= 8)
        bits = min(22, int((self.sizes[long] - 7).sum()).bit_length() + 2)  # runs share counters where there are many: that costs time only
        counts = np.zeros(1 << bits, dtype=np.int64)
        for these, places, _ in self._runs(long):
            counts += np.bincount(_slot(words[places], bits), minlength=len(counts))
        for these, places, first in self._runs(long):
            n = counts[_slot(words[places], bits)]
            # The last one of the fewest: ends tell more than beginnings.
            rank = n * (1 << 32) - (places - np.repeat(self.starts[these], np.diff(np.append(first, len(places)))))
            self.shift[these] = -(np.minimum.reduceat(rank, first)) % (1 << 32)
        self.long = Keys(words[self.starts[long] + self.shift[long]], long, 8) if len(long) else None

    def _runs(self, long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some literals at a time: their numbers, the places of all their runs of 8 bytes, and where each one's begin."""
        n = self.sizes[long] - 7
        part = np.cumsum(n) // RANGE
        for these, each in zip(np.split(long, np.flatnonzero(np.diff(part)) + 1), np.split(n, np.flatnonzero(np.diff(part)) + 1), strict=True):
            if len(these):
                yield these, _ranges(self.starts[these], each), np.cumsum(each) - each

    def literal(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.starts[k] + self.sizes[k]].tobytes()

    def match(self, data: np.ndarray, offsets: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts and literals of all that the texts data[offsets[k] : offsets[k + 1]] contain, each pair once, in order. ``data`` has 8 more bytes; ``piece`` places are looked up at once."""
        n, words = len(self.values), _words(data)
        kept, found, size = np.zeros(0, dtype=np.int64), [], 0
        searched: set[tuple[int, int]] = set()
        for a in range(0, int(offsets[-1]), piece):
            here = words[a : min(a + piece, int(offsets[-1]))].copy()
            for keys in self.short:
                place, key = keys.found(here)
                literal = keys.literals[key].astype(np.int64)
                text = np.searchsorted(offsets, place + a, side="right") - 1
                whole = place + a + self.sizes[literal] <= offsets[text + 1]
                found.append(text[whole] * n + literal[whole])
                size += len(text)
            if self.long:
                more = self._long(data, words, offsets, *self._fewer(data, offsets, a, here, searched, found))
                found += more
                size += sum(map(len, more))
            if size > max(1 << 22, len(kept)):
                kept, found, size = np.unique(np.concatenate([kept, *found])), [], 0
        code = np.unique(np.concatenate([kept, *found]))
        return code // n, code % n

    def _fewer(self, data: np.ndarray, offsets: np.ndarray, a: int, here: np.ndarray, searched: set[tuple[int, int]], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, keys and texts to compare. Where a key that many literals have is in a text very often, each literal is looked for in the text instead, once."""
        place, key = self.long.found(here)
        place = place + a
        text = np.searchsorted(offsets, place, side="right") - 1
        each = self.long.starts[key + 1] - self.long.starts[key]
        if len(each) and int(each.sum()) > MANY_PAIRS:
            pair, back, n = np.unique(text * len(self.long.keys) + key, return_inverse=True, return_counts=True)
            often = n * np.diff(self.long.starts)[pair % len(self.long.keys)] > MANY_PAIRS
            for t, k in zip(*(x.tolist() for x in divmod(pair[often], len(self.long.keys))), strict=True):
                if (t, k) not in searched:
                    searched.add((t, k))
                    whole = data[offsets[t] : offsets[t + 1]].tobytes()
                    some = self.long.literals[self.long.starts[k] : self.long.starts[k + 1]].tolist()
                    found.append(np.array([t * len(self.values) + x for x in some if self.literal(x) in whole], dtype=np.int64))
            rest = ~often[back.reshape(-1)]
            place, key, text = place[rest], key[rest], text[rest]
        return place, key, text

    def _long(self, data: np.ndarray, words: np.ndarray, offsets: np.ndarray, place: np.ndarray, key: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """The literals that stand around places with their keys."""
        own, out = _words(self.data), []
        first, each = self.long.starts[key].astype(np.int64), np.diff(self.long.starts)[key].astype(np.int64)
        part = np.cumsum(each) // PAIRS
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            literal = self.long.literals[_ranges(first[i:j], each[i:j])].astype(np.int64)
            begin, t = np.repeat(place[i:j], each[i:j]) - self.shift[literal], np.repeat(text[i:j], each[i:j])
            size = self.sizes[literal]
            keep = (begin >= offsets[t]) & (begin + size <= offsets[t + 1])
            literal, begin, t, size = literal[keep], begin[keep], t[keep], size[keep]
            for step in range(0, 8 * STEPS, 8):
                # Each literal's next word, or the last one.
                at = np.minimum(step, size - 8)
                same = words[begin + at] == own[self.starts[literal] + at]
                done = same & (at == size - 8)
                out.append(t[done] * len(self.values) + literal[done])
                same &= ~done
                literal, begin, t, size = literal[same], begin[same], t[same], size[same]
                if not len(literal):
                    break
            for x, b, k, s in zip(literal.tolist(), begin.tolist(), t.tolist(), size.tolist(), strict=True):
                if data[b : b + s].tobytes() == self.literal(x):
                    out.append(np.array([k * len(self.values) + x], dtype=np.int64))
        return out


def contained(batch: pa.RecordBatch, index: Index, piece: int) -> Iterator[pa.RecordBatch]:
    """path and literals of the texts (path, value) that contain some, for some texts at a time."""
    offsets = _offsets(batch.column("value"))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RANGE, side="right")) - 1)
        last = min(last, batch.num_rows)
        data, own = _parts(batch.column("value").slice(first, last - first))
        text, literal = index.match(data, own, piece)
        there, begin = np.unique(text, return_index=True)
        if len(there):
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(text)).astype(np.int32)), index.values.take(pa.array(literal)))
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(first + there)), lists], names=["path", "literals"])
        first = last
