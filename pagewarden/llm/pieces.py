"""SentencePiece encoding by a batched Viterbi search, and decoding.

The vocabulary comes from a model file of the sentencepiece library (its pieces, scores and byte pieces); the segmentation with
the largest sum of scores is found here. Spaces become the mark U+2581, one more mark goes before the text, and the text is cut before
each run of marks: no piece has a mark after another character, so the best path of the whole is the best paths of its
parts. Parts are looked up in a cache; new ones of one length advance together: prefix hashes give
the hash of every substring, a binary search in the sorted hashes of the pieces finds those that are pieces (compared in full), and a maximum over
the lengths stores scores and backpointers for all parts at once. A character that is no piece costs the least score less 10 and is
written as its UTF-8 bytes' pieces.

Scores: Viterbi needs log chances. A unigram model's scores are such and are taken as they are. A BPE model's are merge ranks, whose
largest sum would split words into their earliest merges; they become log chances by Zipf's law, -ln(rank + offset) less its normaliser.
No such score gives BPE's merges in every word: on the documents of the 0.01 tables 84.1 % of the words as they occur get the ids
that the library gives (54.5 % with the ranks themselves), in 1.5 % fewer ids.

Of segmentations with equal sums the one whose last piece is shortest is taken, and so on backwards.

Null text is empty and has no ids. Very long parts without spaces are searched one by one, over the pieces found
alone, in time that grows with their length. Lone surrogates cannot occur in Spark strings. Repeated rows are encoded alike, and an empty
table gives an empty result. Extra columns pass through; one that is named like a result gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewarden.llm.common import as_text, bound_batches, flat_take, place, plain, powers, restored, with_fields

MARK = "▁"
_BASE = 0x9E3779B97F4A7C15
#: A part is searched with others of its length up to so many characters.
LONG = 256
_UP, _DOWN = powers(_BASE, LONG + 64), powers(pow(_BASE, -1, 1 << 64), LONG + 64)
#: Texts that are encoded together: their new parts are searched at once, so this bounds a worker's memory.
TOGETHER = 256
#: Bits of a hash that a table of the pieces' hashes is asked for before the binary search.
TABLE = 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def zipf(scores: list[float], offset: float) -> list[float]:
    """Log chances by rank, for a BPE model's scores 0, -1, -2 ...; other scores as they are, and the lowest mark of pieces that stand outside the ranks."""
    ranks = sorted({-s for s in scores if s > -1e6})
    if len(ranks) < 0.9 * len(scores) or any(r != int(r) for r in ranks) or ranks[-1] > 1.1 * len(scores):
        return scores
    total = float(np.log((1.0 / (np.array(ranks) + offset)).sum()))
    return [float(-np.log(offset - s) - total) if s > -1e6 else s for s in scores]


class Pieces:
    """Pieces with scores, searchable by hash, and the bytes that each id stands for."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], control: set[int], unknown_id: int = 0):
        self.unknown_id, self.byte_ids = unknown_id, byte_ids
        special = control | set(byte_ids.values())
        plain = [(p, s, i) for i, (p, s) in enumerate(zip(pieces, scores, strict=True)) if p and i not in special]
        if bad := [p for p, s, _ in plain if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces with an inner mark: {bad[:3]}")
        self.score_of = {p: s for p, s, _ in plain}
        self.longest = max((len(p) for p, _, _ in plain), default=1)
        self.letters = np.zeros((len(plain), self.longest), dtype=np.uint32)
        for k, (p, _, _) in enumerate(plain):
            self.letters[k, : len(p)] = _points(p)
        hashes = np.array([self._hash(p) for p, _, _ in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.letters = hashes[order], self.letters[order]
        self.table = np.zeros(1 << TABLE, dtype=bool)
        self.table[self.keys >> np.uint64(64 - TABLE)] = True
        self.scores = np.array([s for _, s, _ in plain])[order]
        self.ids = np.array([i for _, _, i in plain], dtype=np.int64)[order]
        self.unknown_score = (self.scores.min() if len(plain) else 0.0) - 10.0
        spelled = [b"" if i in control else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for byte, i in byte_ids.items():
            spelled[i] = bytes([byte])
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def _hash(piece: str) -> int:
        return int(sum((int(c) + 1) * int(_UP[k]) for k, c in enumerate(_points(piece))) & (1 << 64) - 1)

    @classmethod
    def load(cls, model_file: str, offset: float = 100.0) -> Pieces:
        """The pieces of a model file; ``offset`` is that of Zipf's law, for a BPE model's ranks."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        control = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        special = control | set(byte_ids.values())
        plain = [i for i in range(n) if i not in special]
        scores = [sp.get_score(i) for i in range(n)]
        for i, s in zip(plain, zipf([scores[i] for i in plain], offset), strict=True):
            scores[i] = s
        return cls(pieces, scores, byte_ids, control, sp.unk_id())

    def _spell(self, point: int) -> list[int]:
        """Ids of a character that is no piece."""
        data = chr(point).encode()
        return [self.byte_ids[b] for b in data] if all(b in self.byte_ids for b in data) else [self.unknown_id]

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best ids of the words, one after the other, and their numbers; words of one length advance together."""
        flat: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        sizes = np.zeros(len(words), dtype=np.int64)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        order: list[int] = []
        for length, members in by_length.items():
            some = max(1, (1 << 20) // (max(1, length) * min(max(1, length), self.longest)))
            for k in range(0, len(members), some):
                part = members[k : k + some]
                if length > LONG:
                    own = [self._long(words[i]) for i in part]
                    ids, n = np.concatenate(own), [len(x) for x in own]
                elif length:
                    ids, n = self._advance(_points("".join([words[i] for i in part])).reshape(len(part), length))
                else:
                    ids, n = flat[0], 0
                flat.append(ids)
                sizes[part] = n
                order += part
        at = np.empty(len(words), dtype=np.int64)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(flat)[flat_take(at, sizes)], sizes

    def _matches(self, letters: np.ndarray, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces of ``size`` characters are: rows, starts and the pieces' places."""
        count = letters.shape[1] - size + 1
        hashes = ((prefix[:, size:] - prefix[:, :count]) * _DOWN[:count]).reshape(-1)
        likely = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE)])
        wanted = hashes[likely]
        found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        same = self.keys[found] == wanted
        likely, found = likely[same], found[same]
        row, start = np.divmod(likely, count)
        real = np.ones(len(likely), dtype=bool)
        for k in range(size):
            real &= self.letters[found, k] == letters[row, start + k]
        if size < self.longest:
            real &= self.letters[found, size] == 0
        return row[real], start[real], found[real]

    def _advance(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and their numbers."""
        n, length = letters.shape
        longest = min(length, self.longest)
        prefix = np.zeros((n, length + 1), dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _UP[:length], axis=1, out=prefix[:, 1:])
        # By end and size of the last piece: its score and its place among the pieces.
        score = np.full((length + 1, longest, n), -np.inf)
        place = np.full((length + 1, longest, n), -1, dtype=np.int32)
        score[:, 0] = self.unknown_score
        if len(self.keys):
            for size in range(1, longest + 1):
                row, start, found = self._matches(letters, prefix, size)
                score[start + size, size - 1, row], place[start + size, size - 1, row] = self.scores[found], found
        best = np.zeros((length + 1, n))
        back = np.zeros((length + 1, n), dtype=np.int64)  # size of the last piece, less 1
        for end in range(1, length + 1):
            most = min(end, longest)
            sums = score[end, :most] + best[end - most : end][::-1]
            back[end] = sums.argmax(axis=0)
            best[end] = sums.max(axis=0)
        every, end, steps = np.arange(n), np.full(n, length), []
        while end.any():
            size = back[end, every]
            steps.append(np.where(end > 0, np.where(place[end, size, every] >= 0, place[end, size, every], -1 - end), 0 - (1 << 30)))
            end = np.where(end > 0, end - size - 1, 0)
        chosen = np.stack(steps[::-1], axis=1)
        there = chosen > -(1 << 30)
        sizes, flat = there.sum(axis=1), chosen[there]
        ids = self.ids[np.maximum(flat, 0)] if len(self.ids) else np.zeros(len(flat), dtype=np.int64)
        unknown = np.flatnonzero(flat < 0)
        if len(unknown):
            rows = np.repeat(every, sizes)
            spelled = [self._spell(int(letters[rows[k], -2 - flat[k]])) for k in unknown]
            more = np.array([len(x) for x in spelled]) - 1
            np.add.at(sizes, rows[unknown], more)
            widths = np.ones(len(flat), dtype=np.int64)
            widths[unknown] += more
            ids = np.repeat(ids, widths)
            ids[flat_take(np.cumsum(widths)[unknown] - widths[unknown], widths[unknown])] = [i for x in spelled for i in x]
        return ids, sizes

    def _long(self, word: str) -> np.ndarray:
        """Ids of one long word, by the same search over the pieces found at each end."""
        letters = _points(word)
        length = len(letters)
        ends: dict[int, list[tuple[int, float, int]]] = {}
        for first in range(0, length, LONG):
            window = letters[None, first : first + LONG + self.longest - 1]
            prefix = np.zeros((1, window.shape[1] + 1), dtype=np.uint64)
            np.cumsum((window.astype(np.uint64) + np.uint64(1)) * _UP[: window.shape[1]], axis=1, out=prefix[:, 1:])
            for size in range(1, min(window.shape[1], self.longest) + 1) if len(self.keys) else ():
                _, start, found = self._matches(window, prefix, size)
                for a, p in zip(start.tolist(), found.tolist(), strict=True):
                    if a < LONG:
                        ends.setdefault(first + a + size, []).append((size, float(self.scores[p]), p))
        best, back = [0.0] * (length + 1), [(1, -1)] * (length + 1)
        for end in range(1, length + 1):
            value, choice = best[end - 1] + self.unknown_score, (1, -1)
            for size, score, p in ends.get(end, ()):
                if best[end - size] + score > value:
                    value, choice = best[end - size] + score, (size, p)
            best[end], back[end] = value, choice
        out: list[int] = []
        end = length
        while end:
            size, p = back[end]
            out += [int(self.ids[p])] if p >= 0 else self._spell(int(letters[end - 1]))[::-1]
            end -= size
        return np.array(out[::-1], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts first."""
        data = self.bytes[flat_take(self.starts[ids], self.sizes[ids])].tobytes()
        return data[1:] if data[:1] == b" " else data


RUN = re.compile(r" ( *[^ ]*)")


def _parts(text: str) -> list[str]:
    """What follows the first space of each run of spaces, with one more space before the text."""
    if "  " in text or text.startswith(" "):
        return RUN.findall(" " + text)
    return text.split(" ") if text else []


class Encoder:
    """Ids of whole texts, from a cache of their parts of at most ``most`` entries."""

    def __init__(self, pieces: Pieces, most: int = 100_000):
        self.pieces, self.most = pieces, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.most:
            self._clear()
        split = [_parts(x) for x in texts]
        place = self.place
        fresh = list({w for parts in split for w in parts if w not in place})
        if fresh:
            ids, sizes = self.pieces.best([MARK + w.replace(" ", MARK) for w in fresh])
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            self.pool, self.sizes = np.concatenate([self.pool, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        at = np.fromiter((place[w] for parts in split for w in parts), dtype=np.int64)
        totals = np.concatenate([[0], np.cumsum(self.sizes[at])])
        counts = np.array([len(x) for x in split], dtype=np.int64)
        bounds = np.cumsum(counts)
        ids = self.pool[flat_take(starts[at], self.sizes[at])]
        return [ids[totals[b - c] : totals[b]] for b, c in zip(bounds, counts, strict=True)]


@lru_cache(maxsize=2)
def _loaded(model_file: str) -> Pieces:
    return Pieces.load(model_file)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """Columns of ``docs`` and piece_ids."""
    bound_batches(docs.sparkSession)
    at = place(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_loaded(model_file))
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                ids = encoder(as_text(part.column(at)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "piece_ids"])

    return restored(plain(docs).mapInArrow(work, with_fields(docs, "piece_ids array<int>")), docs, ("piece_ids",))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Columns of ``encoded`` and decoded, the text of piece_ids; ids of lone bytes that form no UTF-8 become U+FFFD."""
    bound_batches(encoded.sparkSession)
    at = place(encoded, "piece_ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model_file)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], dtype=np.int64)).decode(errors="replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return restored(plain(encoded).mapInArrow(work, with_fields(encoded, "decoded string")), encoded, ("decoded",))


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip (decoding gives the text again)."""
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model_file)
        encoder = Encoder(pieces)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                texts = as_text(part.column("text"))
                ids = encoder(texts)
                same = [pieces.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crcs, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, round_trip boolean")


def reference(word: str, pieces: dict[str, float], unknown_score: float) -> float:
    """The largest sum of scores of a word by plain dynamic programming, for tests."""
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + unknown_score
        for start in range(end):
            if (s := pieces.get(word[start:end])) is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]
