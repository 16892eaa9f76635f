"""Scores of texts by a causal self-attention model over subword ids, trained in numpy, beside a unigram base.

Training documents are those whose id's CRC-32 modulo 7 isn't 2. Words are lower-cased (A-Z) runs without ASCII blanks; each is spelled in
pieces of a public vocabulary, and an end follows each text. The chance of a piece is that of its class, from attention, times that of
the piece in its class, from counts over all training words. The commonest first pieces and inner pieces of words have classes of their
own; others share classes by frequency, first and inner ones apart.

A word's chance is that of its first piece, given that a word or the end comes, times a mixture of two: the word's share of all
training words with that first piece (weight ``known``), and its other pieces and the word's end from attention.

Classes lie in groups of GROUP: the chance of a class is that of its group, times its own in the group, so that a piece costs two
small softmaxes in place of one over all classes.

Sequences are cut in blocks. A window is a block and the block before it: queries come from the later block alone, keys and
values from both, under a causal mask, so windows overlap by half and score each piece once; many windows are one numpy
batch. Training takes every piece of every training document once, a share of the documents in each round: every partition trains from the shared
weights by Adam as its documents pass, and the weights are averaged, weighted by blocks, in one aggregation. A partition with too few blocks for
``steps`` goes over them again. Weights start from counts of pairs of neighbouring classes over all training documents.

The base needs each word's count in the training corpus. Words of at least 1/``heavy`` of all tokens (``heavy`` at most) are
broadcast; the rest meet their counts in a join.

Null text is empty (an end alone). A null doc_id is hashed as the text ``null``. Repeated rows are scored and counted each, and very long texts are
scored whole. Empty tables give empty results; with no training documents all classes are alike. Extra columns, of any name, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, flat_take, held_out, keep_memory, materialize, one_thread, remove_table, write_table
from pagewarden.llm.tokenstore import ChunkEncoder

BLOCK = 8
GROUP = 16  # classes of a group
END = b""  # the end's key among words


@dataclass(frozen=True)
class Config:
    model_file: str
    classes: int = 240  # a multiple of GROUP, 240 at most
    width: int = 16
    rounds: int = 2
    rate: float = 0.01
    steps: int = 500
    known: float = 0.85
    batch: int = 256
    heavy: int = 100_000
    seed: int = 3


class Vocabulary:
    """Classes of pieces and log10 chances of pieces in their classes, from counts of pieces and the number of ends; ``first_counts`` are words by first piece."""

    def __init__(self, counts: np.ndarray, starts: np.ndarray, ends: int, classes: int):
        self.class_of = np.zeros(len(counts), dtype=np.uint8)
        self.n_boundary = GROUP * (3 * classes // (5 * GROUP))  # classes that end the text or begin a word come first, in whole groups
        firsts = self.n_boundary - 9
        begin = 1
        for group, single in ((starts, firsts), (~starts, classes - self.n_boundary - 8)):
            order = np.flatnonzero(group)[np.argsort(-counts[group], kind="stable")]
            self.class_of[order[:single]] = begin + np.arange(len(order[:single]))
            rest = order[single:]
            share = np.cumsum(counts[rest] + 1.0) / max(1.0, float((counts[rest] + 1.0).sum()))
            self.class_of[rest] = begin + single + np.minimum(7, (share * 8).astype(np.int64))
            begin += single + 8
        size = np.bincount(self.class_of, weights=counts + 1.0, minlength=classes)
        self.log_inside = np.log10((counts + 1.0) / size[self.class_of])
        self.class_counts = size
        self.class_counts[0] = ends + 1.0
        self.first_counts = np.zeros(len(counts))


def _encode(model_file: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return lambda words: sp.encode(words, num_threads=1)


def initial(vocabulary: Vocabulary, config: Config, pairs: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Starting weights. Inputs are the classes, then begin and nothing; the output bias has the classes' frequencies.

    With counts of (input, next class) pairs, inputs and outputs start as a factored table of these, so that attention only has to learn what
    the last piece doesn't tell.
    """
    rng = np.random.default_rng(config.seed)
    c, d = config.classes, config.width
    n = c // GROUP
    shapes = {"e": (c + 2, d), "p": (2 * BLOCK, d), "q": (d, d), "k": (d, d), "v": (d, d), "u": (d, c), "g": (d, n)}
    weights = {name: (rng.standard_normal(shape) * (0.1 if name in "epv" else d**-0.5)).astype(np.float32) for name, shape in shapes.items()}
    counts = np.maximum(vocabulary.class_counts, 1e-9)
    share = counts / counts.sum()
    of_group = share.reshape(n, GROUP).sum(axis=1)
    weights["b"] = np.log(share / np.repeat(of_group, GROUP)).astype(np.float32)
    weights["c"] = np.log(of_group).astype(np.float32)
    if pairs is not None and pairs.sum():
        seen = pairs.sum(axis=1, keepdims=True)
        lift = np.log((pairs + 5 * share) / (seen + 5)) - np.log(share)
        scale = np.sqrt(seen + 1.0)
        left, values, right = np.linalg.svd(lift * scale * np.sqrt(share), full_matrices=False)
        root = np.sqrt(values[:d])
        e, u = left[:, :d] * root / scale, root[:, None] * right[:d] / np.sqrt(share)
        in_groups = pairs.reshape(len(pairs), n, GROUP).sum(axis=2)
        lift = np.log((in_groups + 5 * of_group) / (seen + 5)) - np.log(of_group)
        balance = np.sqrt(np.abs(u).mean() / max(1e-9, np.abs(e).mean()))
        weights["e"], weights["u"] = (e * balance).astype(np.float32), (u / balance).astype(np.float32)
        weights["g"] = np.linalg.lstsq(e * balance * scale, lift * scale, rcond=1e-6)[0].astype(np.float32)
    return weights


#: A query at place i of the later block sees the block before and its own places up to i.
_CAUSAL = (np.arange(2 * BLOCK)[None, :] <= BLOCK + np.arange(BLOCK)[:, None]).astype(np.float32)


def _exp(x: np.ndarray, axis: int) -> np.ndarray:
    """exp(x) in place; where any x is too large or small for it, each less the greatest along the axis."""
    if max(x.max(), -x.min()) > 80:
        x -= x.max(axis=axis, keepdims=True)
    return np.exp(x, out=x)


def _attend(w: dict[str, np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys and values, queries and inputs, attention, what it sums, and outputs with a last column of 1.

    Inputs are sums of a class's and a place's vector, so keys, values and queries are too: each is made once a class and once a place.
    """
    d = w["e"].shape[1]
    both, own = np.concatenate([w["k"], w["v"]], axis=1), np.concatenate([w["q"] * w["e"].dtype.type(d**-0.5), np.eye(d, dtype=w["e"].dtype)], axis=1)
    kv = (w["e"] @ both).take(windows, axis=0)
    kv += w["p"] @ both
    qx = (w["e"] @ own).take(windows[:, BLOCK:], axis=0)
    qx += w["p"][BLOCK:] @ own
    a = qx[:, :, :d] @ kv[:, :, :d].transpose(0, 2, 1)
    visible = (windows != len(w["e"]) - 1).astype(a.dtype)[:, None, :]
    if np.abs(a).max() > 80:
        a = np.where(visible * _CAUSAL > 0, a, a.dtype.type(-1e9))
    _exp(a, 2)
    a *= _CAUSAL
    a *= visible
    a /= (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, dtype=a.dtype)).reshape(*a.shape[:2], 1)
    summed = a @ kv[:, :, d:]
    h = np.ones((len(windows), BLOCK, d + 1), dtype=a.dtype)
    np.add(qx[:, :, d:], summed, out=h[:, :, :d])
    return kv, qx, a, summed, h.reshape(-1, d + 1)


#: Windows scored at once: few enough that their arrays stay in a core's cache.
AT_ONCE = 256


def _by_group(targets: np.ndarray, n_groups: int) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """An order of flat targets by group, and for each group its classes and its places in that order."""
    group = targets >> 4
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=n_groups)).tolist()
    return order, [(slice(k * GROUP, (k + 1) * GROUP), slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _logits(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> tuple:
    """Weights with biases, logits of groups (groups, places), the order by group and its parts, outputs in that order, and logits in the target's group (GROUP, places in order)."""
    of_groups, of_classes = np.concatenate([w["g"], w["c"][None]]), np.concatenate([w["u"], w["b"][None]])
    order, parts = _by_group(target, len(w["c"]))
    in_order, inside = h.take(order, axis=0), np.empty((GROUP, len(h)), dtype=h.dtype)
    for classes, at in parts:
        np.matmul(of_classes[:, classes].T, in_order[at].T, out=inside[:, at])
    return of_groups, of_classes, of_groups.T @ h.T, order, parts, in_order, inside


def log_chances(w: dict[str, np.ndarray], windows: np.ndarray, targets: np.ndarray, n_boundary: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """log10 chances of the targets, and of the first ``n_boundary`` classes (whole groups) together, at each place: windows (n, 2 * BLOCK) of input classes, targets (n, BLOCK)."""
    own, ends = np.empty(targets.size), np.zeros(targets.size)
    for first in range(0, len(windows), AT_ONCE):
        h = _attend(w, windows[first : first + AT_ONCE])[-1]
        target = targets[first : first + AT_ONCE].reshape(-1).astype(np.uint8)
        _, _, groups, order, _, _, inside = _logits(w, h, target)
        every, here = np.arange(len(target)), slice(first * BLOCK, first * BLOCK + len(target))
        for logits, picked, places in ((groups, target >> 4, here), (inside, (target & 15)[order], here.start + order)):
            if max(logits.max(), -logits.min()) > 80:
                logits -= logits.max(axis=0)
            value = logits[picked, every]
            total = np.exp(logits, out=logits).sum(axis=0)
            value -= np.log(total)
            if logits is groups:
                own[places] = value
                if n_boundary:
                    ends[here] = np.log(np.maximum(logits[: n_boundary // GROUP].sum(axis=0), 1e-30) / total)
            else:
                own[places] += value
    return own.reshape(targets.shape) / np.log(10), ends.reshape(targets.shape) / np.log(10)


def _sums_of(classes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of each class's rows."""
    classes = classes.reshape(-1).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    sizes = np.bincount(classes, minlength=n)
    some = np.flatnonzero(sizes)
    out = np.zeros((n, rows.shape[-1]), dtype=rows.dtype)
    out[some] = np.add.reduceat(rows.reshape(-1, rows.shape[-1]).take(order, axis=0), (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the counted targets, and its gradients."""
    d, dtype = w["e"].shape[1], w["e"].dtype
    kv, qx, a, summed, h = _attend(w, windows)
    n, target = max(1, int(counted.sum())), targets.reshape(-1).astype(np.uint8)
    every, share = np.arange(len(target)), (counted.reshape(-1) / n).astype(dtype)
    of_groups, of_classes, p, order, parts, in_order, inside = _logits(w, h, target)
    loss = 0.0
    for x, picked, part in ((p, target >> 4, share), (inside, (target & 15)[order], share[order])):
        _exp(x, 0)
        x /= x.sum(axis=0)
        loss -= float(np.log(x[picked, every] + 1e-30) @ part)
        x[picked, every] -= 1
        x *= part
    both = (p @ h).T
    g = {"g": both[:-1], "c": both[-1]}
    dh = p.T @ w["g"].T
    both, more = np.zeros_like(of_classes), np.empty_like(dh)
    for classes, at in parts:
        both[:, classes] = (inside[:, at] @ in_order[at]).T
        np.matmul(inside[:, at].T, w["u"][:, classes].T, out=more[at])
    g["u"], g["b"] = both[:-1], both[-1]
    back = np.empty_like(order)
    back[order] = every
    dh += more.take(back, axis=0)
    dh = dh.reshape(-1, BLOCK, d)
    dkv, dqx = np.empty_like(kv), np.empty_like(qx)
    ds = dh @ kv[:, :, d:].transpose(0, 2, 1)
    ds -= ((dh * summed).reshape(-1, d) @ np.ones(d, dtype=dtype)).reshape(-1, BLOCK, 1)
    ds *= a
    np.matmul(a.transpose(0, 2, 1), dh, out=dkv[:, :, d:])
    np.matmul(ds.transpose(0, 2, 1), qx[:, :, :d], out=dkv[:, :, :d])
    np.matmul(ds, kv[:, :, :d], out=dqx[:, :, :d])
    dqx[:, :, :d] *= dtype.type(d**-0.5)
    dqx[:, :, d:] = dh
    # Sums by class and by place are all that the inputs' weights need.
    kv_classes, kv_places = _sums_of(windows, dkv, len(w["e"])), dkv.sum(axis=0)
    qx_classes, qx_places = _sums_of(windows[:, BLOCK:], dqx, len(w["e"])), np.zeros((2 * BLOCK, 2 * d), dtype=dtype)
    qx_places[BLOCK:] = dqx.sum(axis=0)
    keys, values, queries, own = (np.concatenate([x[:, cut], y[:, cut]]) for x, y in ((kv_classes, kv_places), (qx_classes, qx_places)) for cut in (slice(d), slice(d, None)))
    inputs = np.concatenate([w["e"], w["p"]])
    g["k"], g["v"], g["q"] = inputs.T @ keys, inputs.T @ values, inputs.T @ queries
    dx = keys @ w["k"].T + values @ w["v"].T + queries @ w["q"].T + own
    g["e"], g["p"] = dx[: len(w["e"])], dx[len(w["e"]) :]
    return loss, g


class Adam:
    """Weights that learn from one batch of windows after the other; ``w`` are views of one flat array."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.rate, self.steps = rate, 0
        self.flat = np.concatenate([x.reshape(-1) for x in weights.values()])
        cuts = np.cumsum([x.size for x in weights.values()])[:-1]
        self.w = {name: part.reshape(x.shape) for (name, x), part in zip(weights.items(), np.split(self.flat, cuts), strict=True)}
        self.m1, self.m2 = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def learn(self, items: np.ndarray) -> None:
        """One step over items (n, 3 * BLOCK + 1: window, targets and how many of them count)."""
        self.steps += 1
        counted = np.arange(BLOCK)[None, :] < items[:, -1:]
        _, g = gradients(self.w, items[:, : 2 * BLOCK], items[:, 2 * BLOCK : 3 * BLOCK], counted)
        g = np.concatenate([g[name].reshape(-1) for name in self.w])
        self.m1 += 0.1 * (g - self.m1)
        self.m2 += 0.01 * (g**2 - self.m2)
        self.flat -= np.float32(self.rate) * (self.m1 / (1 - 0.9**self.steps)) / (np.sqrt(self.m2 / (1 - 0.99**self.steps)) + np.float32(1e-6))


def fit_blocks(w: dict[str, np.ndarray], batches: Iterator[np.ndarray], rate: float, batch: int, steps: int = 0) -> tuple[dict[str, np.ndarray], int]:
    """Learned weights and the number of items, of arrays of items that pass once. If they make fewer than ``steps`` steps, all of them are gone over again."""
    adam, n = Adam(w, rate), 0
    held: list[np.ndarray] = []  # all items, while they are few
    rest = np.zeros((0, 3 * BLOCK + 1), dtype=np.uint8)
    for items in batches:
        n += len(items)
        held = [*held, items] if n <= steps * batch else []
        rest = np.concatenate([rest, items])
        done = len(rest) - len(rest) % batch
        for k in range(0, done, batch):
            adam.learn(rest[k : k + batch])
        rest = rest[done:]
    if len(rest):
        adam.learn(rest)
    if n:
        every = np.concatenate(held) if held else rest[:0]
        for _ in range(max(0, -(-steps // adam.steps) - 1) if held else 0):
            for k in range(0, len(every), batch):
                adam.learn(every[k : k + batch])
    return adam.w, n


def cut_windows(classes: np.ndarray, counts: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows, targets, how many targets count, and the owner, of sequences of classes one after the other."""
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(counts)), blocks)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first * BLOCK, counts)
    targets = np.zeros(len(owner) * BLOCK, dtype=np.uint8)
    targets[place] = classes
    inputs = np.full(len(owner) * BLOCK + 1, n_classes + 1, dtype=np.uint8)
    inputs[1:][place] = classes
    inputs = inputs[:-1].reshape(-1, BLOCK).copy()
    inputs[first[counts > 0], 0] = n_classes  # begin
    before = np.full_like(inputs, n_classes + 1)
    before[1:] = inputs[:-1]
    before[first[counts > 0]] = n_classes + 1
    counted = np.full(len(owner), BLOCK, dtype=np.uint8)
    last = first + blocks - 1
    counted[last[counts > 0]] = (counts - (blocks - 1) * BLOCK)[counts > 0]
    return np.concatenate([before, inputs], axis=1), targets.reshape(-1, BLOCK), counted, owner


def _with_ends(ids: np.ndarray, counts: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pieces with an end (class 0) after each text."""
    classes = np.insert(class_of[ids], np.cumsum(counts), 0)
    return classes, counts + 1


def _word_chances(vocabulary: Vocabulary, weights: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, n_words: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of pieces with its end and the log10 chance by attention alone (with the mixture's other weight for each word); per word the log10 chance of what follows its first piece."""
    cumulated = np.concatenate([[0], np.cumsum(sizes)])
    last = np.cumsum(n_words)
    counts = cumulated[last] - cumulated[last - n_words]
    classes, counts = _with_ends(ids, counts, vocabulary.class_of)
    windows, targets, counted, owner = cut_windows(classes, counts, config.classes)
    own, ends = log_chances(weights, windows, targets, vocabulary.n_boundary)
    real = np.arange(BLOCK)[None, :] < counted[:, None]
    chance, bound = own[real], ends[real]
    text_of = np.repeat(np.arange(len(n_words)), counts)
    end_at = np.cumsum(counts) - 1
    inner = np.ones(len(chance), dtype=bool)
    inner[end_at] = False
    chance[inner] += vocabulary.log_inside[ids]
    # Places of first pieces: pieces before the word, and the ends of the texts before its own.
    first = cumulated[:-1] + np.repeat(np.arange(len(n_words)), n_words)
    cut = np.zeros(len(chance), dtype=bool)
    cut[first] = True
    chance[cut | ~inner] -= bound[cut | ~inner]  # given that a word or the end comes
    sums = np.concatenate([[0.0], np.cumsum(chance)])
    tails = sums[first + sizes] - sums[first + 1] + bound[first + sizes]
    heads = np.bincount(text_of, weights=chance, minlength=len(n_words)).astype(np.float64)
    heads += np.bincount(np.repeat(np.arange(len(n_words)), n_words), weights=bound[first + sizes] + np.log10(1 - config.known), minlength=len(n_words))
    return counts, heads, tails


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: counts of all training words, and of ends under the empty word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if not held_out(doc_id):
                    found.update(text.lower().split())
                    found[END] += 1
                    if len(found) > 400_000:
                        yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(words: DataFrame, config: Config) -> Vocabulary:
    """Piece counts follow from word counts; what reaches the driver is bounded by the public vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encode(config.model_file)
        totals = np.zeros((2, n_pieces), dtype=np.int64)  # of pieces, and of first pieces
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = encode([w.decode() for w in batch.column("word").to_pylist()])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int64)
            n = np.array(batch.column("n").to_pylist(), dtype=np.int64)
            firsts = np.fromiter((x[0] for x in ids), dtype=np.int64, count=len(ids))
            for k, (own, weights) in enumerate(((flat, np.repeat(n, [len(x) for x in ids])), (firsts, n))):
                totals[k] += np.bincount(own, weights=weights, minlength=n_pieces).astype(np.int64)
        names = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(x[names]) for x in totals]], names=["piece", "n", "first"])

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=config.model_file)
    n_pieces = sp.get_piece_size()
    counts, firsts = np.zeros(n_pieces), np.zeros(n_pieces)
    sums = words.filter(F.length("word") > 0).mapInArrow(work, "piece bigint, n bigint, first bigint").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    for row in sums.toLocalIterator():
        counts[row.piece], firsts[row.piece] = row.n, row["first"]
    ends = words.filter(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    starts = np.array([sp.id_to_piece(i).startswith("▁") for i in range(len(counts))])
    vocabulary = Vocabulary(counts, starts, ends, config.classes)
    vocabulary.first_counts = firsts
    return vocabulary


def train(docs: DataFrame, vocabulary: Vocabulary, config: Config) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` rounds, which share all training documents between them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    classes, rounds = config.classes, config.rounds

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The round and the classes, with the end, of each training document."""
        encoder = ChunkEncoder(_encode(config.model_file))
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            own = [t.lower() for i, t in zip(ids, texts, strict=True) if not held_out(i)]
            for k in range(0, len(own), 256):
                part = own[k : k + 256]
                sequence, counts = _with_ends(*encoder(part), shared.value.class_of)
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                rows = pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(sequence)])
                yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(t) % rounds for t in part], pa.int32()), rows], names=["round", "classes"])

    def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Items of the documents of such rows."""
        for batch in batches:
            own = batch.column("classes").to_pylist()
            for k in range(0, len(own), 256):
                part = own[k : k + 256]
                windows, targets, counted, _ = cut_windows(np.frombuffer(b"".join(part), dtype=np.uint8), np.array([len(x) for x in part]), classes)
                yield np.concatenate([windows, targets, counted[:, None]], axis=1)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((classes + 2) * classes, dtype=np.int64)
        for rows in items_of(batches):
            real = np.arange(BLOCK)[None, :] < rows[:, -1:]
            found += np.bincount((rows[:, BLOCK : 2 * BLOCK].astype(np.int64) * classes + rows[:, 2 * BLOCK : 3 * BLOCK])[real], minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found)), pa.array(found[found > 0])], names=["place", "n"])

    spelled, path = write_table(docs.select("doc_id", "text").mapInArrow(sequences, "round int, classes binary"), "sequences")
    pairs = np.zeros((classes + 2) * classes)
    for r in spelled.mapInArrow(count_pairs, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most as many as pairs of classes
        pairs[r.place] = r.n
    weights = initial(vocabulary, config, pairs.reshape(classes + 2, classes))
    names = sorted(weights)
    for round_no in range(rounds):
        now = spark.sparkContext.broadcast(weights)
        rate = config.rate / 2**round_no

        def local(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            one_thread()
            keep_memory()
            w, n = fit_blocks(now.value, items_of(batches), rate, config.batch, config.steps)
            if n:
                flat = np.concatenate([w[x].reshape(-1) for x in names]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), float(n)))], names=["place", "total", "n"])

        rows = spelled.filter(F.col("round") == round_no).mapInArrow(local, "place bigint, total double, n double").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()  # as many as weights
        if not rows:
            continue
        flat = np.zeros(len(rows), dtype=np.float32)
        for r in rows:
            flat[r.place] = r["mean"]
        cuts = np.cumsum([weights[x].size for x in names])[:-1]
        weights = {x: part.reshape(weights[x].shape) for x, part in zip(names, np.split(flat, cuts), strict=True)}
    remove_table(spark, path)
    return weights


class _WordCache(ChunkEncoder):
    """A cache of words that also keeps each word itself, its frequent count and the logarithm of that plus 1."""

    def __init__(self, encode, frequent: dict[bytes, int]):
        self.frequent = frequent
        super().__init__(encode)

    def _clear(self) -> None:
        super()._clear()
        self.words, self.counts = pa.array([], pa.binary()), np.zeros(0)

    def _learn(self, fresh: list[bytes]) -> None:
        super()._learn(fresh)
        self.words = pa.concat_arrays([self.words, pa.array(fresh, pa.binary())])
        self.counts = np.concatenate([self.counts, np.array([self.frequent.get(w, 0) for w in fresh], dtype=np.float64)])
        self.logs = np.log10(self.counts + 1.0)


def score(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pieces for each document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = materialize(count_words(docs), "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = {bytes(r.word): r.n for r in words.filter(F.col("n") * config.heavy >= max(1, n)).collect()}  # at most ``heavy`` words
    vocabulary = learn_vocabulary(words, config)
    weights = train(docs, vocabulary, config)
    shared = spark.sparkContext.broadcast((vocabulary, weights, frequent))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one_thread()
        keep_memory()
        vocabulary, weights, frequent = shared.value
        end_log = float(np.log10(frequent.get(END, 0) + 1.0))
        log_first = np.log10(np.maximum(vocabulary.first_counts, 1.0)) - np.log10(config.known / (1 - config.known))
        cache = _WordCache(_encode(config.model_file), frequent)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts, doc_ids = [x.lower() for x in as_bytes(part.column("text"))], part.column("doc_id").to_pylist()
                at, n_words = cache.places(texts)
                starts, sizes = np.cumsum(cache.sizes) - cache.sizes, cache.sizes[at]
                ids = cache.pool[flat_take(starts[at], sizes)]
                pieces, heads, tails = _word_chances(vocabulary, weights, ids, sizes, n_words, config)
                tails += log_first[ids[np.cumsum(sizes) - sizes]]
                text_of = np.repeat(np.arange(len(texts)), n_words)
                c = cache.counts[at]
                # The head has each word's first piece and its attention path; a known word's share of those with its first piece adds to that.
                gain = np.log10(1 + c * 10.0 ** np.minimum(-tails, 300))
                sums = [np.bincount(text_of, weights=x, minlength=len(texts)) for x in (gain, cache.logs[at] if len(at) else c, c > 0)]
                mine = np.flatnonzero(c == 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text_of[mine], minlength=len(texts)))]).astype(np.int32)
                rare = pa.StructArray.from_arrays([cache.words.take(pa.array(at[mine])), pa.array(tails[mine].astype(np.float32))], names=["word", "tail"])
                columns = [pa.array(np.arange(row, row + len(texts))), part.column("doc_id"), pa.array([held_out(x) for x in doc_ids]), pa.array(n_words + 1), pa.array(sums[2].astype(np.int64) + 1), pa.array(sums[1] + end_log), pa.array(heads + sums[0]), pa.array(pieces, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rare)]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_pieces", "rare"])

    kind = f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, score double, n_pieces bigint, rare array<struct<word:binary,tail:float>>"
    scored = materialize(docs.mapInArrow(work, kind), "scored")
    rare = scored.select("row", F.inline("rare")).join(words, "word")
    gain = F.log10(1 + F.col("n") * F.pow(F.lit(10.0), F.least(-F.col("tail").cast("double"), F.lit(300.0))))
    sums = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rare_base"), F.sum(gain).alias("rare_gain"))
    return scored.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_gain", F.lit(0.0))).alias("score"),
        "n_pieces",
    )
