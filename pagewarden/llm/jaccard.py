"""Near-duplicate join on word n-grams, with Bayesian pruning of candidates.

Texts are lower-cased (A-Z) and cut at ASCII white space; a text's set holds its runs of ``n`` words, or its one run of all words
if it has fewer. Equal texts share one node. Nodes that agree in all rows of a MinHash band are candidates. Their MinHash
values are compared step by step; with a uniform prior, a pair is dropped as soon as the posterior chance of reaching the
threshold falls below ``tolerance``. The rest are verified exactly on their n-grams.

A small bucket gives all its pairs. A large one first links its members to one lead, the member whose buckets are the largest (the text
that most resemble, as the base of a group of variants is). Members of large buckets that lie in several components after that
meet once more, all of those with one lead, in pairs of blocks: a block pair is one group, and one matrix product over the
n-grams that both blocks have gives the size of every intersection, for the rows and columns whose MinHash values leave a chance. No bucket is cut, no group is held whole in a task, and copies are
never expanded into pairs.

Result: one row per document with its class (the smallest doc_id of its component) and its text's number of links: the other texts
at the threshold or above. Two such texts are always in one class, so the links of a class whose pairs weren't all verified yet are
counted over all its pairs, in block pairs too. That work grows with the square of a class; only counts leave a task.

Texts are told apart by 128 bits of a cryptographic hash of their words, and get numbers; rows by as many of their id and text. Rows that meet one row of another table (a lead, a label, a bucket) are dealt where they are many.

Null texts are empty; texts without words are equal. Repeated rows are copies. A null doc_id never names a class that has
another id. Very long texts are taken whole. Empty tables give empty results; extra columns are left out of classes() and kept by
dedup(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_bytes, bound_batches, dealt_join, gram_hashes, materialize, mix64, one_thread, place, plain, powers, restored, row_key, runs, word_hashes
from pagewarden.operators.likeness import components


@dataclass(frozen=True)
class Search:
    n: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    step: int = 32
    tolerance: float = 1e-5
    small: int = 24
    block: int = 1024  # texts that meet as many others in one task, 2 million n-grams at most

    @property
    def values(self) -> int:
        return self.bands * self.rows


def least_matches(search: Search) -> list[tuple[int, int]]:
    """(values compared, fewest matches to go on): below that, P(J >= threshold) after a uniform prior is under the tolerance."""
    out = []
    for k in range(search.step, search.values + 1, search.step):
        # The posterior is Beta(m + 1, k - m + 1); its tail equals a binomial one.
        tail = np.cumsum([comb(k + 1, i) * search.threshold**i * (1 - search.threshold) ** (k + 1 - i) for i in range(k + 2)])
        out.append((k, int(np.flatnonzero(tail >= search.tolerance)[0])))
    return out


def grams(text: bytes, n: int = 5) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


_ODD = (mix64(powers(0xD1342543DE82EF95, 4096)) >> np.uint64(32)).astype(np.uint32)


def signatures(texts: list[bytes], search: Search) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values, one row per text (zeros without words), and the numbers of words."""
    words, counts = word_hashes(texts, fold_case=True)
    out = np.zeros((len(texts), search.values), dtype=np.uint32)
    has = np.flatnonzero(counts)
    if not len(has):
        return out, counts
    begin = (np.cumsum(counts) - counts)[has]
    hashes = np.concatenate([gram_hashes(words, search.n), np.zeros(search.n, dtype=np.uint64)])[: len(words)]
    size = counts[has]
    for k in np.flatnonzero(size < search.n):  # the one run of all words
        a = begin[k]
        hashes[a] = mix64(np.array([np.bitwise_xor.reduce(mix64(words[a : a + size[k]] + np.arange(size[k], dtype=np.uint64)))]))[0]
    take = np.maximum(size - search.n + 1, 1)
    ends = np.cumsum(take)
    x = (hashes[np.repeat(begin - (ends - take), take) + np.arange(ends[-1])] >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    for k in range(search.values):
        np.bitwise_xor(x, _ODD[2 * k], out=y)
        np.multiply(y, _ODD[2 * k + 1] | np.uint32(1), out=y)
        np.bitwise_xor(y, y >> np.uint32(15), out=y)
        out[has, k] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), ends - take)
    return out, counts


def band_hashes(values: np.ndarray, search: Search) -> np.ndarray:
    """A hash for each text and band."""
    out = np.zeros((len(values), search.bands), dtype=np.uint64) + np.arange(1, search.bands + 1, dtype=np.uint64)
    grouped = values.reshape(len(values), search.bands, search.rows).astype(np.uint64)
    for k in range(search.rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return out


def _sign(docs: DataFrame, search: Search) -> DataFrame:
    """doc_id, key (the row's own), digest (its words'), n_words, values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for first, end in runs(texts):
                values, counts = signatures(texts[first:end], search)
                digests = [hashlib.blake2b(b" ".join(x.lower().split()), digest_size=16).digest() for x in texts[first:end]]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(digests, pa.binary()), pa.array(counts.astype(np.int64)), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["doc_id", "key", "digest", "n_words", "values"],
                )

    return docs.select("doc_id", "key", "text").mapInArrow(work, "doc_id bigint, key binary, digest binary, n_words bigint, values binary")


def text_nodes(keyed: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, digest of all rows, and node, digest, key (a row that has the text), n_words, values of every text. Nodes are numbers that the written table gives, so different digests never share one."""
    signed = materialize(_sign(keyed, search), "signed")
    each = signed.groupBy("digest").agg(F.min(F.struct("key", "n_words", "values")).alias("s"))
    nodes = materialize(each.select(F.monotonically_increasing_id().alias("node"), "digest", "s.*"), "nodes")
    return signed.select("doc_id", "key", "digest"), nodes


def _deal(nodes: DataFrame, search: Search) -> DataFrame:
    """bucket, node: one row for each band of a node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("values").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, search.values)
            nodes = np.array(batch.column("node").to_pylist(), dtype=np.int64)
            for k in range(0, len(nodes), 4096):
                hashes = band_hashes(values[k : k + 4096], search)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes[k : k + 4096], hashes.shape[1]))], names=["bucket", "node"])

    return nodes.filter("n_words > 0").select("node", "values").mapInArrow(work, "bucket bigint, node bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """bucket, node, size: rows of the buckets that hold two nodes or more."""
    return dealt_join(rows, rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "bucket", "node")


def _pairs(shared: DataFrame, search: Search) -> DataFrame:
    """a < b: all pairs of small buckets, and the members of large ones with the lead."""
    small = shared.filter(F.col("size") <= search.small).select("bucket", "node")
    both = small.select("bucket", F.col("node").alias("a")).join(small.select("bucket", F.col("node").alias("b")), "bucket").filter("a < b").select("a", "b")
    large = shared.filter(F.col("size") > search.small)
    weight = large.groupBy("node").agg(F.sum("size").alias("weight"))
    leads = large.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    star = dealt_join(large, leads, "bucket", "node").filter("node <> lead")
    return both.unionByName(star.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))).distinct()


def _prune(pairs: DataFrame, nodes: DataFrame, search: Search) -> DataFrame:
    """Pairs whose MinHash values leave a chance of reaching the threshold."""
    limits = least_matches(search)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, search.values) for c in ("x", "y"))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for k, least in limits:
                matches = matches + (x[alive, done:k] == y[alive, done:k]).sum(axis=1)
                alive, matches, done = alive[matches >= least], matches[matches >= least], k
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    side = nodes.select("node", "values")
    # A lead is in very many pairs: they are dealt, and each part has the lead's values once.
    first = dealt_join(pairs, side.select(F.col("node").alias("b"), F.col("values").alias("y")), "b", "a")
    joined = dealt_join(first, side.select(F.col("node").alias("a"), F.col("values").alias("x")), "a", "b", counted=pairs)
    return joined.select("a", "b", "x", "y").mapInArrow(work, "a bigint, b bigint")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes."""
    keys = wanted.join(nodes.select("node", "key"), "node")
    return materialize(docs.select("key", "text").join(keys, "key").select("node", "text").dropDuplicates(["node"]), "texts")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, x, y: pairs with their texts; those of one a lie together, in parts."""
    met = dealt_join(pairs, texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b", "a")
    return dealt_join(met, texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a", "b", counted=pairs).select("a", "b", "x", "y")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, search: Search) -> DataFrame:
    """Pairs that reach the threshold, by their n-grams."""
    texts = _texts(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), as_bytes(batch.column("x")), as_bytes(batch.column("y")), strict=True):
                if a != last:
                    last, own = a, grams(x, search.n)
                good.append(jaccard(own, grams(y, search.n)) >= search.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return _with_texts(pairs, texts).mapInArrow(work, "a bigint, b bigint")


def _grams(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, search: Search) -> DataFrame:
    """node, grams, values: hashes of the wanted nodes' n-grams, as 64-bit integers, and their MinHash values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [np.array([xxhash.xxh64_intdigest(g) for g in grams(x, search.n)], dtype=np.uint64).tobytes() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary()), batch.column("values")], names=["node", "grams", "values"])

    keys = wanted.join(nodes.select("node", "key", "values"), "node")
    texts = docs.select("key", "text").join(keys, "key").select("node", "text", "values").dropDuplicates(["node"])
    return materialize(texts.mapInArrow(work, "node bigint, grams binary, values binary"), "grams")


def _block_pairs(groups: DataFrame, counted: DataFrame, search: Search) -> DataFrame:
    """Rows of ``groups`` (group, node, grams) with i, j and block: a group's nodes are dealt to blocks, and each two blocks i <= j meet once. ``counted`` is a written table with the same groups."""
    n = F.greatest(F.count("*") / search.block, F.sum(F.octet_length("grams")) / (8 * 2_000_000))
    large = groups.groupBy("group").agg(F.ceil(n).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = dealt_join(groups, large, "group", "node", "left", counted=counted).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def similar(x: list[np.ndarray], y: list[np.ndarray], threshold: float, itself: bool = False) -> np.ndarray:
    """For each two sets of hashes, one of ``x`` and one of ``y``, whether they reach the threshold. ``itself``: x is y, and no set meets itself."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (x, y)]
    flat = [np.concatenate(side) if side else np.zeros(0, dtype=np.uint64) for side in (x, y)]
    if itself:
        values, n = np.unique(flat[0], return_counts=True)
        common = values[n > 1]
    else:
        common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    both = np.zeros((len(x), len(y)), dtype=np.float32)  # exact below 2**24
    if len(common):
        places = []
        for values, size in zip(flat, sizes, strict=True):
            at = np.minimum(np.searchsorted(common, values), len(common) - 1)
            real = common[at] == values
            order = np.argsort(at[real], kind="stable")
            places.append((at[real][order], np.repeat(np.arange(len(size)), size)[real][order]))
        for first in range(0, len(common), 2048):
            width, parts = min(2048, len(common) - first), []
            for (at, row), size in zip(places, sizes, strict=True):
                a, b = np.searchsorted(at, [first, first + width])
                part = np.zeros((len(size), width), dtype=np.float32)
                part[row[a:b], at[a:b] - first] = 1
                parts.append(part)
            both += parts[0] @ parts[1].T
    found = both / np.maximum(sizes[0][:, None] + sizes[1][None, :] - both.astype(np.float64), 1) >= threshold
    if itself:
        np.fill_diagonal(found, False)
    return found


def hopeful(x: np.ndarray, y: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """For each two rows of MinHash values, one of ``x`` and one of ``y``, whether they leave a chance of reaching the threshold: compared step by step, and after a step only where pairs are left."""
    matches = np.zeros((len(x), len(y)), dtype=np.int16)
    rows, columns, done = np.arange(len(x)), np.arange(len(y)), 0
    alive = np.ones((len(x), len(y)), dtype=bool)
    for k, least in limits:
        part = np.zeros((len(rows), len(columns)), dtype=np.int16)
        for v in range(done, k):
            part += x[rows, v][:, None] == y[columns, v][None, :]
        done, at = k, np.ix_(rows, columns)
        matches[at] += part
        alive[at] &= matches[at] >= least
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            break
    return alive


def close_pairs(x: list[np.ndarray], y: list[np.ndarray], values: list[np.ndarray], search: Search, itself: bool = False) -> np.ndarray:
    """similar() for the pairs that hopeful() leaves."""
    alive = hopeful(values[0], values[1], least_matches(search))
    if itself:
        np.fill_diagonal(alive, False)
    rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    found = np.zeros((len(x), len(y)), dtype=bool)
    if len(rows):
        found[np.ix_(rows, columns)] = similar([x[k] for k in rows], [y[k] for k in columns], search.threshold)
    return found & alive


def _sides(table: pa.Table) -> tuple[bool, list[np.ndarray], list[list[np.ndarray]], list[np.ndarray]]:
    """Whether a block meets itself, the rows of both blocks in the table, their sets and their MinHash values."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    block = table.column("block").to_numpy()
    sets = [np.frombuffer(g, dtype=np.uint64) for g in table.column("grams").to_pylist()]
    rows = [np.flatnonzero(block == b) for b in (i, j)]
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), dtype=np.uint32).reshape(len(sets), -1)
    return i == j, rows, [[sets[k] for k in r] for r in rows], [values[r] for r in rows]


def _bridges(left: DataFrame, docs: DataFrame, nodes: DataFrame, search: Search) -> DataFrame:
    """Links (a, b) that join the components of large buckets' members: in each block pair as many as it takes."""
    weight = left.groupBy("node").agg(F.count("*").alias("weight"))
    leads = left.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("group"))
    placed = materialize(dealt_join(left, leads, "bucket", "node").select("group", "node", "label").distinct(), "placed")
    groups = placed.join(_grams(docs, nodes, placed.select("node").distinct(), search), "node")

    def work(table: pa.Table) -> pa.Table:
        one_thread()
        itself, rows, (x, y), values = _sides(table)
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        found: list[tuple[int, int]] = []
        if len(np.unique(label)) > 1:
            lead = {v: v for v in label.tolist()}

            def top(v: int) -> int:
                while lead[v] != v:
                    lead[v] = v = lead[lead[v]]
                return v

            close = close_pairs(x, y, values, search, itself) & (label[rows[0]][:, None] != label[rows[1]][None, :])
            for a, b in zip(*(r[k].tolist() for r, k in zip(rows, np.nonzero(close), strict=True)), strict=True):
                if (p := top(int(label[a]))) != (q := top(int(label[b]))):
                    lead[p] = q
                    found.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return _block_pairs(groups, placed, search).groupBy("group", "i", "j").applyInArrow(work, "a bigint, b bigint").distinct()


def degrees(edges: DataFrame, labels: DataFrame, docs: DataFrame, nodes: DataFrame, search: Search) -> DataFrame:
    """node, n_links: how many other nodes are at the threshold or above. All of them are in the node's class."""
    met = dealt_join(edges, labels.withColumnRenamed("node", "a"), "a", "b").groupBy("label").agg(F.count("*").alias("met"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).join(met, "label")
    placed = materialize(dealt_join(labels, sizes, "label", "node").select("label", "node", "n", (F.col("met") * 2 == F.col("n") * (F.col("n") - 1)).alias("whole")), "members")
    some = placed.filter("NOT whole").select(F.col("label").alias("group"), "node")
    groups = some.join(_grams(docs, nodes, some.select("node"), search), "node")

    def work(table: pa.Table) -> pa.Table:
        one_thread()
        itself, rows, (x, y), values = _sides(table)
        close, node = close_pairs(x, y, values, search, itself), table.column("node").to_numpy()
        n = [close.sum(axis=1)] if itself else [close.sum(axis=1), close.sum(axis=0)]
        return pa.table({"node": pa.array(np.concatenate([node[r] for r, _ in zip(rows, n)])), "n": pa.array(np.concatenate(n).astype(np.int64))})

    counted = _block_pairs(groups, some, search).groupBy("group", "i", "j").applyInArrow(work, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n_links"))
    return materialize(placed.filter("whole").select("node", (F.col("n") - 1).alias("n_links")).unionByName(counted), "degrees")


def _apart(shared: DataFrame, labels: DataFrame, search: Search) -> DataFrame:
    """bucket, node, label of the large buckets whose members lie in several components."""
    large = shared.filter(F.col("size") > search.small).select("bucket", "node")
    placed = large.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return dealt_join(placed, mixed.select("bucket"), "bucket", "node", counted=large)


def links(docs: DataFrame, nodes: DataFrame, search: Search = Search()) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes that connect each class, and the components (node, label) of the linked ones."""
    shared = materialize(_shared(materialize(_deal(nodes, search), "dealt")), "buckets")
    pairs = materialize(_prune(materialize(_pairs(shared, search), "candidates"), nodes, search), "pairs")
    edges = materialize(_verify(pairs, docs, nodes, search), "edges")
    labels = components(edges)
    left = materialize(_apart(shared, labels, search), "apart")
    if not left.limit(1).count():
        return edges, labels
    edges = materialize(edges.union(_bridges(left, docs, nodes, search)), "edges")
    return edges, components(edges)


def classes(docs: DataFrame, search: Search = Search()) -> DataFrame:
    """doc_id, key, class_id, n_links, keeper: the class of each row; ``keeper`` marks the rows equal to the class's first."""
    bound_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    signed, nodes = text_nodes(keyed, search)
    edges, labels = links(keyed, nodes, search)
    placed = labels.join(degrees(edges, labels, keyed, nodes, search), "node", "left")
    known = nodes.select("node", "digest").join(placed, "node", "left").select("digest", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    rows = materialize(dealt_join(signed, known, "digest", "key").drop("digest"), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    leads = rows.groupBy("label").agg(first.alias("first")).select("label", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"))
    return dealt_join(rows, leads, "label", "key").select("doc_id", "key", "class_id", "n_links", (F.col("key") == F.col("first_key")).alias("keeper"))


def dedup(docs: DataFrame, search: Search = Search()) -> DataFrame:
    """One document of each class: the one with the smallest doc_id. Columns as in ``docs``, whatever their names."""
    keepers = classes(docs, search).filter("keeper").select("key").distinct()
    own = [F.col(f"d{place(docs, x)}") for x in ("doc_id", "text")]
    keyed = plain(docs).withColumn("key", row_key(own[0], F.coalesce(own[1], F.lit(""))))
    return restored(keyed.join(keepers, "key").dropDuplicates(["key"]), docs)
