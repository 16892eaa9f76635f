"""Hard-negative mining with angular triangle filtering: stored angles to reference directions bound every score before it is computed.

Components become integers, so scores are exact. Each row keeps its norm and its angles to a few reference directions. For an anchor a and a row v the
triangle inequality on the sphere bounds their angle for every reference r: it is at least |angle(a, r) - angle(v, r)| and at most angle(a, r) + angle(v, r), and
2 pi less that sum. Cosines of the bounds times the norms, widened by more than all rounding, give score bounds.
They hold for any directions; which ones are taken (far apart, from a sample of at most ``sample_rows`` rows) decides only how much is skipped.

Rows are ordered by label, nearest reference and angle, and packed in blocks of groups. Anchor blocks meet row blocks in a shuffled equi join on
cells, each anchor block once with every row block; no block passes through the driver. In a pair of blocks, bounds of whole groups (intervals of angles and norms) are looked at first, then those
of their rows; only anchors and rows whose window overlaps get integer products.

1. Positives: the window is what can reach the least score that enough rows of the label are sure of. Best of each pair of blocks, then best of all.
2. Negatives: the windows are low..high percent of the positives' scores.

Rows with a null label or id, a null vector, or a null or non-finite component take no part. Vectors of other lengths are filled up with zeros. Components are held within
+-sqrt(2**55 / dimensions), so that every score and 95 times it fit 64 bits. Equal scores go by smaller vec_id; repeated rows are rows of their own: each one can be a positive or a negative, and each
repeated anchor gets its own results. A zero vector scores 0 with everything. An empty table, or one without anchors or labels shared, gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm.common import bounded_batches, materialize, one_thread, remove_table, write_table


@dataclass(frozen=True)
class Config:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score
    high: int = 95
    scale: int = 256
    references: int = 8
    sample_rows: int = 4096
    #: Integers in a block of rows, and rows in a group.
    block_values: int = 1 << 19
    group: int = 256
    anchors: int = 512


#: More than what rounding of angles (32-bit floats, and arccos near its ends) adds up to, in radians.
SLACK = 4e-6
#: Products of floats are exact while scores stay below this.
EXACT = 1 << 52

ROWS = "row bigint, vec_id bigint, label bigint, anchor boolean, home int, near float, angles binary, vector binary"
BLOCKS = "block bigint, n int, cell int, vec_ids binary, labels binary, rows binary, norms binary, angles binary, kind string, vectors binary"


# -- bounds


def choose_references(sample: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` unit directions: the mean direction first, then always the row farthest from those chosen."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units) or not n:
        return np.zeros((0, sample.shape[1]))
    mean = units.mean(axis=0)
    first = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else units[0]
    chosen, nearest = [first], units @ first
    while len(chosen) < n:
        k = int(np.argmin(nearest))
        if nearest[k] > 1 - 1e-9:
            break
        chosen.append(units[k])
        nearest = np.maximum(nearest, units @ units[k])
    return np.stack(chosen)


def angles_to(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of integer vectors to unit directions; a right angle for a zero vector, whose bounds are 0 by its norm."""
    v = vectors.astype(np.float64)
    norms = np.linalg.norm(v, axis=1)
    cosines = (v / np.maximum(norms, 1e-300)[:, None]) @ references.T
    return np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def score_bounds(low_angle: np.ndarray, high_angle: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score for angles within a range and products of norms within [least, most]."""
    upper = np.cos(np.maximum(low_angle - SLACK, 0))
    lower = np.cos(np.minimum(high_angle + SLACK, math.pi))
    spare = most * 1e-9 + 1e-3
    return np.where(lower >= 0, lower * least, lower * most) - spare, np.where(upper >= 0, upper * most, upper * least) + spare


def angle_range(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the angles between anchors with angles ``a`` (m, R) and rows with angles in [low, high] (g, R)."""
    m, g = len(a), len(low)
    least, most = np.zeros((m, g), dtype=np.float32), np.full((m, g), math.pi, dtype=np.float32)
    for r in range(a.shape[1]):
        x = a[:, r, None]
        np.maximum(least, low[None, :, r] - x, out=least)
        np.maximum(least, x - high[None, :, r], out=least)
        np.minimum(most, x + high[None, :, r], out=most)
        np.minimum(most, np.float32(2 * math.pi) - x - low[None, :, r], out=most)
    return least, most


# -- blocks


def pack_ints(x: np.ndarray) -> tuple[str, bytes]:
    """A matrix of integers in the narrowest kind that holds it."""
    most = int(np.abs(x).max()) if x.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


class Block:
    """Rows of a packed block, with bounds of its groups."""

    def __init__(self, row: dict, dimensions: int, group: int):
        self.ids, self.labels, self.rows = (np.frombuffer(row[x], "<i8") for x in ("vec_ids", "labels", "rows"))
        self.norms = np.frombuffer(row["norms"], "<f8")
        n = len(self.ids)
        self.angles = np.frombuffer(row["angles"], "<f4").reshape(n, -1)
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, dimensions)
        self.group = group
        self.starts = np.arange(0, n, group)
        self.by_id = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")

    def part(self, first: int, last: int) -> Block:
        """The rows [first, last), in groups of their own."""
        out = object.__new__(Block)
        for x in ("ids", "labels", "rows", "norms", "angles", "vectors"):
            setattr(out, x, getattr(self, x)[first:last])
        out.group, out.starts = self.group, np.arange(0, last - first, self.group)
        out.by_id = np.argsort(np.argsort(out.ids, kind="stable"), kind="stable")
        return out

    def group_bounds(self, a: Block) -> tuple[np.ndarray, np.ndarray]:
        """Score bounds of anchors and groups."""
        low, high = np.minimum.reduceat(self.angles, self.starts, axis=0), np.maximum.reduceat(self.angles, self.starts, axis=0)
        least, most = np.minimum.reduceat(self.norms, self.starts), np.maximum.reduceat(self.norms, self.starts)
        return score_bounds(*angle_range(a.angles, low, high), a.norms[:, None] * least, a.norms[:, None] * most)

    def windowed(self, a: Block, low: np.ndarray, high: np.ndarray, counter: dict | None = None, bounds: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, rows and exact scores of all pairs whose bounds overlap the anchors' windows [low, high]."""
        lower, upper = bounds or self.group_bounds(a)
        meets = (upper >= low[:, None]) & (lower <= high[:, None])
        found = []
        for g in np.flatnonzero(meets.any(axis=0)):
            mine = np.flatnonzero(meets[:, g])
            rows = slice(self.starts[g], self.starts[g] + self.group)
            norms = a.norms[mine][:, None] * self.norms[rows][None, :]
            own_low, own_high = score_bounds(*angle_range(a.angles[mine], self.angles[rows], self.angles[rows]), norms, norms)
            close = (own_high >= low[mine, None]) & (own_low <= high[mine, None])
            some, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            if not len(some):
                continue
            scores = products(a.vectors[mine[some]], self.vectors[rows][columns], norms.max())
            i, j = np.nonzero(close[np.ix_(some, columns)] & (scores >= low[mine[some], None]) & (scores <= high[mine[some], None]))
            found.append((mine[some[i]], self.starts[g] + columns[j], scores[i, j]))
            if counter is not None:
                counter["scored"] = counter.get("scored", 0) + int(close.sum())
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def products(a: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; ``most`` bounds the products of norms."""
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ v.astype(np.int64).T


def best_first(anchor: np.ndarray, score: np.ndarray, by_id: np.ndarray, n_rows: int) -> np.ndarray:
    """Order by anchor, then higher scores, then smaller ids."""
    if len(score) and np.abs(score).max() < (1 << 61) // max(1, n_rows) // max(1, int(anchor.max()) + 1) // 4:
        span = int(np.abs(score).max()) * 2 + 1  # one key of 64 bits
        return np.argsort((anchor * span + (span // 2 - score)) * n_rows + by_id)
    return np.lexsort((by_id, -score, anchor))


def positives_of(a: Block, v: Block, k: int, counter: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor the ``k`` best other rows of its label in ``v``: anchors, rows, scores. Both are ordered by label."""
    found = []
    for label in np.intersect1d(a.labels, v.labels):
        a0, a1 = np.searchsorted(a.labels, [label, label + 1])
        v0, v1 = np.searchsorted(v.labels, [label, label + 1])
        one, other = a.part(a0, a1), v.part(v0, v1)
        lower, upper = other.group_bounds(one)
        sizes = np.diff(np.append(other.starts, v1 - v0))
        # Enough rows (the anchor may be one of them) have at least this score.
        order = np.argsort(-lower, axis=1)
        enough = np.cumsum(sizes[order], axis=1) > k
        sure = np.take_along_axis(lower, order, axis=1)[np.arange(len(lower)), np.argmax(enough, axis=1)]
        sure = np.where(enough[:, -1], np.floor(sure), -np.inf)
        i, j, s = other.windowed(one, sure, np.full(len(sure), np.inf), counter, (lower, upper))
        mine = one.rows[i] != other.rows[j]
        i, j, s = i[mine], j[mine], s[mine]
        order = best_first(i, s, other.by_id[j], v1 - v0)
        i, j, s = i[order], j[order], s[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        found.append((i[first] + a0, j[first] + v0, s[first]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def negatives_of(a: Block, v: Block, low: np.ndarray, high: np.ndarray, k: int, counter: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of ``v`` with another label in each window [low, high] (anchors, windows; low above high: none): anchors, windows, rows, scores."""
    there = low <= high
    least, most = np.where(there, low, np.iinfo(np.int64).max).min(axis=1), np.where(there, high, np.iinfo(np.int64).min).max(axis=1)
    i, j, s = v.windowed(a, least.astype(np.float64), most.astype(np.float64), counter)
    other = a.labels[i] != v.labels[j]
    i, j, s = i[other], j[other], s[other]
    order = best_first(i, s, v.by_id[j], len(v.ids))
    i, j, s = i[order], j[order], s[order]
    # The first row at or below each window's high end: its place among the anchor's rows, by bisection for all windows at once.
    begin, end = np.searchsorted(i, np.arange(len(a.ids))), np.searchsorted(i, np.arange(len(a.ids)), side="right")
    lo, hi = np.repeat(begin[:, None], low.shape[1], axis=1), np.repeat(end[:, None], low.shape[1], axis=1)
    last = np.append(s, 0)
    while (lo < hi).any():
        mid = lo + hi >> 1
        above = (lo < hi) & (last[mid] > high)
        hi = np.where((lo < hi) & ~above, mid, hi)
        lo = np.where(above, mid + 1, lo)
    at = lo[:, :, None] + np.arange(k)
    fits = (at < end[:, None, None]) & there[:, :, None]
    fits &= last[np.minimum(at, len(s))] >= low[:, :, None]
    anchor, window, _ = np.nonzero(fits)
    at = at[fits]
    return anchor, window, j[at], s[at]


# -- Spark


def _measured(rows: DataFrame, references: np.ndarray, dimensions: int) -> DataFrame:
    """Valid rows with their angles, and a number of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        step = max(1, (1 << 21) // max(1, dimensions))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                n, column = batch.num_rows, batch.column("vector")
                sizes = column.value_lengths().to_numpy().astype(np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                vectors = np.zeros((n, dimensions), dtype=np.int64)
                vectors[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                angles = angles_to(vectors, references)
                home = np.argmin(angles, axis=1) if angles.shape[1] else np.zeros(n, dtype=np.int64)
                near = angles[np.arange(n), home] if angles.shape[1] else np.zeros(n, dtype=np.float32)
                packed = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (angles, vectors.astype("<i8"))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("vec_id"), batch.column("label"), batch.column("anchor"), pa.array(home.astype(np.int32)), pa.array(near), *packed],
                    names=["row", "vec_id", "label", "anchor", "home", "near", "angles", "vector"],
                )
                row += n

    return rows.mapInArrow(work, ROWS)


def _blocks(rows: DataFrame, dimensions: int, size: int, partitions: int, cells: int) -> DataFrame:
    """Rows in the order of label, nearest reference and angle, packed in blocks of at most ``size``."""
    ordered = rows.repartitionByRange(partitions, "label", "home", "near", "vec_id", "row").sortWithinPartitions("label", "home", "near", "vec_id", "row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, waiting, n = TaskContext.get().partitionId() << 32, [], 0

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal block
            vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i8").reshape(-1, dimensions)
            kind, packed = pack_ints(vectors)
            norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
            parts = [table.column(x).to_numpy().astype("<i8").tobytes() for x in ("vec_id", "label", "row")]
            # Blocks are dealt to cells in turn, with a start that differs by partition.
            row = [block, len(vectors), (block % (1 << 32) + (block >> 32) * 7919) % cells, *parts, norms.tobytes(), b"".join(table.column("angles").to_pylist()), kind, packed]
            block += 1
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BLOCKS.split(", ")])
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(waiting)
                yield close(table.slice(0, size))
                waiting, n = table.slice(size).to_batches(), n - size
        if n:
            yield close(pa.Table.from_batches(waiting))

    return ordered.mapInArrow(work, BLOCKS)


def _sample(rows: DataFrame, n_rows: int, most: int) -> list[list[int]]:
    """About ``most`` vectors, never more, by their hashes. Of a long table only rows with hashes in a small range are looked at, so that each task doesn't send ``most`` of them to the driver."""
    parts = 1 << 20
    if n_rows > 2 * most:
        rows = rows.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)) < -(-2 * most * parts // n_rows))
    return [r.vector for r in rows.orderBy(F.xxhash64("vec_id", "vector")).select("vector").limit(most).collect()]


def mine(vectors: DataFrame, is_anchor: Column, config: Config = Config()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, embedding, label) where ``is_anchor`` holds."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * config.scale))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), whole.alias("vector"))
    n_rows, n_anchors, dimensions = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    dimensions = max(1, dimensions or 0)
    limit = math.isqrt((1 << 55) // dimensions)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))
    # A bounded sample of rows, to choose directions from.
    sample = _sample(rows, n_rows, min(config.sample_rows, max(64, config.block_values // dimensions))) if config.references else []
    references = choose_references(np.array([[*x, *[0] * (dimensions - len(x))] for x in sample], dtype=np.float64).reshape(-1, dimensions), config.references)
    one, made = Config(**vars(config)), []
    size = max(64, config.block_values // dimensions)
    n_blocks = -(-n_rows // size)
    # Small tables are spread, in large ones some eight blocks share the copies of the anchor blocks.
    cells = max(min(n_blocks, 64), n_blocks // 8, 1)

    def written(df: DataFrame, label: str) -> DataFrame:
        table, path = write_table(df, label)
        made.append(path)
        return table

    with bounded_batches(spark):
        measured = written(_measured(rows, references, dimensions), "vectors")
        blocks = written(_blocks(measured, dimensions, size, max(1, -(-n_blocks // 4), min(n_blocks, 16)), cells), "blocks")
        anchors = written(_blocks(measured.filter("anchor"), dimensions, one.anchors, max(1, -(-n_anchors // one.anchors)), 1), "anchors")
        own = blocks.select("cell", *[F.col(x).alias("v_" + x) for x in blocks.columns if x != "cell"])

        def met(these: DataFrame) -> DataFrame:
            # Spark takes the copies of the anchor blocks for as small as one, and would send them all through the driver. More tasks than cells, so that few have several.
            spread = these.drop("cell").select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
            return spread.repartition(2 * cells, "cell").hint("merge").join(own.repartition(2 * cells, "cell"), "cell")

        def pairs(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block, Block]]:
            for row in batch.to_pylist():
                yield row, Block(row, dimensions, one.group), Block({x[2:]: y for x, y in row.items() if x[:2] == "v_"}, dimensions, one.group)

        def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for batch in batches:
                for row, a, v in pairs(batch):
                    i, j, s = positives_of(a, v, one.positives)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["block"])), pa.array(i), pa.array(v.ids[j]), pa.array(s)], names=["block", "at", "positive_id", "score"])

        found = met(anchors).mapInArrow(find_positives, "block bigint, at bigint, positive_id bigint, score bigint")
        best = Window.partitionBy("block", "at").orderBy(F.desc("score"), "positive_id")
        positives = written(found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= one.positives), "positives")
        # At most ``anchors`` times ``positives`` rows a block.
        known = positives.groupBy("block").agg(F.collect_list(F.struct("at", "k", "positive_id", "score")).alias("known"))

        def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            for batch in batches:
                for row, a, v in pairs(batch):
                    at, k, ids, scores = (np.array([x[y] for x in row["known"]], dtype=np.int64) for y in ("at", "k", "positive_id", "score"))
                    low, high = np.ones((len(a.ids), one.positives), dtype=np.int64), np.zeros((len(a.ids), one.positives), dtype=np.int64)
                    positive, score = low.copy(), low.copy()
                    low[at, k - 1], high[at, k - 1] = -(-one.low * scores // 100), one.high * scores // 100
                    positive[at, k - 1], score[at, k - 1] = ids, scores
                    i, w, j, s = negatives_of(a, v, low, high, one.negatives)
                    if len(i):
                        columns = [a.rows[i], w, a.ids[i], positive[i, w], score[i, w], v.ids[j], s]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "window", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        found = met(anchors.join(known.hint("merge"), "block")).mapInArrow(find_negatives, "row bigint, window bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
        best = Window.partitionBy("row", "window").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= one.negatives)
        out = materialize(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for path in made:
        remove_table(spark, path)
    return out


def oracle_sql() -> str:
    """The mining of the embeddings table in DuckDB SQL."""
    return """
WITH valid AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.r AS a, o.r AS o, a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
    FROM valid a JOIN valid o ON a.r <> o.r WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.o ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.o ORDER BY n.score DESC, n.vec_id) <= 3
"""
