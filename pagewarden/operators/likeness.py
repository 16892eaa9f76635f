"""Links between the members of two blocks of a bucket, and components of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.sources.tables import dealt_join, hot_keys, remove_table, write_table

#: Word runs that are met at once, as columns of two small matrices.
AT_ONCE = 2048


def _shared_runs(sets: list[np.ndarray]) -> np.ndarray:
    """The number of common hashes of each two sets."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[several] = np.arange(len(several))
    column = column[place.reshape(-1)]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)  # exact below 2**24
    for first in range(0, len(several), AT_ONCE):
        some = (column >= first) & (column < first + AT_ONCE)
        part = np.zeros((len(sets), min(AT_ONCE, len(several) - first)), dtype=np.float32)
        part[owner[some], column[some] - first] = 1
        both += part @ part.T
    return both


def block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Of one band's bucket, two blocks (i, j): page_id with n, its links found here, and page_id with other, links that connect what is linked here.

    Rows have band, own (the block), page_id, keys (a hash a band) and grams (distinct hashes). A pair that shares an earlier band is left to that one.
    """
    pages = table.column("page_id").to_numpy()
    own, band = table.column("own").to_numpy(), table.column("band")[0].as_py()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    keys = np.array(table.column("keys").to_pylist(), dtype=np.int64)
    late = np.ones((len(pages), len(pages)), dtype=bool)
    for b in range(band):
        late &= keys[:, b][:, None] != keys[:, b][None, :]
    late &= pages[:, None] < pages[None, :]
    if i != j:
        late &= own[:, None] != own[None, :]
    n, found = np.zeros(len(pages), dtype=np.int64), []
    if late.any():
        sets = [np.array(x, dtype=np.int64) for x in table.column("grams").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        both = _shared_runs(sets).astype(np.float64)
        close = late & (both / np.maximum(1, sizes[:, None] + sizes[None, :] - both) >= threshold)
        n = close.sum(axis=0) + close.sum(axis=1)
        lead = list(range(len(pages)))
        for a, b in zip(*(x.tolist() for x in np.nonzero(close)), strict=True):
            while lead[a] != a:
                a = lead[a]
            while lead[b] != b:
                b = lead[b]
            if a != b:
                lead[max(a, b)] = min(a, b)
                found.append((int(pages[a]), int(pages[b])))
    some = np.flatnonzero(n)
    rows = [(int(pages[k]), int(n[k]), None) for k in some] + [(a, None, b) for a, b in found]
    return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("page_id", "n", "other"))})


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of links (a, b). Least labels spread along links and by jumps to a label's own label, with a written table each round; the rows of a node with very many links, and of a
    label with very many nodes, are dealt."""
    spark = links.sparkSession
    both, links_path = write_table(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "links")
    hot = hot_keys(both, "other")
    labels, path = write_table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = dealt_join(both, labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other", "node", hot=hot).groupBy("node").agg(F.min("theirs").alias("theirs"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        least = F.least("label", "theirs", "next")
        spread = dealt_join(labels, jump, "label", "node", "left").join(near, "node", "left")
        new, new_path = write_table(spread.select("node", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        remove_table(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not new.filter("moved").limit(1).count():
            remove_table(spark, links_path)
            return labels
