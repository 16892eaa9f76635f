"""Lexical search, packing and hard negatives beside brute force, on odd rows and as properties."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("pagewarden.llm")
from pyspark.sql import functions as F  # noqa: E402

from pagewarden.llm import common, negatives, packing, search, tokenstore  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string"
#: Every name that the operators make on the way.
NAMES = "anchor anchors angles at before block cell docs home k kind known label_ labels length local n n_docs n_in n_terms near negative_id norms nulls number offset part piece positive_id rank row rows score sequence_id sizes start starts term_ids times v_block vector window".split()


def with_names(df):
    return df.withColumns({x: F.lit("mine") for x in NAMES})


# -- packing


def places(counts, capacity):
    """All pieces by sequence, from the plan."""
    plan = packing.Plan(counts, capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    for length, n in counts.items():
        s, o = plan.place(np.full(n, length), np.arange(n))
        for x, y in zip(s.tolist(), o.tolist()):
            bins.setdefault(x, []).append((y, length))
    return plan, bins


@pytest.mark.parametrize("seed", range(12))
def test_bins_hold_every_piece_once_without_gaps(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100, 4096])
    counts = dict(Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.choice([1, 30, 3000]))))
    plan, bins = places(counts, capacity)
    assert sorted(length for rows in bins.values() for _, length in rows) == sorted(x for x, n in counts.items() for _ in range(n))
    assert sorted(bins) == list(range(plan.n_sequences))
    for rows in bins.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= capacity
    least = max(-(-sum(x * n for x, n in counts.items()) // capacity), sum(n for x, n in counts.items() if 2 * x > capacity))
    assert least <= plan.n_sequences <= least + 2


def test_each_bin_is_the_fullest_one():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9)))
        longest = max(counts)
        rest = list((counts - Counter([longest])).elements())
        best = max(s for mask in range(1 << len(rest)) if (s := longest + sum(x for k, x in enumerate(rest) if mask >> k & 1)) <= capacity)
        taken = packing.fullest(longest, dict(counts), capacity)
        assert sum(x * n for x, n in taken.items()) == best and taken[longest] >= 1 and not Counter(taken) - counts


def test_repeated_combinations_equal_bin_after_bin():
    rng = random.Random(6)
    counts = Counter(rng.choice([3, 5, 7, 11, 20]) for _ in range(200))
    left, bins = dict(counts), []
    while left:
        taken = packing.fullest(max(left), left, 50)
        bins.append(sorted(taken.items()))
        left = {x: n - taken.get(x, 0) for x, n in left.items() if n > taken.get(x, 0)}
    assert [sorted(t.items()) for t, times in packing.fill_bins(dict(counts), 50) for _ in range(times)] == bins


def test_pack_equals_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 40_000)
    rng = random.Random(7)
    texts = [None, "", " \n", "one", "x" * 9_000, " ".join(f"w{rng.randrange(900)}" for _ in range(30_000)), "a b\tc\n" * 5_000]
    texts += [" ".join(rng.choice(["alpha", "beta", "Gamma", "ñandú", "42"]) for _ in range(rng.randrange(1, 3000))) for _ in range(60)] + ["copy of a text"] * 5
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (None, "no id")]
    got = packing.pack(with_names(spark.createDataFrame(rows, DOCS).repartition(5)), WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = []
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, p, p * 4096, len(x), zlib.crc32(x.tobytes())) for p, x in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows_ in bins.values():
        ends = np.cumsum([x[1] for x in sorted(rows_)])
        assert [x[0] for x in sorted(rows_)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    least = max(-(-sum(r.length for r in got) // 4096), sum(2 * r.length > 4096 for r in got))
    assert len(bins) <= least + 2
    empty = packing.pack(spark.createDataFrame([], DOCS), WORD_BPE)
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_encoder_gives_the_same_ids_with_and_without_its_cache():
    encoder = tokenstore.ChunkEncoder(tokenstore.vocabulary_encoder(WORD_BPE), most=50)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(40)).encode() for _ in range(30)]
    once = [encoder([t])[0].tolist() for t in texts]
    assert once == [encoder([t])[0].tolist() for t in texts] and once == [x.tolist() for x in np.split(*(lambda i, c: (i, np.cumsum(c)[:-1]))(*encoder(texts)))]


# -- search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    """item place, rank, doc_id, score by definition."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, Counter(TERM.findall((t or "").translate(fold)))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_all, total = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c, n in texts:
            m = 50 + 50 * n * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(fold))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(name, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple(-(1 << 60) if x is None else x for x in r))


@pytest.mark.parametrize("seed", [1, 2])
def test_search_matches_definition(spark, seed, monkeypatch):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    make = lambda n: " ".join(rng.choice(common) if rng.random() < 0.7 else f"r{int(rng.expovariate(0.02))}" for _ in range(n))
    docs = [(k, make(rng.randrange(1, 60))) for k in range(700)] + [(900 + k, "same words here c1 c2") for k in range(70)]
    docs += [(None, "c1 null id"), (2000, None), (2001, ""), (2002, " -- !"), (5, docs[5][1]), (2003, "Ärger C1 ärger x_y"), (2004, "c3 " * 5000)]
    items = [(k, make(rng.randrange(1, 25))) for k in range(12)] + [(20, None), (21, "no such words"), (22, "SAME here"), (22, "C1"), (None, "ärger y")]
    found = search.search(with_names(spark.createDataFrame(docs, DOCS).repartition(3)), spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit(1)), k=20)
    assert order((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()) == order(ranked(docs, items, 20))
    batched = search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), k=20, short=1, query_bytes=300)
    assert order((r.item_id, r["rank"], r.doc_id, r.score) for r in batched.collect()) == order(ranked(docs, items, 20))


@pytest.mark.parametrize("short", [0, 1, 50, 3000, 10**9])
def test_top_of_a_shard_is_exact_and_skips(short):
    rng = np.random.default_rng(4)
    n = 40_000
    n_runs = -(-n // search.RUN)
    lists, total = [], np.zeros(n, dtype=np.int64)
    for size in (5, 40, 300, 2500, 9000, 20000):
        docs = np.sort(rng.choice(n, size, replace=False))
        shares = rng.integers(1, 60_000 // size + 2, size)
        total[docs] += shares
        lists.append(search.Postings(docs, shares, n_runs))
    counter: dict = {}
    best, scores = search.top(lists, n, 10, short, counter)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert best.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    if short == 3000:
        assert counter["alive"] < 3 * n / 4  # of six lists times n places, if nothing were skipped


def test_search_of_empty_tables_and_long_texts(spark, monkeypatch):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert search.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], DOCS)
    assert search.search(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"] and search.search(some, items.filter("false")).count() == 0
    monkeypatch.setattr(search, "SLICE", 100)
    text = b"word " * 500 + b"x" * 300 + b" end"
    assert [t for part in search.slices(text) for t in part] == search.terms_of(text)


# -- hard negatives


def mined(rows, config, every=50):
    """The definition, for rows that take part."""
    valid = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in valid), default=0)
    whole = [np.array([math.floor(config.scale * float(np.float32(x))) for x in v] + [0] * (width - len(v)), dtype=object) for _, v, _ in valid]
    out = []
    for a, (anchor, _, label) in enumerate(valid):
        if anchor % every:
            continue
        scores = [(-int(whole[a] @ w), valid[o][0], o) for o, w in enumerate(whole) if o != a]
        same = sorted(x for x in scores if valid[x[2]][2] == label)[: config.positives]
        others = sorted(x for x in scores if valid[x[2]][2] != label)
        for p in same:
            fits = [x for x in others if config.low * -p[0] <= 100 * -x[0] <= config.high * -p[0]][: config.negatives]
            out += [(anchor, p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n, width, clusters, spread, start=0):
    centres = rng.normal(size=(clusters, width))
    rows = []
    for k in range(n):
        c = k % clusters
        v = centres[c] + spread * rng.normal(size=width)
        rows.append((start + k, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(c if rng.random() < 0.7 else rng.integers(clusters))))
    return rows


@pytest.mark.parametrize("case", ["spread", "clusters", "copies", "odd", "large"])
def test_mining_matches_definition(spark, case):
    rng = np.random.default_rng(3)
    config = negatives.Config(block_values=64 * 16, group=16, anchors=7, references=5)
    rows = vectors(rng, 400, 16, 6, 1.0 if case == "spread" else 0.6)
    if case == "copies":
        rows = rows[:150] + [(1000 + k, rows[0][1], k % 2) for k in range(250)] + [(50, rows[3][1], rows[3][2])]
    if case == "odd":
        nan, inf = float("nan"), float("inf")
        rows = rows[:200] + [(2000, None, 1), (2050, [nan] * 16, 1), (2100, [inf] + [0.0] * 15, 2), (2150, [1.0] * 16, None), (None, [1.0] * 16, 1), (2200, [], 1), (2250, [1.0, 2.0], 1), (2300, [0.0] * 16, 2), (2350, [None] + [1.0] * 15, 1), (-50, [-1.0] * 16, 3)]
    if case == "large":
        rows = [(i, [x * 3e4 for x in v], label) for i, v, label in rows[:200]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({x: F.lit("mine") for x in NAMES})
    got = negatives.mine(df.repartition(3), F.col("vec_id") % 50 == 0, config)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, config) and (case == "odd" or got.count() > 10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_mining_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine(df, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(1, [1.0], 1), (50, [1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert negatives.mine(alone, F.col("vec_id") % 50 == 0).count() == 0


def test_no_blocks_of_vectors_pass_through_the_driver(spark, monkeypatch):
    plans, write = [], common.write_table

    def written(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(negatives, "write_table", written)
    monkeypatch.setattr(common, "write_table", written)  # that of materialize()
    rows = vectors(np.random.default_rng(4), 400, 16, 6, 0.6)
    config = negatives.Config(block_values=64 * 16, group=16, anchors=7, references=5)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, config).collect()) == mined(rows, config)
    assert len(plans) == 5 and sum("SortMergeJoin" in x for x in plans) == 2 and not any("Broadcast" in x for x in plans)


def test_sample_of_a_long_table(spark):
    rows = spark.range(20_000).selectExpr("id vec_id", "array(id, id + 1) vector").repartition(8)
    taken = negatives._sample(rows, 20_000, 100)
    assert len(taken) == len({tuple(x) for x in taken}) == 100 and negatives._sample(rows, 20_000, 100) == taken
    assert len(negatives._sample(rows.limit(150), 150, 100)) == 100 and len(negatives._sample(rows.limit(50), 50, 100)) == 50


def block(ids, labels, v, references):
    kind, packed = negatives.pack_ints(v)
    row = {"vec_ids": np.array(ids, "<i8").tobytes(), "labels": np.array(labels, "<i8").tobytes(), "rows": np.array(ids, "<i8").tobytes(), "norms": np.linalg.norm(v.astype(float), axis=1).tobytes(), "angles": negatives.angles_to(v, references).tobytes(), "kind": kind, "vectors": packed}
    return negatives.Block(row, v.shape[1], 32)


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 24))
    v = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(64, 24)) for c in centres])).astype(np.int64)
    v[:3] = v[3]  # equal rows, and a zero one
    v[5] = 0
    references = negatives.choose_references(v.astype(float), 8)
    whole = block(range(len(v)), np.zeros(len(v)), v, references)
    scores = v @ v.T
    low, high = whole.group_bounds(whole)
    group = np.arange(len(v)) // 32
    assert (low[:, group] <= scores).all() and (high[:, group] >= scores).all()
    each = negatives.angle_range(whole.angles, whole.angles, whole.angles)
    norms = whole.norms[:, None] * whole.norms
    low, high = negatives.score_bounds(*each, norms, norms)
    assert (low <= scores).all() and (high >= scores).all()
    counter: dict = {}
    least = np.full(len(v), 0.9 * np.median(np.diag(scores)))
    i, j, s = whole.windowed(whole, least, np.full(len(v), np.inf), counter)
    want = np.nonzero(scores >= least[:, None])
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*[x.tolist() for x in want])) and (s == scores[i, j]).all()
    assert counter["scored"] < scores.size / 3
