"""The pipeline beside a brute-force version of its stages, on a small corpus."""

from __future__ import annotations

import random

import numpy as np
import pytest

pytest.importorskip("pagewarden.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pagewarden.llm import decontaminate, jaccard, pieces, quality, secrets  # noqa: E402
from pagewarden.llm.queries import tokenizer_file  # noqa: E402

COMMON = quality.COMMON_WORDS["en"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "q" + "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(60, 200)) for _ in range(60)]
    item = prose(rng, 25)
    for k in range(20):  # near copies, several of one text
        words = texts[k % 7].split()
        words[rng.randrange(len(words))] = f"changed{k}"
        texts.append(" ".join(words))
    texts += [texts[8], prose(rng, 60) + " " + item + " " + prose(rng, 60), prose(rng, 80) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(rng, 30)]
    texts += [None, "", "too short", "&&& ".join(prose(rng, 100).split()), "a b c " * 60, "  two  spaces " + prose(rng, 70)]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, None if k % 17 == 5 else "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def brute_force(folder):
    duckdb = pytest.importorskip("duckdb")
    path, rows, item = folder
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.oracle_sql()}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in good]
    sets = [jaccard.grams(r[1].encode()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if jaccard.jaccard(sets[a], sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [min(old, new) if g in (old, new) else g for g in group]
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    rows = [r for r in rows if not decontaminate.reference_digest(r[1].encode(), [("1", item.encode())])[1]]
    out = {}
    for doc_id, text, *_ in rows:
        covered = {i for a, b, _ in secrets.base_spans(text) for i in range(a, b)}
        out[doc_id] = "".join(("" if i - 1 in covered else "[SECRET]") if i in covered else c for i, c in enumerate(text))
    return out


def test_pipeline(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder[0]).collect()}
    want = brute_force(folder)
    assert set(got) == set(want)
    loaded = pieces.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    place = {int(i): k for k, i in enumerate(loaded.ids)}
    for doc_id, r in got.items():
        assert r.text == want[doc_id] and r.n_chars == len(r.text)
        assert loaded.decode(np.array(r.piece_ids)).decode() == r.text
        if "  " not in r.text and all(i in place for i in r.piece_ids):
            best = sum(pieces.reference("▁" + w, loaded.score_of, loaded.unknown_score) for w in r.text.split(" "))
            assert sum(loaded.scores[place[i]] for i in r.piece_ids) == pytest.approx(best, rel=1e-9)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0
    odd = docs.limit(3).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder[0]).collect()


def test_stages_keep_columns_of_any_name(spark, folder):
    """Names that the stages' operators make themselves come through unchanged."""
    from pyspark.sql import functions as F

    clashing = "kept n_words base_failed q_words r_lang jj_key key node class_id n_hit items spans row base added d0 d1 KEPT2 lead label".split()
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumns({x: F.lit(f"own {x}") for x in clashing})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and rows
        assert all(r[x] == f"own {x}" for r in rows for x in clashing)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
