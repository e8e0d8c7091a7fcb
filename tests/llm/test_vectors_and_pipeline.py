"""Neighbours against brute force, and the pipeline stage by stage."""

from __future__ import annotations

import sys
from itertools import product
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from rollbook.llm import queries  # noqa: E402
from rollbook.llm.curves import hilbert, nearest  # noqa: E402


def by_loop(rows, k, every):
    own = {i: np.asarray(v, float) for i, v in rows}
    out = {}
    for q in own:
        if q % every == 0:
            scored = []
            for i in own:
                if i != q:
                    s = 0.0
                    for a, b in zip(own[q].tolist(), own[i].tolist()):
                        s += a * b
                    scored.append((-s, i))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def grouped(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_hilbert_moves_one_cell_at_a_time():
    points = np.array(list(product(range(4), repeat=3)))
    keys = hilbert(points, 2)
    assert sorted(keys) == list(range(64))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    want = by_loop([tuple(r) for r in rows], 20, 20)
    assert grouped(queries.op7_hilbert_neighbours(spark, "/root/testdata/sf0.001").collect()) == want


def test_neighbours_edges(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(30, 90)]
    bad = [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 0.0]), (180, [float("nan")] * 4),
           (200, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (220, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, score string, rank string, block string"
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in good + bad + good[:3]], schema)
    assert grouped(nearest(df, lambda c: c % 20 == 0, k=5, block=16, window=4).collect()) == by_loop(good, 5, 20)
    few = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in good[:3]], schema)
    assert grouped(nearest(few, lambda c: c % 20 == 0).collect()) == by_loop(good[:3], 20, 20)
    assert nearest(spark.createDataFrame([], schema), lambda c: c % 20 == 0).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for df in (cases.table(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.materialize(stage(spark, df, "/root/testdata/sf0.001"), "test-stage")
        assert df.count() >= 0
