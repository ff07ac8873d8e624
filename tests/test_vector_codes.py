"""Recall of coded search against brute force, and the bytes that it reads."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import vector_codes
from lexmill.plans import catalog
from lexmill.scratch import written


def exact(sf, k):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        like = v @ v[i]
        like[i] = -2
        out[int(ids[i])] = set(ids[np.argsort(-like, kind="stable")[:k]].tolist())
    return out, len(ids), v.shape[1]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_bytes(spark, sf):
    want, n, size = exact(sf, 10)
    found = {}
    for r in catalog.QUERIES["vector_code_search"](spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & own) / 10 for q, own in want.items()]) >= 0.9
    again = max(11, min(vector_codes.MOST, int(vector_codes.AGAIN * n)))
    assert (vector_codes.bytes_of(size) * n + 4 * size * again) / (4 * size * n) <= 0.1


def test_scan_reads_codes_alone(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0, 0.5]) for i in range(300)], "vec_id long, embedding array<double>")
    points = vector_codes.fit(rows, "vec_id", "embedding")
    table = written(vector_codes.encode(rows, "vec_id", "embedding", points).join(rows, "vec_id"), "codes")
    plan = vector_codes.candidates(table, [(0, [1.0, 2.0, 1.0, 0.0])], "vec_id", points, 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,code:binary>" in plan


def test_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    points = vector_codes.fit(rows, "vec_id", "embedding")
    codes = vector_codes.encode(rows, "vec_id", "embedding", points)
    asked = rows.filter("vec_id IN (1, 3, 4)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    got = vector_codes.search(codes, rows, asked, "vec_id", "embedding", points, 2, again=5).collect()
    assert sorted((r["query"], r["place"], r["vec_id"], round(r["similarity"], 3)) for r in got) == [(1, 1, 5, 1.0), (1, 2, 2, 0.994), (4, 1, 1, 0.0), (4, 2, 2, 0.0)]
    empty = rows.limit(0)
    assert vector_codes.search(empty.select("vec_id", F.lit(b"").alias("code")), empty, asked, "vec_id", "embedding", vector_codes.fit(empty, "vec_id", "embedding"), 2).count() == 0


def test_best_codes_in_bounded_memory():
    """2,048 queries over 16,384 codes: a task holds the best codes and one block, and finds what a sort of all likenesses finds."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    chance = np.random.default_rng(1)
    table, code = [chance.random((2048, 256), np.float32) for _ in range(2)], chance.integers(0, 256, (16384, 2)).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(16384)), pa.array([c.tobytes() for c in code])], ["id", "code"])
    tracemalloc.start()
    got = pa.Table.from_batches(vector_codes.best_codes(iter([batch]), np.arange(2048), table, "id", 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6 and len(got) == 2048 * 20
    for q in (0, 255, 256, 2047):
        like = table[0][q][code[:, 0]] + table[1][q][code[:, 1]]
        mine = got.filter(pc.equal(got["query"], q))
        assert np.allclose(np.sort(mine["like"].to_numpy()), np.sort(like)[-20:]) and np.allclose(like[mine["id"].to_numpy()], mine["like"].to_numpy())
    assert sum(map(len, vector_codes.best_codes(iter([batch.slice(0, 7)]), np.arange(3), [t[:3] for t in table], "id", 20))) == 21
