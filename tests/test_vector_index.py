"""The vector index: recall against brute force, every row indexed, nulls, zeros and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import vector_index as V
from lexmill.plans import catalog
from lexmill.sources import tables as S

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_recall(spark, sf):
    got = {}
    for r in catalog.QUERIES["vector_index_search"](spark, sf).collect():
        got.setdefault(r["query"], set()).add(r.vec_id)
    rows = S.table(spark, sf, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), V.unit(np.array([r.embedding for r in rows], dtype=float))
    asked = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    assert sorted(got) == sorted(int(ids[i]) for i in asked)
    hits = []
    for i in asked:
        like = x @ x[i]
        like[i] = -2
        hits += [int(j) in got[int(ids[i])] for j in ids[np.argsort(-like)[:10]]]
    assert np.mean(hits) >= 0.9


def test_all_cells_are_exact_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [1.0, 0.0, 0.0, 0.0]), (63, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    centres = V.fit(df, "vec_id", "embedding", cells=5)
    index = V.build(df, "vec_id", "embedding", centres)
    assert sorted(r.vec_id for r in index.collect()) == [i for i in range(64) if i != 60]
    asked = df.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = {(r["query"], r.place): r for r in V.search(index, asked, "vec_id", "embedding", centres, 3, len(centres)).collect()}
    assert len(found) == 63 * 3 and found[(62, 1)].vec_id == 63 and found[(61, 1)].similarity == 0
    x = {i: V.unit(np.array([v]))[0] for i, v in rows if v}
    for i in x:
        best = max(x[i] @ x[j] for j in x if j != i)
        assert abs(found[(i, 1)].similarity - best) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    centres = V.fit(df, "vec_id", "embedding")
    assert V.build(df, "vec_id", "embedding", centres).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query long, vector array<double>")
    assert V.search(V.build(df, "vec_id", "embedding", centres), asked, "vec_id", "embedding", centres, 3, V.probes(centres)).count() == 0


def test_cells_are_compared_in_blocks():
    """A cell larger than a block: the same rows as a sort of all; equal vectors by key, a query not with itself."""
    import pyarrow as pa

    rows = np.random.default_rng(2).normal(size=(9000, 8))
    rows[5000:] = rows[:4000]
    table = lambda name, ids: pa.table({name: pa.array(ids), "vector": pa.array([rows[i].tolist() for i in ids])})
    got = V.alike_of(table("query", list(range(300))), table("key", list(range(9000))), 3).to_pandas()
    sized = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for q in (0, 255, 299):
        like = np.round(sized @ sized[q], 12)
        order = [i for i in np.lexsort((np.arange(9000), -like)) if i != q][:3]
        assert got[got["query"] == q]["key"].tolist() == order and order[0] == q + 5000
