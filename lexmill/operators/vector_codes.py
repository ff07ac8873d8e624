"""Product-quantised vectors: codes of a few bytes are scanned whole, and the best few are compared exactly.

A vector, scaled to length 1, is cut into runs of dimensions; each run is named by the nearest of 256 points that k-means found for it on a bounded
sample. A query's products with all points make a table, and a code's likeness is the sum of its table entries. The codes are a table apart
from the vectors: a scan reads `bytes_of` bytes a vector, and the vectors of `again` candidates a query alone. Every row has a code; a vector of zeros is
unlike all others (0), a null one isn't indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector_index import unit

#: Rows that points are fitted on, at most; points of a run; rounds of the fit.
SAMPLE, POINTS, ROUNDS = 20_000, 256, 15
#: The share of a vector's bytes that its code takes, and of all vectors that are compared exactly, which are MOST at most.
SHARE, AGAIN, MOST = 0.047, 0.05, 400
#: Queries of one pass over the codes; queries and codes that a task compares at once.
PASS, ASKED, CODES = 2048, 256, 4096


def bytes_of(dimensions: int, width: int = 4) -> int:
    """Bytes of a code: SHARE of a vector's (width bytes a dimension), one at least, one a dimension at most."""
    return max(1, min(dimensions, int(dimensions * width * SHARE)))


def fit(vectors: DataFrame, key: str, embedding: str, sample: int = SAMPLE) -> list[np.ndarray]:
    """For each run of dimensions its points, fitted on the rows of the least key hashes, sample of them at most; empty without rows."""
    picked = vectors.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(embedding).collect()
    if not picked:
        return []
    rows = unit(np.array([r[0] for r in picked], dtype=np.float64))
    return [points_of(rows[:, own]) for own in np.array_split(np.arange(rows.shape[1]), bytes_of(rows.shape[1]))]


def points_of(rows: np.ndarray) -> np.ndarray:
    """k-means from evenly chosen rows."""
    k = min(POINTS, len(rows))
    points = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(rows, points)
        sums, full = np.zeros_like(points), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        points[full > 0] = sums[full > 0] / full[full > 0, None]
    return points


def nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return ((points**2).sum(axis=1) - 2 * rows @ points.T).argmin(axis=1)


def cuts_of(points: list[np.ndarray]) -> list[int]:
    return np.cumsum([0, *(p.shape[1] for p in points)]).tolist()


def encode(vectors: DataFrame, key: str, embedding: str, points: list[np.ndarray]) -> DataFrame:
    """key, code of every row that has a vector: to be written as a table of its own."""

    @F.pandas_udf(T.BinaryType())
    def codes(own: pd.Series) -> pd.Series:
        rows, cuts = unit(np.stack(own.to_list()).astype(np.float64)), cuts_of(points)
        out = np.stack([nearest(rows[:, lo:hi], p) for p, lo, hi in zip(points, cuts, cuts[1:])], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    return vectors.filter(F.col(embedding).isNotNull()).select(key, codes(F.col(embedding)).alias("code"))


def best_codes(batches: Iterator[pa.RecordBatch], names: np.ndarray, table: list[np.ndarray], key: str, again: int) -> Iterator[pa.RecordBatch]:
    """query, key, like: the `again` best of all codes for each of the queries (names), whose products with the points are in table."""
    # The best so far of each query, and beside them room for the next codes of a block of queries.
    keys, likes, n = np.zeros((len(names), again), np.int64), np.full((len(names), again), -np.inf, np.float32), 0
    for batch in batches:
        for at in range(0, len(batch), CODES):
            part = batch.slice(at, CODES)
            code = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(part), -1)
            own = part[key].to_numpy()
            n += len(own)
            for q in range(0, len(names), ASKED):
                rows = slice(q, q + ASKED)
                like = np.zeros((len(names[rows]), len(own)), np.float32)
                for j, t in enumerate(table):
                    like += t[rows][:, code[:, j]]
                all_likes = np.concatenate([likes[rows], like], axis=1)
                best = np.argpartition(-all_likes, again - 1, axis=1)[:, :again]
                likes[rows] = np.take_along_axis(all_likes, best, 1)
                keys[rows] = np.where(best < again, np.take_along_axis(keys[rows], np.minimum(best, again - 1), 1), own[np.maximum(best - again, 0)])
    for q in range(0, len(names) if n else 0, ASKED):
        rows = slice(q, q + ASKED)
        have = likes[rows] > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[rows, None], have.shape)[have]), pa.array(keys[rows][have]), pa.array(likes[rows][have])], ["query", key, "like"])


def candidates(codes: DataFrame, asked: list[tuple[int, list[float]]], key: str, points: list[np.ndarray], again: int) -> DataFrame:
    """query, key of the `again` codes most like each asked (query, vector): each task keeps that many a query before they meet."""
    cuts = cuts_of(points)
    vectors = unit(np.array([v for _, v in asked], dtype=np.float64))
    table = [(vectors[:, lo:hi] @ p.T).astype(np.float32) for p, lo, hi in zip(points, cuts, cuts[1:])]
    names = np.array([q for q, _ in asked], dtype=np.int64)

    best = codes.select(F.col(key).cast("long"), "code").mapInArrow(lambda batches: best_codes(batches, names, table, key, again), f"query long, {key} long, like float")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("like"), key))
    return best.withColumn("at", place).filter(F.col("at") <= again).select("query", key)


def search(codes: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, embedding: str, points: list[np.ndarray], k: int, again: int | None = None) -> DataFrame:
    """query, key, place, similarity: the k vectors most alike to each query (query, vector), itself left out. again: how many of the nearest codes are
    compared exactly, AGAIN of all by default. Queries go in passes of PASS; only their candidates' vectors are compared."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if not points:
        return vectors.sparkSession.createDataFrame([], f"query long, {key} long, similarity double, place int")
    again = again or max(k + 1, min(MOST, int(AGAIN * codes.count())))
    queries = queries.filter(F.col("vector").isNotNull())
    rows = [(r[0], list(r[1])) for r in queries.select(F.col("query").cast("long"), "vector").orderBy("query").toLocalIterator()]
    found = None
    for at in range(0, len(rows), PASS):
        part = candidates(codes, rows[at : at + PASS], key, points, again)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query long, {key} long, similarity double, place int")
    met = found.filter(F.col("query") != F.col(key)).join(vectors.select(key, embedding), key).join(queries.select("query", "vector"), "query")
    a, b = F.col("vector"), F.col(embedding)
    alike = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return met.select("query", key, alike.alias("similarity")).withColumn("place", place).filter(F.col("place") <= k)
