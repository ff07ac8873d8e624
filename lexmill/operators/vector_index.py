"""A partitioned index of vectors: cells around centres fitted on a bounded sample; a search looks into the nearest cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that centres are fitted on, at most; the most centres; rounds of the fit.
SAMPLE, MOST, ROUNDS = 20_000, 1_024, 12
#: The share of cells that a search looks into: vectors without clusters need that many for a recall of 0.9, clustered ones far fewer.
SHARE = 0.7
#: Queries and rows of a cell that are compared at once; rows a query beyond those asked for that are compared number by number.
ASKED, ROWS, SPARE = 256, 4096, 8


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros stays."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def fit(vectors: DataFrame, key: str, embedding: str, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres (cells, size) by spherical k-means on the rows of the least key hashes, sample of them at most; every row is indexed
    later. cells: as many as the square root of the sample by default. Nulls aren't looked at; no rows give no centres."""
    picked = vectors.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(embedding).collect()
    if not picked:
        return np.zeros((0, 0))
    rows = unit(np.array([r[0] for r in picked], dtype=np.float64))
    k = min(len(rows), MOST, cells or max(1, round(len(rows) ** 0.5)))
    centres = rows[:: max(1, len(rows) // k)][:k].copy()
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = unit(sums[full])
    return centres


def probes(centres: np.ndarray, share: float = SHARE) -> int:
    return int(np.ceil(len(centres) * share))


def nearest(centres: np.ndarray, n: int):
    """A function of a vector column: its n nearest cells, the nearest first; empty for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(vectors: pd.Series) -> pd.Series:
        out = [[]] * len(vectors)
        have = [i for i, v in enumerate(vectors) if v is not None]
        if have and len(centres):
            near = np.argsort(-(np.stack([vectors.iloc[i] for i in have]) @ centres.T), axis=1, kind="stable")[:, :n]
            for i, own in zip(have, near.tolist()):
                out[i] = own
        return pd.Series(out)

    return cells


def build(vectors: DataFrame, key: str, embedding: str, centres: np.ndarray) -> DataFrame:
    """key, cell, embedding of every row that has a vector: write it partitioned or bucketed by cell."""
    rows = vectors.filter(F.col(embedding).isNotNull())
    return rows.select(key, nearest(centres, 1)(F.col(embedding))[0].alias("cell"), embedding)


def search(index: DataFrame, queries: DataFrame, key: str, embedding: str, centres: np.ndarray, k: int, near: int) -> DataFrame:
    """query, key, place, similarity: the k most alike rows for each query (query, vector) in its near nearest cells, itself left
    out. A cell's queries meet its rows as matrices, ASKED queries and ROWS rows at a time, and SPARE more than k rows a query leave it; the best of all cells
    are then compared number by number."""
    asked = queries.filter(F.col("vector").isNotNull()).select(F.col("query").cast("long").alias("query"), "vector", F.explode(nearest(centres, near)(F.col("vector"))).alias("cell"))
    rows = index.select(F.col(key).cast("long").alias("key"), "cell", F.col(embedding).alias("vector"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return alike_of(left, right, k + SPARE)

    met = asked.groupBy("cell").cogroup(rows.groupBy("cell")).applyInArrow(best, "query long, key long, alike double")
    # Rounded, since matrices add products in another order: equal vectors stay equal.
    chosen = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("alike", 12)), "key"))
    few = met.withColumn("at", chosen).filter(F.col("at") <= k + SPARE).select("query", F.col("key").alias(key))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col("vector"), F.col(embedding)
    both = few.join(index.select(key, embedding), key).join(queries.select("query", "vector"), "query")
    alike = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key))
    return both.select("query", key, alike.alias("similarity")).withColumn("place", place).filter(F.col("place") <= k)


def alike_of(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """query, key, alike: the k rows (key, vector) most like each query (query, vector), itself left out."""
    matrix = lambda column: unit(np.stack([np.asarray(v, np.float64) for v in column.to_pylist()]))
    out = [pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "alike": pa.array([], pa.float64())})]
    for at in range(0, len(asked) if len(rows) else 0, ASKED):
        own = asked.slice(at, ASKED)
        names, vectors = own["query"].to_numpy(), matrix(own["vector"])
        likes, keys = np.full((len(names), 0), 0.0), np.zeros((len(names), 0), np.int64)
        for lo in range(0, len(rows), ROWS):
            part = rows.slice(lo, ROWS)
            ids = part["key"].to_numpy()
            like = vectors @ matrix(part["vector"]).T
            like[names[:, None] == ids] = -np.inf
            likes, keys = np.concatenate([likes, like], axis=1), np.concatenate([keys, np.broadcast_to(ids, like.shape)], axis=1)
            order = np.lexsort((keys, -np.round(likes, 12)), axis=1)[:, :k]
            likes, keys = np.take_along_axis(likes, order, 1), np.take_along_axis(keys, order, 1)
        have = likes > -np.inf
        out.append(pa.table({"query": np.broadcast_to(names[:, None], have.shape)[have], "key": keys[have], "alike": likes[have]}))
    return pa.concat_tables(out)
