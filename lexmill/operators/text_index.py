"""A stored index of positional postings, and conjunctive searches that read only the asked lexemes' parts of it.

A row of the postings is a lexeme in a block of BLOCK ids: the ids, the lexeme's positions in each, and the most positions that one id has. Rows are
dealt by ranges of (lexeme, block) and written partitioned by range, so that a lexeme of all texts fills many files and a rare one
shares a file; `ranges` says which lexemes a part holds. A search asks the ranges for its lexemes' parts and scans these alone, finds the blocks
that have all lexemes, and bounds each block's best score by the block's maxima: the blocks of the highest bounds are scored first, and
then only those whose bound reaches the k-th score found. No result and no tie is lost.

The analyzer `simple` takes runs of ASCII letters and digits as they are; `english` takes words without stop words, stemmed by a dictionary of
the different words that is joined to the postings. Positions count from 1 and count stop words, too.

Null texts have no lexemes; ids are whole numbers and mean one text each (rows of one id are one text, positions side by side); rows without an id aren't indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.english import STOP, dictionary, lexemes_of, words_of
from ..scratch import folder

#: Ids of a block; blocks that a search scores first.
BLOCK, FIRST = 1024, 8
#: Of the rank: the weight of an occurrence, the largest position, positions kept of a lexeme in a text, and how far apart two may stand.
WEIGHT, LAST, KEPT, APART = 0.1, 16383, 255, 100
#: Lists as tasks hand them on: bytes of places in the block (two each), of how many positions each id has and of positions (four each).
PACKED = "lexeme string, block long, ids binary, counts binary, positions binary"
#: Postings as they are written: times counts all occurrences.
LISTS = "lexeme string, block long, n int, most int, times long, ids array<long>, positions array<array<int>>"
TABLES = {
    "lexicon": "lexeme string, df long, occurrences long",
    "postings": "lexeme string, block long, n int, most int, ids array<long>, positions array<array<int>>, part int",
    "ranges": "part int, low string, high string",
}


@dataclass(frozen=True)
class TextIndex:
    """The TABLES of an index, as stored under path."""

    path: str
    analyzer: str
    lexicon: DataFrame
    postings: DataFrame
    ranges: DataFrame


def stored(spark: SparkSession, path: str, analyzer: str) -> TextIndex:
    """The index that `build` has written under path."""
    lexicon, postings, ranges = (spark.read.schema(kind).parquet(f"{path}/{t}") for t, kind in TABLES.items())
    return TextIndex(path, analyzer, lexicon, postings, ranges)


def packed(own: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of own between bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * own.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])


def listed(names: pa.Array, code: np.ndarray, ids: np.ndarray, pos: np.ndarray, last: bool) -> pa.RecordBatch:
    """The LISTS, or PACKED ones unless last, of occurrences (code, a place in names; id; position), ordered by code."""
    order = np.lexsort((pos, ids, code))
    code, ids, pos = code[order], ids[order], pos[order].astype(np.int32)
    first = lambda *own: np.flatnonzero(np.concatenate([[True] * (len(own[0]) > 0), np.logical_or.reduce([x[1:] != x[:-1] for x in own])]))
    at = first(code, ids)
    code, ids, ends = code[at], ids[at], np.append(at, len(pos)).astype(np.int32)
    block, long = ids // BLOCK, np.diff(ends)
    row = first(code, block)
    bounds = np.append(row, len(at)).astype(np.int32)
    head = [names.take(pa.array(code[row])), pa.array(block[row], pa.int64())]
    if not last:
        own = [packed((ids - block * BLOCK).astype(np.int16), bounds), packed(long, bounds), packed(pos, ends[bounds])]
        return pa.RecordBatch.from_arrays([*head, *own], ["lexeme", "block", "ids", "counts", "positions"])
    most, times = (f.reduceat(long, row) if len(row) else long for f in (np.maximum, np.add))
    positions = pa.ListArray.from_arrays(bounds, pa.ListArray.from_arrays(ends, pa.array(pos)))
    own = [pa.array(np.diff(bounds), pa.int32()), pa.array(most, pa.int32()), pa.array(times, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int64())), positions]
    return pa.RecordBatch.from_arrays([*head, *own], ["lexeme", "block", "n", "most", "times", "ids", "positions"])


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED lists of each batch of texts (id, words)."""
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy().astype(np.int64)
        words = batch["words"].flatten().dictionary_encode()
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        yield listed(words.dictionary, words.indices.to_numpy(), np.repeat(batch["id"].to_numpy(), n), pos, False)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTS of PACKED lists sorted by lexeme and block, those of one lexeme and block as one; of these no more than one is held back."""

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        names, n = own["lexeme"].dictionary_encode(), pc.binary_length(own["ids"]).to_numpy() // 2
        ids, counts, pos = (np.frombuffer(b"".join(own[c].to_pylist()), kind) for c, kind in (("ids", np.int16), ("counts", np.int32), ("positions", np.int32)))
        ids = ids + np.repeat(own["block"].to_numpy() * BLOCK, n)
        return listed(names.dictionary, np.repeat(np.repeat(names.indices.to_numpy(), n), counts), np.repeat(ids, counts), pos, True)

    held: list[pa.RecordBatch] = []
    for batch in filter(len, batches):
        names, block = batch["lexeme"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy()
        last = np.flatnonzero((names != names[-1]) | (block != block[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        same = not held or (held[-1]["lexeme"][-1] == batch["lexeme"][0] and held[-1]["block"][-1] == batch["block"][0])
        if held and (at or not same):
            yield one([*held, batch.slice(0, at)])
            held = []
        elif at:
            yield one([batch.slice(0, at)])
        held.append(batch.slice(at))
    if held:
        yield one(held)


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text", analyzer: str = "simple", path: str | None = None) -> TextIndex:
    """Writes the index of docs under path (a new folder of the shared ones by default).

    Tasks make lists of their own texts; what travels are these lists, about four bytes an occurrence, and no row for each. They are written first, since a
    deal by ranges reads its rows twice."""
    spark = docs.sparkSession
    path = path or folder(spark, "text_index")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), words_of(F.col(text), analyzer).alias("words"))
    found = rows.mapInArrow(inverted, PACKED)
    if analyzer == "english":
        found = found.filter(~F.col("lexeme").isin(*sorted(STOP)))
    found.write.parquet(f"{path}/lists")
    found = spark.read.schema(PACKED).parquet(f"{path}/lists")
    if analyzer == "english":
        words = found.withColumnRenamed("lexeme", "word")
        found = words.join(dictionary(words), "word").select(*found.columns)
    dealt = found.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lexeme", "block").sortWithinPartitions("lexeme", "block")
    dealt.mapInArrow(merged, LISTS).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/postings")
    postings = spark.read.schema(f"{LISTS}, part int").parquet(f"{path}/postings")
    postings.groupBy("lexeme").agg(F.sum("n").alias("df"), F.sum("times").alias("occurrences")).write.parquet(f"{path}/lexicon")
    postings.groupBy("part").agg(F.min("lexeme").alias("low"), F.max("lexeme").alias("high")).write.parquet(f"{path}/ranges")
    return stored(spark, path, analyzer)


def rows_of(index: TextIndex, lexemes: list[str]) -> DataFrame:
    """The lexemes' postings: partitions are pruned by the ranges, rows inside by the lexeme."""
    holds = F.lit(False)
    for x in lexemes:
        holds = holds | ((F.col("low") <= x) & (F.col("high") >= x))
    parts = [r[0] for r in index.ranges.filter(holds).select("part").collect()]
    return index.postings.filter(F.col("part").isin(parts) & F.col("lexeme").isin(lexemes))


def distance_rank(lexemes: list[str]) -> Callable[[Column, Column], Column]:
    """The rank of a text that has all lexemes, from their positions: each pair of occurrences of different ones adds by its distance; for a single lexeme
    the k-th occurrence adds by 1 / k**2."""

    def near(d: np.ndarray) -> np.ndarray:
        return WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(d / 1.5 - 2)))

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all pairs of places that stand APART at most (further ones add less than a rounding error)."""
        lo, hi = np.searchsorted(b, a - APART), np.searchsorted(b, a + APART, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.abs(np.repeat(a, n) - b[at])

    @F.pandas_udf(T.DoubleType())
    def score(names: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for own, where in zip(names, places):
            kept = [np.minimum(np.asarray(where[i], np.int64)[:KEPT], LAST) for i in np.argsort(own)]
            if len(kept) == 1:
                out.append(WEIGHT * float(np.sum(1 / np.arange(1, len(kept[0]) + 1) ** 2.0)) / 1.64493406685)
                continue
            rest = 0.0
            for i, a in enumerate(kept):
                for b in kept[i + 1 :]:
                    d = pairs(a, b)
                    rest += float(np.sum(np.log1p(-near(d[d > 0]))))
            out.append(-float(np.expm1(rest)))
        return pd.Series(out)

    return score


def rank_bound(most: Column, n: int) -> Column:
    """The highest rank in a block, from the most positions of each lexeme: all pairs side by side."""
    if n == 1:
        return F.lit(WEIGHT)
    pairs = F.aggregate(most, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("pairs")), lambda s, m: F.struct((s["sum"] + m).alias("sum"), (s["pairs"] + s["sum"] * m).alias("pairs")))["pairs"]
    return -F.expm1(pairs * float(np.log1p(-WEIGHT)))


def top(index: TextIndex, query: str, k: int, scope: DataFrame | None = None, score: str = "occurrences", id_col: str = "doc_id") -> DataFrame:
    """id_col, score: the k best ids (those of scope, if given) that have all of the query's lexemes; equal scores by ascending id.

    score: `occurrences` of the lexemes, or the `distance` rank."""
    spark = index.postings.sparkSession
    lexemes = lexemes_of(query, index.analyzer)
    kind = "long" if score == "occurrences" else "double"
    if not lexemes:
        return spark.createDataFrame([], f"{id_col} long, score {kind}")
    n, rows = len(lexemes), rows_of(index, lexemes)
    seen = {r["lexeme"]: r["df"] for r in index.lexicon.filter(F.col("lexeme").isin(lexemes)).collect()}
    if len(seen) < n:
        return spark.createDataFrame([], f"{id_col} long, score {kind}")
    rarest = min(lexemes, key=lambda x: (seen[x], x))
    most = F.collect_list(F.col("most").cast("double"))
    blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("have"), most.alias("most")).filter(F.col("have") == n)
    bound = F.aggregate("most", F.lit(0.0), lambda s, m: s + m) if score == "occurrences" else rank_bound(F.col("most"), n)
    blocks = blocks.select("block", bound.alias("bound"))

    def scored(chosen: DataFrame) -> DataFrame:
        own = rows.join(chosen.select("block"), "block", "left_semi")
        each = own.select("lexeme", F.explode(F.arrays_zip("ids", "positions")).alias("x")).select("lexeme", F.col("x.ids").alias("id"), F.col("x.positions").alias("positions"))
        kept = each.filter(F.col("lexeme") == rarest).select("id")
        if scope is not None:
            kept = kept.join(scope.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
        met = each.join(kept, "id", "left_semi").groupBy("id").agg(F.collect_list("lexeme").alias("names"), F.collect_list("positions").alias("places")).filter(F.size("names") == n)
        value = F.aggregate("places", F.lit(0).cast("long"), lambda s, p: s + F.size(p)) if score == "occurrences" else distance_rank(lexemes)(F.col("names"), F.col("places"))
        return met.select("id", value.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    first = scored(blocks.orderBy(F.desc("bound"), "block").limit(FIRST)).collect()
    if len(first) == k:
        blocks = blocks.filter(F.col("bound") >= float(first[-1]["score"]) - (0 if score == "occurrences" else 1e-12))
    return scored(blocks).select(F.col("id").alias(id_col), "score")
