"""Ranked lexical search: postings by shard, merged document at a time, results merged over shards.

A shard is some megabytes of documents of one task. Its postings are rows of a table: shard, term, and the term's documents
(places in the shard's list of ascending doc_ids, as differences) with their frequencies, as variable-length bytes; a row
without a term holds the shard's doc_ids and lengths. A search takes the asked terms' rows, counts documents over all
shards, and deals these rows by shard. A task merges, for each item, the postings of a shard's terms by a heap of
cursors, document at a time, and keeps the item's best in a heap of at most `k` keyed by score, then doc_id; the heap goes from shard to
shard. Terms whose largest contributions add up to less than the k-th best score can't bring in a document by themselves:
they aren't merged but looked up, and only for documents that could still get in. This leaves out no result and no tie. The best of all tasks
are ranked for each item.

Items are asked in blocks of bounded bytes, each a pass over the asked postings, so that what a task holds of the items is bounded,
however many there are (one item's own terms are always held together). The hottest terms cost a row a shard.

Defined results: terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a text that is null or has
no term isn't counted and never found; rows of one doc_id are documents of their own, and equal ones fill ranks of their own; null
doc_ids come last among equal scores; rows of one item_id (null ones, too) are one item with the terms of all of them; an item
without terms, and an empty table, give no rows. Texts are taken whole. Other columns aren't looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import ascii_lower, cut, documents, running, text_or_empty, width

#: A term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What each byte counts as: letters lower-cased, all that ends a term a blank.
AS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
#: Bytes of items' terms in a block.
ITEMS = 4_000_000
#: Slices of text in a shard.
SLICES = 4
INDEX = "shard long, term string, n long, total long, body binary"


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each, the last of a value below 128; and how many each value takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k)
    at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        out[at[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(sizes[own] > k + 1, 128, 0).astype(np.uint8)
    return out, sizes


def numbers(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(b < 128)[:-1] + 1])
    shift = (np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))) * 7
    return np.add.reduceat((b & 127).astype(np.uint64) << shift.astype(np.uint64), starts).astype(np.int64)


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def shard_of(parts: list[K.Slice], ids: pa.Array, shard: int) -> pa.RecordBatch:
    """The rows of a shard of documents in ascending order of doc_id."""
    hashes, starts, ends, counts, blocks, base = [], [], [], [], [], 0
    for part in parts:
        data = AS[part.data]
        found = K.words(K.Slice(part.first, part.last, data, part.bounds))
        hashes.append(found.hashes)
        starts.append(found.starts + base)
        ends.append(found.ends + base)
        counts.append(np.diff(found.cuts))
        blocks.append(data)
        base += len(data)
    hashes, starts, ends, lengths, raw = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.concatenate(counts), b"".join(d.tobytes() for d in blocks)
    n = len(lengths)
    doc = np.repeat(np.arange(n), lengths)
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    names = strings([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())])
    order = pc.sort_indices(names).to_numpy().astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, tf = np.unique(place[term] * n + doc, return_counts=True)
    term, doc = pairs // max(n, 1), pairs % max(n, 1)
    new = np.ones(len(pairs), bool)
    new[1:] = term[1:] != term[:-1]
    steps = np.where(new, doc, np.diff(doc, prepend=0))
    body, sizes = varints(np.stack([steps, tf], 1).reshape(-1))
    past = np.cumsum(sizes)[1::2]
    at = np.flatnonzero(new)
    df = np.diff(at, append=len(pairs))
    offsets = np.concatenate([np.zeros(1, np.int64), past[np.append(at[1:], len(pairs)) - 1]]) if len(pairs) else np.zeros(1, np.int64)
    bodies = pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
    own = ids.slice(parts[0].first, n)
    head = own.is_valid().to_numpy(False).astype(np.uint8).tobytes() + own.fill_null(0).to_numpy(False).astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
    m = len(df) + 1
    columns = [
        pa.array(np.full(m, shard)),
        pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(order))]),
        pa.array(np.append(int((lengths > 0).sum()), df)),
        pa.array(np.append(int(lengths.sum()), np.add.reduceat(tf, at) if len(df) else df)),
        pa.concat_arrays([pa.array([head], pa.binary()), bodies]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "n", "total", "body"])


def build_index(docs: DataFrame) -> DataFrame:
    """The postings of docs (doc_id, text) by shard, to be written as a table (INDEX): rows with a term have its number of documents and
    occurrences in the shard, the row without one the shard's counts of documents with terms and of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [("doc_id", "ascending")], null_placement="at_end"))
            parts = list(K.slices(batch["text"]))
            for i in range(0, len(parts), SLICES):
                yield shard_of(parts[i : i + SLICES], batch["doc_id"], at)
                at += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def terms_of(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text_or_empty(text)), F.lit(TERM), F.lit(0)))


class Best:
    """The k best (score, doc_id) of an item; a null doc_id stands behind all others of its score."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def least(self) -> int:
        """A score below this one can't get in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, 0 if doc is None else 1, 0 if doc is None else -doc)
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -doc if there else None) for score, there, doc in self.heap]


class Postings:
    """One term of a shard: documents, what each would add to a score but for the term's weight, and the most of that."""

    def __init__(self, docs: np.ndarray, parts: np.ndarray, top: int):
        self.docs, self.parts, self.top = docs, parts, top
        self.lists: tuple[list[int], list[int]] | None = None

    def listed(self) -> tuple[list[int], list[int]]:
        if self.lists is None:
            self.lists = self.docs.tolist(), self.parts.tolist()
        return self.lists


def postings_of(names: list[str], bodies: list[bytes], df: list[int], norm: np.ndarray) -> dict[str, Postings]:
    if not names:
        return {}
    pairs, cuts = numbers(b"".join(bodies)).reshape(-1, 2), np.concatenate([np.zeros(1, np.int64), np.cumsum(df)])
    docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
    docs -= np.repeat(docs[cuts[:-1]] - pairs[cuts[:-1], 0], df)
    parts = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[docs])
    tops = np.maximum.reduceat(parts, cuts[:-1]).tolist()
    return {name: Postings(docs[lo:hi], parts[lo:hi], top) for name, lo, hi, top in zip(names, cuts.tolist(), cuts[1:].tolist(), tops)}


def sure(own: list[tuple[int, Postings]], k: int) -> int:
    """A score that k of the shard's documents reach, from the documents of the terms that add the most; 0 if there are too few."""
    some = np.zeros(0, np.int64)
    for _, p in reversed(own):
        some = np.union1d(some, p.docs[: 4 * k])
        if len(some) >= k:
            break
    if len(some) < k:
        return 0
    scores = np.zeros(len(some), np.int64)
    for w, p in own:
        at = np.minimum(np.searchsorted(p.docs, some), len(p.docs) - 1)
        scores += np.where(p.docs[at] == some, w * p.parts[at], 0)
    return int(np.partition(scores, -k)[-k])


def merge(own: list[tuple[int, Postings]], best: Best, ids: list[int | None]) -> None:
    """Adds the shard's documents that have a term of own (weight, postings) to the best."""
    own = sorted(((w, p) for w, p in own if w > 0), key=lambda x: x[0] * x[1].top)
    bound = [0]
    for w, p in own:
        bound.append(bound[-1] + w * p.top)
    least = best.least()
    if bound[-1] < least:
        return
    if len(best.heap) < best.k:
        least = max(least, sure(own, best.k))
    lists = [(w, *p.listed()) for w, p in own]
    merged = bisect_left(bound, least, 1) - 1  # terms before this one reach less than `least` together
    cursors = [(lists[t][1][0], t, 0) for t in range(merged, len(own))]
    heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, t, at = cursors[0]
            if t < merged:  # has become one of those that are looked up
                heappop(cursors)
                continue
            w, docs, parts = lists[t]
            score += w * parts[at]
            if at + 1 < len(docs):
                heapreplace(cursors, (docs[at + 1], t, at + 1))
            else:
                heappop(cursors)
        t = merged - 1
        while t >= 0 and score + bound[t + 1] >= least:
            w, docs, parts = lists[t]
            at = bisect_left(docs, doc)
            if at < len(docs) and docs[at] == doc:
                score += w * parts[at]
            t -= 1
        if score > 0 and t < 0 and score >= least:
            best.add(score, ids[doc])
            if best.least() > least:
                least = best.least()
                while bound[merged + 1] < least:
                    merged += 1
                    if merged == len(own):
                        return


def ask(found: DataFrame, items: list[tuple[object, list[str]]], weights: dict[str, int], documents: int, terms: int, k: int, key: T.DataType) -> DataFrame:
    """item_id, doc_id, score: the k best of each task. found: rows of an index; items: their terms; documents, terms: N and L."""

    def shard(rows: list[pa.RecordBatch], bests: dict[int, Best]) -> None:
        table = pa.Table.from_batches(rows)
        names, df, bodies = table["term"].to_pylist(), table["n"].to_pylist(), table["body"].to_pylist()
        raw = bodies[names.index(None)]
        n = len(raw) // 17
        known, own_ids = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, "<i8", n, n).tolist()
        lengths = np.frombuffer(raw, "<i8", n, 9 * n)
        if int(lengths.max(initial=0)) < (1 << 62) // max(90 * documents, 1):
            norm = 10 + (90 * documents * lengths) // terms
        else:
            norm = np.array([10 + (90 * documents * x) // terms for x in lengths.tolist()], np.int64)
        ids = [x if t else None for x, t in zip(own_ids, known.tolist())]
        asked = [i for i, name in enumerate(names) if name is not None and weights.get(name, 0) > 0]
        postings = postings_of([names[i] for i in asked], [bodies[i] for i in asked], [df[i] for i in asked], norm)
        for i, (_, own) in enumerate(items):
            if there := [(weights[t], postings[t]) for t in own if t in postings]:
                merge(there, bests.setdefault(i, Best(k)), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests, held, now = {}, [], None
        for batch in batches:
            own = batch["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and own[lo] != now:
                    shard(held, bests)
                    held = []
                now = own[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            shard(held, bests)
        rows = [(items[i][0], doc, score) for i, best in bests.items() for score, doc in best.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["item_id", "doc_id", "score"])

    out = T.StructType([T.StructField("item_id", key), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in out]
    dealt = found.select("shard", "term", "n", "body").repartition(width(found.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, out)


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of a written index for each item (item_id, text)."""
    spark = index.sparkSession
    own = items.select("item_id", terms_of("text").alias("terms")).groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    own = own.withColumn("bytes", F.aggregate("terms", F.lit(64).cast("long"), lambda s, t: s + 16 + F.octet_length(t)))
    own = cut(running(own, [F.col("item_id")], {"before": "bytes"}), "items")
    asked = own.select(F.explode("terms").alias("term")).distinct()
    found = cut(index.join(asked, "term", "left_semi").select(*index.columns), "asked_postings")
    heads = index.filter("term IS NULL")
    counts = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * counts[0] + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    df = cut(df.select("term", weight.alias("w")), "term_weights")
    blocks = [r[0] for r in own.select(F.floor(F.col("before") / ITEMS).alias("b")).distinct().orderBy("b").collect()]
    parts = []
    for b in blocks:  # one for every ITEMS bytes of items
        block = own.filter(F.floor(F.col("before") / ITEMS) == b)
        rows = [(r[0], r[1]) for r in block.select("item_id", "terms").collect()]
        terms = block.select(F.explode("terms").alias("term")).distinct()
        weights = {r[0]: r[1] for r in df.join(F.broadcast(terms), "term", "left_semi").collect()}
        hits = (found if len(blocks) == 1 else found.join(F.broadcast(terms), "term", "left_semi").select(*found.columns)).unionByName(heads)
        parts.append(ask(hits, rows, weights, counts[0], counts[1], k, items.schema["item_id"].dataType))
    if not parts:
        return spark.createDataFrame([], T.StructType([items.schema["item_id"], *T._parse_datatype_string("rank int, doc_id long, score long").fields]))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(build_index(documents(spark, sf_dir)), "postings")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP11_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM low),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, q.term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df ON q.term = df.term, s),
x AS (SELECT item_id, doc_id, tf.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * n) // l))))::BIGINT AS score
      FROM w JOIN tf ON w.term = tf.term JOIN d ON d.r = tf.r, s GROUP BY item_id, doc_id, tf.r)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
