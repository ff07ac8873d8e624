"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches, in ascending order of doc_id. Each batch reduces its lines to one row per key,
merge-anti-joins the sorted runs of what earlier batches held, and adds what is new as a run of level 0. When a
level has `fanout` runs they are merged into one of the next level, so that a key is rewritten only log(batches)
times and a batch never meets more than fanout * levels runs. Runs are bucketed tables of the warehouse: the
anti-join shuffles the new batch alone and merges it with runs that are already dealt out and sorted.

What a document loses is kept by row content, so that rows with one doc_id, or none, make no common list. A line that very many
documents have is one of a few keys that are broadcast; its lines aren't brought together.

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` code points are never
dropped; rows that share a doc_id count as one document; rows with a null doc_id count as one document that comes
last, and so does the doc_id 2**63 - 1, with them; a key repeated inside the document that owns it keeps all its lines there; texts are
split whole, however long; an empty table gives no rows. Columns of the input pass through, whatever their names, but for the
ones that the operator returns.
"""

from __future__ import annotations

import uuid

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, ascii_lower, by_place, cut, documents, join_unique, text_or_empty, width

KEY = ["k1", "k2"]
#: The largest doc_id: rows with a null one come last.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of line hashes, each a bucketed table."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or width(spark)
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def write(self, keys: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        keys.select(*KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        return table

    def known(self, keys: DataFrame) -> DataFrame:
        """keys with a flag for those that some run holds; a run holds a key once."""
        seen = F.lit(False)
        for i, run in enumerate(self.runs()):
            held = self.spark.table(run).select(*(F.col(k).alias(f"{k}_{i}") for k in KEY)).hint("merge")
            keys = keys.join(held, (F.col("k1") == F.col(f"k1_{i}")) & (F.col("k2") == F.col(f"k2_{i}")), "left")
            seen = seen | F.col(f"k1_{i}").isNotNull()
        return keys.withColumn("known", seen).drop(*(f"{k}_{i}" for i in range(len(self.runs())) for k in KEY))

    def add(self, keys: DataFrame) -> None:
        """Adds keys that no run holds, and merges levels that are full."""
        run, at = self.write(keys), 0
        while True:
            if len(self.levels) <= at:
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fanout:
                return
            merged = self.spark.table(self.levels[at][0])
            for other in self.levels[at][1:]:
                merged = merged.unionByName(self.spark.table(other))
            run, old = self.write(merged), self.levels[at]
            self.levels[at] = []
            for table in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            at += 1

    def drop(self) -> None:
        for table in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = []


#: Seeds of the two hashes of a key, as Spark's xxhash64(key) and xxhash64(1, key) have them.
SEEDS = (42, xxhash.xxh64_intdigest(b"\1\0\0\0", 42))
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def kept_lines(text: pd.Series, k1: pd.Series, k2: pd.Series, min_chars: int) -> pd.DataFrame:
    """Texts without the lines whose key's hashes stand among those that the document loses."""
    texts, counts = [], []
    for t, first, second in zip(text, k1, k2):
        lines, gone = t.split("\n"), dict(zip(map(int, first), map(int, second)))
        kept = []
        for line in lines:
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= min_chars:
                raw = key.encode()
                if (h := signed(xxhash.xxh64_intdigest(raw, SEEDS[0]))) in gone and gone[h] == signed(xxhash.xxh64_intdigest(raw, SEEDS[1])):
                    continue
            kept.append(line)
        texts.append("\n".join(kept))
        counts.append(len(lines) - len(kept))
    return pd.DataFrame({"text": texts, "n": counts})


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def drop_list(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    """__owner (the doc_id, LAST for null), __mark (a hash of the text) and __gone, the keys of the lines that such a row loses."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("owner"), F.xxhash64("text").alias("mark"), "text")
    bounds = ids.agg(F.percentile_approx("owner", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("owner") > b).cast("int")
    lines = (
        ids.filter(F.col("text").isNotNull())
        .select("owner", "mark", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
        .select("owner", "mark", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("owner", "mark", batch.cast("int").alias("batch"), F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    )
    lines = cut(lines, "line_hashes", ["batch"])
    runs, losing = LineRuns(spark, fanout), None
    try:
        for b in range(len(bounds) + 1):
            own = lines.filter(F.col("batch") == b)
            keys = own.groupBy(*KEY).agg(F.min("owner").alias("first"), F.max("owner").alias("last"), F.count(F.lit(1)).alias("n"))
            keys = cut(runs.known(keys), "batch_keys")
            if b < len(bounds):
                runs.add(keys.filter(~F.col("known")))
            found = keys.filter(F.col("known") | (F.col("first") < F.col("last")))
            found = found.select(*KEY, F.lit(b).alias("batch"), F.when(~F.col("known"), F.col("first")).alias("first"), F.lit(True).alias("losing"), "n")
            losing = found if losing is None else losing.unionByName(found)
    finally:
        runs.drop()
    met = join_unique(lines, losing, [*KEY, "batch"], "n", lines.count(), F.struct("owner", "mark"))
    lost = met.filter(F.col("losing") & (F.col("first").isNull() | (F.col("owner") != F.col("first"))))
    return lost.groupBy(F.col("owner").alias("__owner"), F.col("mark").alias("__mark")).agg(F.collect_set(F.struct(*KEY)).alias("__gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with `text` less its dropped lines, and n_lines (before) and n_dropped."""
    made = ("text", "n_lines", "n_dropped")
    plain, rest, back = by_place(docs, ("doc_id", "text"), made)
    rest = [c for c in rest if c != "text"]
    gone = drop_list(plain.select("doc_id", "text"), min_chars, batches, fanout)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    def without(text: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
        return kept_lines(text, k1, k2, min_chars)

    keyed = plain.select(*rest, text_or_empty().alias("__t"), F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("__o"), F.xxhash64("text").alias("__m"))
    joined = keyed.join(gone, (F.col("__o") == F.col("__owner")) & (F.col("__m") == F.col("__mark")), "left")
    lines = (F.length("__t") - F.length(F.translate("__t", "\n", "")) + 1).cast("long").alias("n_lines")
    whole = joined.filter(F.col("__gone").isNull()).select(*rest, F.col("__t").alias("text"), lines, F.lit(0).cast("long").alias("n_dropped"))
    some = joined.filter(F.col("__gone").isNotNull()).select(*rest, lines, without("__t", F.col("__gone.k1"), F.col("__gone.k2")).alias("__r"))
    some = some.select(*rest, F.col("__r.text").alias("text"), "n_lines", F.col("__r.n").alias("n_dropped"))
    return back(whole.unionByName(some))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, pos, line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
