"""Pieces that several training-data operators share: shared storage, word patterns, global ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words and white space are those of ASCII alone: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables that this process has written to shared folders, for `clear`.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one if the session is local, too."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Removes the tables that `cut` has written in this process, and says how many: for a job that has written its results."""
    jvm, n = spark._jvm, 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str = "lz4") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a lost executor costs no more than its own tasks."""
    path = scratch(df.sparkSession, name)
    out = df.write.option("compression", codec)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_place(docs: DataFrame, known: tuple[str, ...], made: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with every column but the `known` ones named by its place; the columns that pass through; what names a result's columns back.

    Columns of docs whose names are among `made`, those that the operator returns, don't pass. So no name of a column of
    docs, however odd, meets one that an operator uses inside.
    """
    names = [c if c in known and c not in docs.columns[:i] else f"__c{i}" for i, c in enumerate(docs.columns)]
    own = {n: c for n, c in zip(names, docs.columns) if c not in made or n in known}

    def back(out: DataFrame) -> DataFrame:
        return out.toDF(*(own.get(c, c) for c in out.columns))

    return docs.toDF(*names), list(own), back


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, spread: Column) -> DataFrame:
    """rows left-joined with table (each key once; n: how many rows have it), without a task that gets all rows of a hot key.

    Keys of more than total / (4 * width) rows, 4 * width at most, are broadcast. Their rows are dealt by `spread` in the join with
    all the other keys, of which they match none.
    """
    most = total // (4 * width(rows.sparkSession)) + 1
    values = [c for c in table.columns if c not in (*keys, n)]
    side = lambda t, tag: t.select(*(F.col(k).alias(f"__{tag}{i}") for i, k in enumerate(keys)), *(F.col(v).alias(f"__{tag}_{v}") for v in values), F.lit(True).alias(f"__{tag}"))
    hot, cold = side(table.filter(F.col(n) > most), "h"), side(table.filter(F.col(n) <= most), "l")
    on = lambda tag: reduce(lambda x, y: x & y, (F.col(k) == F.col(f"__{tag}{i}") for i, k in enumerate(keys)))
    met = rows.join(F.broadcast(hot), on("h"), "left")
    salt = F.when(F.col("__h").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int")
    met = met.withColumn("__salt", salt).join(cold.withColumn("__zero", F.lit(0)), on("l") & (F.col("__salt") == F.col("__zero")), "left")
    return met.select(*(F.col(c) for c in rows.columns), *(F.when(F.col("__h").isNotNull(), F.col(f"__h_{v}")).otherwise(F.col(f"__l_{v}")).alias(v) for v in values))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], rank: str, within: list[str] | None = None) -> DataFrame:
    """Adds the 0-based global rank by `order`, without a single-task window.

    Rows are range-partitioned and sorted; the position inside a partition comes from
    monotonically_increasing_id, and what stands before a partition from one count per
    partition. With `within`, which must lead the order, ranks restart for each of its values;
    one value may fill many partitions. The rows are written once, so that all
    later readers see one and the same dealing.
    """
    spark = df.sparkSession
    keys = within or []
    lone = "__at"
    placed = (
        df.repartitionByRange(width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn(lone, F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright(lone, 33))
        .withColumn(lone, F.col(lone).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = cut(placed, "ranked")
    counts = placed.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(lone).alias("__from"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col("__part").alias("__p"),
        *(F.col(k).alias(f"__k_{k}") for k in keys),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from")).alias("__shift"),
    )
    match = F.col("__part") == F.col("__p")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    # One row for each partition and key that meet: no more than partitions plus keys.
    out = placed.join(shift, match).withColumn(rank, F.col(lone) + F.col("__shift"))
    return out.drop("__part", "__p", "__shift", lone, *(f"__k_{k}" for k in keys))


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df, written once, with for each name in sums the sum of that column over all rows before in `order`; no task sorts all rows."""
    spark, part = df.sparkSession, "__part"
    placed = cut(df.repartitionByRange(width(spark), *order).withColumn(part, F.spark_partition_id()), "running")
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    totals = placed.groupBy(F.col(part).alias("__p")).agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    totals = totals.select("__p", *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums))
    out = placed.join(F.broadcast(totals), F.col(part) == F.col("__p"))
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__b_{n}")).alias(n) for n, c in sums.items()))
