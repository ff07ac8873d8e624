"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of its
source. Sorted by fractional rank, sources interleave in proportion, and equal cuts of that order give shards
which all have the mixture of the whole and whose row counts differ by one at most (law `rows`).

Equal texts that would fit into one shard make a group, which stands in the stratum of one of its sources; all its rows have the
fractional rank of the first. So a group stands in one place of the order, and only a group on which a cut falls is
divided: one for each cut at most, which the law on rows then asks for. Rows of a larger group stay in their own sources.

Orders are global: rows and groups are range-partitioned by the whole sort key, so that a source with a third of all rows
fills as many partitions as its size asks for. Texts are read once and never shuffled.

Defined results: a null text has size 8 and the CRC of no bytes, 0, and is equal to an empty one; null sources are one source;
repeated rows are ranked in some order of their own, which changes no count; texts are hashed whole, however long; an empty table gives no
rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, join_unique, ranked, running, text_or_empty


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 29) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of docs."""
    text = text_or_empty()
    narrow = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), text).alias("h1"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h2"),
        F.monotonically_increasing_id().alias("tie"),
    )
    narrow = cut(narrow, "shard_rows")
    total = narrow.count()
    # The first total % shards shards have one row more than the others.
    least, more = divmod(total, shards)
    homes = narrow.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("home"), F.max("source").alias("other"), F.count("source").alias("named"))
    homes = homes.filter(F.col("n").between(2, least) & ((F.col("home") != F.col("other")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))))
    homed = join_unique(narrow, cut(homes.select("h1", "home", "n"), "shard_homes"), ["h1"], "n", total, F.struct("doc_id", "tie"))
    homed = cut(homed.withColumn("home", F.coalesce("home", "source")).withColumn("hs", F.xxhash64(F.lit(seed), "home")), "shard_homed")
    groups = homed.groupBy("home", "hs", "h1").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(running(groups, [F.col("home").asc_nulls_first(), F.col("h1")], {"before": "n"}), "shard_groups")
    per_home = cut(groups.groupBy("hs").agg(F.sum("n").alias("rows"), F.min("before").alias("start"), F.count(F.lit(1)).alias("many")), "shard_homes")
    at = (F.col("before") - F.col("start") + 0.5) / F.col("rows")
    groups = cut(join_unique(groups, per_home, ["hs"], "many", groups.count(), F.col("h1")).select("hs", "h1", "n", at.alias("at")), "shard_ranks")
    placed = join_unique(homed, groups, ["hs", "h1"], "n", total, F.struct("doc_id", "tie"))
    mixed = ranked(placed, [F.col(c) for c in ("at", "hs", "h1", "h2", "doc_id", "tie")], "place")
    turn = more * (least + 1)
    first = F.col("place") < turn
    shard = F.when(first, F.floor(F.col("place") / (least + 1))).otherwise(more + F.floor((F.col("place") - turn) / max(least, 1)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (least + 1)).otherwise(turn + (F.col("shard") - more) * least)
    out = mixed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("place") - start).cast("long"))
    return out.select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    out = shard_rows(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
