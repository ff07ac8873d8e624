"""State as versioned Parquet: upsert, merge, cascade, replace. One writer at a time.

A table is a folder of numbered versions; the newest one with a _SUCCESS file is current. A change writes the next version
whole and leaves older ones to be read by those who have begun with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize_key
from ..scratch import written


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of table with the same keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys table lacks are added, one for each key."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new)


def delete_matching(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_set(table: DataFrame, owner: str, rows: DataFrame) -> DataFrame:
    """All rows of the owners in rows are replaced by rows."""
    return table.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def rename_value(table: DataFrame, column: str, old: str, new: str) -> tuple[DataFrame, Column]:
    """table with old renamed, and the count of rows that change."""
    return table.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column))), F.count_if(F.col(column) == old)


def update_column(table: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """table with column replaced, in rows of the keys that rows (key, column; one a key) has; a null there counts, too."""
    new = rows.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))
    return table.join(new, key, "left").withColumn(column, value).select(*table.columns)


def history(made: DataFrame, zone: str) -> DataFrame:
    """made with created_at as that zone's clock shows it, the newest first."""
    return made.orderBy(F.desc("created_at"), "id").withColumn("created_at", F.date_format(F.from_utc_timestamp("created_at", zone), "yyyy-MM-dd HH:mm"))


def alias_rows(pairs: DataFrame) -> DataFrame:
    """alias_key, canonical of (alias, canonical) pairs; a canonical name resolves to itself, too."""
    both = pairs.select("alias", "canonical").union(pairs.select("canonical", "canonical"))
    rows = both.select(normalize_key(F.col("alias")).alias("alias_key"), "canonical").filter("alias_key <> ''")
    return rows.groupBy("alias_key").agg(F.max("canonical").alias("canonical"))


def resolve_names(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """df with resolved: the canonical name, or else the trimmed one."""
    keyed = df.withColumn("alias_key", normalize_key(F.col(name)))
    return keyed.join(aliases, "alias_key", "left").withColumn("resolved", F.coalesce("canonical", F.trim(name))).drop("alias_key", "canonical")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with n = 1, 2, ... in order: places inside sorted ranges, plus the counts of the ranges before (one row a range)."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("many")).orderBy("part").collect()
    starts, before = {}, 0
    for row in counts:
        starts[row["part"]] = before
        before += row["many"]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[part] if starts else F.lit(0)
    return placed.withColumn("n", start + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The current version, or an empty table."""
        have = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> int:
        n = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
        return n

    def change(self, name: str, schema: StructType | str, how: Callable[[DataFrame], DataFrame]) -> int:
        return self.write(name, how(self.read(name, schema)))

    def append_with_ids(self, name: str, schema: StructType | str, rows: DataFrame, order: list[str]) -> list[int]:
        """Appends rows with id = greatest id so far + their place in the order, and returns the new ids' range."""
        have = self.read(name, schema)
        last = have.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = numbered(rows, order).withColumn("id", F.col("n") + last).drop("n")
        self.write(name, have.unionByName(new, allowMissingColumns=True))
        return [last + 1, last + rows.count()]
