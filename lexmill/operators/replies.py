"""A ledger of a model's replies: what was asked once is never asked again, and a run that died goes on where it stopped.

A prompt is addressed by the hash of its task, the task's version and its text. Before anything is asked, the prompts of a step are reduced to different ones
and anti-joined with the ledger's successes; replies are appended to the ledger as their tasks end (tasks commit their files by themselves, not with
the job), so a job that is killed loses no more than its unfinished tasks. Failures are recorded, too, and asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import strip_thinking
from .models import TRIES, Chat

LEDGER = "key string, task string, version string, reply string, error string"


def address(task: str, version: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{task}\0{version}\0"), text), 256)


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str
    pause: float = 0.05

    def rows(self) -> DataFrame:
        """All replies and failures so far; LEDGER. Each question's replies have a folder of their own, so that two states of a ledger are different scans in one plan."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = sorted(f"{self.path}/{s.getPath().getName()}" for s in fs.listStatus(where)) if fs.exists(where) else []
        return self.spark.read.schema(LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], LEDGER)

    def known(self) -> DataFrame:
        """key, reply of what was answered; a key that two runs have asked at once has the least of its replies."""
        return self.rows().filter("error IS NULL").groupBy("key").agg(F.min("reply").alias("reply"))

    def ask(self, rows: DataFrame, model: Chat, task: str, version: str, text: str) -> DataFrame:
        """rows with reply (null where the model failed or text is null) and reply_error; asks what the ledger doesn't know, TRIES times with a growing pause."""
        keyed = rows.withColumn("__key", address(task, version, F.col(text)))
        todo = keyed.filter(F.col(text).isNotNull()).select(F.col("__key").alias("key"), F.col(text).alias("text"))
        # Prompts are shuffled once: into so many tasks, each of which commits its own replies.
        todo = todo.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "key").dropDuplicates(["key"])
        todo = todo.join(self.known(), "key", "left_anti")
        pause = self.pause

        def one(prompt: str) -> tuple[str | None, str | None]:
            error = None
            for i in range(TRIES):
                try:
                    return model.reply(task, prompt), None
                except Exception as e:  # any failure of a service is recorded
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(pause * 2**i)
            return None, error

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                said = [one(p) for p in part["text"]]
                yield pd.DataFrame({"key": part["key"], "task": task, "version": version, "reply": [r for r, _ in said], "error": [e for _, e in said]})

        todo.mapInPandas(batches, LEDGER).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/{task}-{uuid.uuid4().hex}")
        last = self.rows().groupBy("key").agg(F.min("reply").alias("reply"), F.max("error").alias("error"))
        met = keyed.join(last, F.col("__key") == F.col("key"), "left")
        said = strip_thinking(F.col("reply")).alias("reply")
        return met.select(*rows.columns, said, F.when(F.col("reply").isNull(), F.col("error")).alias("reply_error"))
