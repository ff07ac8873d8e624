"""Sessions that expire on a stream are those of the table."""

import datetime

from pyspark.sql import functions as F

from lexmill.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_stream_is_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 12).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    days = events.withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 10))
    for part in range(3):
        days.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    sessions.use_store(spark)
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        out = sessions.expired(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        out.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    known = events.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=1)
    want = {tuple(r) for r in sessions.expired(events).filter(F.col("expires") <= F.lit(known)).collect()}
    got = [tuple(r) for r in spark.read.schema(sessions.EXPIRED).parquet(f"{tmp_path}/out").collect()]
    assert max(r[2] for r in got) <= known, (known, max(r[2] for r in got))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
