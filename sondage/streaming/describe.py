"""Descriptions of streams: counts and moments per event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.operators.describe import finite
from sondage.plans.shared import shared_root


def windowed(stream: DataFrame, ts: str, value: str, by: Sequence[str] = (), window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by..., n, na, mean, sd, lo, hi) of tumbling windows; rows later than the watermark are dropped by it."""
    t = F.col(ts).cast("timestamp")
    x = finite(value)
    rows = stream.withColumn("__ts", t).withWatermark("__ts", late)
    return rows.groupBy(F.window("__ts", window).alias("w"), *by).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("na"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")).select(F.col("w.start").alias("start"), *by, "n", "na", "mean", "sd", "lo", "hi")


def drained(out: DataFrame, name: str) -> DataFrame:
    """Run a streaming table over what is there now, and read what it has written."""
    import uuid

    root = f"{shared_root(out.sparkSession)}/{name}-{uuid.uuid4().hex}"
    last = f"{root}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{last}/epoch={epoch}")

    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    done = out.sparkSession.read.parquet(last)
    keys = [c for c in out.columns if c not in ("n", "na", "mean", "sd", "lo", "hi")]
    return done.groupBy(*keys).agg(F.max_by(F.struct(*out.columns), "epoch").alias("r")).select("r.*")
