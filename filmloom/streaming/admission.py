"""Request limits inside a stream: every request is admitted or rejected once, also over restarts.

The limiter's memory is a table of permits used per client and window. Each batch reads the table that the batch before
left and writes its own answers and its own table, so a batch that runs again after a failure finds the same memory and
gives the same answers. Windows that end before the horizon are forgotten; requests for them are rejected as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filmloom.sources.folders import batches_in, remove
from filmloom.streaming.limits import PERMITS, WINDOW_SECONDS, window_start

KEPT_WINDOWS = 10
_USED = "client string, window_start long, used long"


def decide(requests: DataFrame, used: DataFrame, horizon: int | None, permits: int = PERMITS,
           seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(request_id, client, ts, window_start, admitted, reason) of one batch of (request_id, client, ts).

    `used` holds the permits given before. Of a batch, each client and window gives its earliest requests what is left;
    only so many leave a task. A request without a client counts for `unknown`, one without a time is rejected, and an
    id that stands twice in a batch is one request, its earliest.
    """
    client = F.coalesce(F.col("client"), F.lit("unknown"))
    one = requests.groupBy("request_id").agg(F.min(F.struct(F.col("ts").isNull().alias("missing"), F.col("ts"), client.alias("client"))).alias("r"))
    keyed = one.select("request_id", "r.client", "r.ts").withColumn("window_start", window_start(F.col("ts"), seconds))
    late = F.col("window_start") < horizon if horizon is not None else F.lit(False)
    order = Window.partitionBy("client", "window_start").orderBy("ts", "request_id")
    first = keyed.where(F.col("ts").isNotNull() & ~late).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= permits)
    given = (first.join(used, ["client", "window_start"], "left")
             .where(F.col("turn") + F.coalesce("used", F.lit(0)) <= permits).select("request_id", F.lit(True).alias("given")))
    reason = (F.when(F.col("given"), None).when(F.col("ts").isNull(), "no time").when(late, "late").otherwise("limit"))
    return keyed.join(given, "request_id", "left").select(
        "request_id", "client", "ts", "window_start", F.coalesce("given", F.lit(False)).alias("admitted"), reason.alias("reason"))


def remembered(used: DataFrame, answers: DataFrame, horizon: int | None) -> DataFrame:
    """The permits used after a batch, without windows before the horizon."""
    new = answers.where("admitted").groupBy("client", "window_start").agg(F.count(F.lit(1)).alias("used"))
    total = used.unionByName(new).groupBy("client", "window_start").agg(F.sum("used").alias("used"))
    return total if horizon is None else total.where(F.col("window_start") >= horizon)


def _horizon(used: DataFrame, seconds: int, kept_windows: int) -> int | None:
    """The start of the earliest window that is still remembered: the newest window always has a permit given."""
    newest = used.agg(F.max("window_start")).first()[0]
    return None if newest is None else newest - kept_windows * seconds


def serve_admission(requests: DataFrame, out: str, checkpoint: str, permits: int = PERMITS, seconds: int = WINDOW_SECONDS,
                    kept_windows: int = KEPT_WINDOWS):
    """Start the stream over (request_id, client, ts). `answers` reads what it wrote."""
    if permits < 1:
        raise ValueError("needs at least one permit")
    spark = requests.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = [b for b in batches_in(spark, f"{out}/used") if b < batch_id]
        read = lambda b: spark.read.schema(_USED).parquet(f"{out}/used/batch={b}")
        used = read(max(before)) if before else spark.createDataFrame([], _USED)
        horizon = _horizon(used, seconds, kept_windows)
        decided = decide(batch, used, horizon, permits, seconds)
        path = f"{out}/answers/batch={batch_id}"
        decided.write.mode("overwrite").parquet(path)
        given = spark.read.schema(decided.schema).parquet(path)
        held = remembered(used, given, None)
        remembered(used, given, _horizon(held, seconds, kept_windows)).write.mode("overwrite").parquet(f"{out}/used/batch={batch_id}")
        for b in sorted(before)[:-1]:  # the last one is needed if this batch runs again
            remove(spark, f"{out}/used/batch={b}")

    return (requests.select("request_id", "client", F.col("ts").cast("timestamp").alias("ts")).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def answers(spark: SparkSession, out: str) -> DataFrame:
    """All answers, with the batch that gave them."""
    return spark.read.parquet(f"{out}/answers")
