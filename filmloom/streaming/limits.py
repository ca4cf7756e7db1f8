"""Request limits and usage budgets over a request log, as batch jobs and as a windowed stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmloom.functions.text import local_day

PERMITS, WINDOW_SECONDS = 30, 60


def window_start(ts: Column, seconds: int = WINDOW_SECONDS) -> Column:
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return (F.floor(epoch / seconds) * seconds).cast("bigint")


def window_counts(log: DataFrame, client: str = "client", ts: str = "ts", permits: int = PERMITS,
                  seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(client, window_start, requests, admitted, rejected) per epoch-aligned window."""
    counted = log.groupBy(client, window_start(F.col(ts), seconds).alias("window_start")).agg(
        F.count(F.lit(1)).alias("requests"))
    admitted = F.least(F.col("requests"), F.lit(permits).cast("bigint"))
    return counted.select(client, "window_start", "requests", admitted.alias("admitted"),
                          (F.col("requests") - admitted).alias("rejected"))


def admitted_requests(log: DataFrame, request_id: str = "request_id", client: str = "client", ts: str = "ts",
                      permits: int = PERMITS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The first `permits` requests of each client and window. A hot client sends only that many per task."""
    keyed = log.withColumn("window_start", window_start(F.col(ts), seconds))
    w = Window.partitionBy(client, "window_start").orderBy(ts, request_id)
    return keyed.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= permits)


def rejected_requests(log: DataFrame, request_id: str = "request_id", **kwargs) -> DataFrame:
    """All other requests, by an anti join on the request id, which no client can make skewed."""
    admitted = admitted_requests(log, request_id, **kwargs).select(request_id)
    return log.join(admitted, request_id, "left_anti")


def stream_window_counts(log: DataFrame, client: str = "client", ts: str = "ts", late: str = "2 minutes",
                         seconds: int = WINDOW_SECONDS, permits: int = PERMITS) -> DataFrame:
    """The same counts over a stream; a window is final once the watermark has passed it."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = (timed.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), F.col(client))
               .agg(F.count(F.lit(1)).alias("requests")))
    admitted = F.least(F.col("requests"), F.lit(permits).cast("bigint"))
    return counted.select(client, F.unix_seconds("window.start").alias("window_start"), "requests",
                          admitted.alias("admitted"), (F.col("requests") - admitted).alias("rejected"))


def usage(log: DataFrame, ts: str = "ts", tokens: str = "tokens", zone: str = "America/Los_Angeles") -> DataFrame:
    """(second, attempts, tokens, attempts_60s, tokens_60s, attempts_day, attempts_total, tokens_total).

    The log is first summed per second. The sliding minute looks at one minute bucket and the one before;
    running totals add a day's prefix to the prefix of the days before. No window grows with the log.
    """
    per_second = log.groupBy(F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(tokens).alias("tokens"))
    minute = F.floor(F.col("second") / 60)
    seen_from = F.explode(F.array(F.struct(minute.alias("bucket"), F.lit(False).alias("earlier")),
                                  F.struct((minute + 1).alias("bucket"), F.lit(True).alias("earlier"))))
    copied = per_second.select("*", seen_from.alias("s")).select("second", "attempts", "tokens", "s.bucket", "s.earlier")
    last_minute = Window.partitionBy("bucket").orderBy("second").rangeBetween(-59, 0)
    sliding = copied.select("second", "attempts", "tokens", "earlier", F.sum("attempts").over(last_minute).alias("attempts_60s"),
                            F.sum("tokens").over(last_minute).alias("tokens_60s")).where(~F.col("earlier")).drop("earlier")

    dated = sliding.withColumn("day", local_day(F.timestamp_seconds("second"), zone))
    inside = Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dated.withColumn("attempts_day", F.sum("attempts").over(inside)).withColumn(
        "_tokens_day", F.sum("tokens").over(inside))
    days = dated.groupBy("day").agg(F.sum("attempts").alias("_a"), F.sum("tokens").alias("_t"))
    # One row per calendar day, whatever the size of the log.
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    prefixes = days.select("day", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_before_a"),
                           F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before_t"))
    return running.join(prefixes, "day").select(
        "second", "day", "attempts", "tokens", "attempts_60s", "tokens_60s", "attempts_day",
        (F.col("attempts_day") + F.col("_before_a")).alias("attempts_total"),
        (F.col("_tokens_day") + F.col("_before_t")).alias("tokens_total"))


def over_budget(used: DataFrame, per_minute: int, tokens_per_minute: int, per_day: int, attempts: int,
                tokens: int) -> DataFrame:
    """Adds `exceeded`: names of the caps that a second's totals are beyond."""
    caps = {"attempts_60s": per_minute, "tokens_60s": tokens_per_minute, "attempts_day": per_day,
            "attempts_total": attempts, "tokens_total": tokens}
    return used.withColumn("exceeded", F.array_compact(F.array(
        *[F.when(F.col(name) > cap, F.lit(name)) for name, cap in caps.items()])))
