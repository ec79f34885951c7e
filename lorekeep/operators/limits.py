"""Request limits over tumbling minutes and days."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


def single_limit(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests (request_id, at, key) with `allowed`: the first `limit` of each key and window of so many seconds."""
    window = F.floor(F.col("at") / seconds)
    place = F.row_number().over(W.partitionBy(key, window).orderBy("at", "request_id"))
    return requests.withColumn("allowed", (place <= limit) if limit > 0 else F.lit(True))


class Buckets:
    """Counters of one action. A request is allowed where every active limit has room; a denied one counts nowhere."""

    def __init__(self, session: int, ip: int, daily: int):
        self.limits = (session, ip, daily)
        self.counts: dict[tuple, int] = defaultdict(int)

    def consume(self, session: str, ip: str, at: int) -> tuple[bool, int]:
        minute, day = at // 60, at // 86400
        checks = [(("s", session, minute), self.limits[0], (minute + 1) * 60), (("i", ip, minute), self.limits[1], (minute + 1) * 60), (("d", day), self.limits[2], (day + 1) * 86400)]
        active = [c for c in checks if c[1] > 0]
        wait = max((max(1, expires - at) for key, limit, expires in active if self.counts[key] >= limit), default=0)
        if not wait:
            for key, _, _ in active:
                self.counts[key] += 1
        return not wait, wait


def coupled_limits(requests: DataFrame, session: int, ip: int, daily: int) -> DataFrame:
    """Requests (request_id, at, action, session, ip) with allowed and retry_after.

    A denied request counts nowhere. So the daily limit changes nothing until it is reached, and denies all that follows
    in its day: minutes are folded on their own, each in order, by the limits of session and address; a request that passes
    them is allowed where its place among the passing ones of its action and day is within the daily limit. Places are the
    sums of earlier minutes and the place within the minute, so no task sees a whole day."""
    minute = F.floor(F.col("at") / 60)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, buckets, passed = None, Buckets(session, ip, 0), 0
        for batch in batches:
            out = []
            for action, at, s, i in zip(*(batch.column(c).to_pylist() for c in ("action", "at", "session", "ip"))):
                if now != (action, at // 60):
                    now, buckets, passed = (action, at // 60), Buckets(session, ip, 0), 0
                allowed, wait = buckets.consume(s, i, at)
                out.append((allowed, wait, passed))
                passed += allowed
            columns = [pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 3, (pa.bool_(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("request_id", "action", "at")), *columns], ["request_id", "action", "at", "passed", "wait", "before"])

    # minutes are dealt out whole and come in order, so a task holds the counters of one minute at a time
    rows = requests.select(F.col("request_id").cast("long"), "action", F.col("at").cast("long"), "session", "ip", minute.alias("_minute")).repartition("action", "_minute")
    folded = rows.sortWithinPartitions("action", "_minute", "at", "request_id").mapInArrow(fold, "request_id long, action string, at long, passed boolean, wait long, before long")
    if daily <= 0:
        return folded.select("request_id", F.col("passed").alias("allowed"), F.col("wait").alias("retry_after"))
    # kept once, as both the minutes' sums and the requests are read from it
    return daily_limited(checkpointed(folded), daily)


def daily_limited(folded: DataFrame, daily: int, spent: DataFrame | None = None) -> DataFrame:
    """request_id, allowed, retry_after under the daily limit, of requests (request_id, action, at, passed, wait, before) of whole minutes
    that the other limits let pass or not; `spent` (action, day, n) is what passed in minutes before all of these."""
    minute, day = F.floor(F.col("at") / 60), F.floor(F.col("at") / 86400)
    folded = folded.withColumns({"minute": minute, "day": day})
    # one row a minute that has requests
    sums = folded.groupBy("action", "day", "minute").agg(F.count_if("passed").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("action", "day").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("action", "day", "minute", earlier.alias("earlier"))
    if spent is not None:
        sums = sums.join(spent.select("action", "day", F.col("n").alias("_n")), ["action", "day"], "left").withColumn("earlier", F.col("earlier") + F.coalesce("_n", F.lit(0)))
    placed = folded.join(sums.select("action", "minute", "earlier"), ["action", "minute"])
    over = F.col("earlier") + F.col("before") >= daily
    left = F.greatest(F.lit(1), (F.col("day") + 1) * 86400 - F.col("at"))
    return placed.select("request_id", (F.col("passed") & ~over).alias("allowed"), F.when(over, left).otherwise(F.col("wait")).cast("long").alias("retry_after"))
