"""Streaming forms of the queue, the limits and the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import Buckets, daily_limited
from ..operators.queue import debounced
from ..sources.folders import checkpointed
from ..sources.manifest import BucketedTables


def debounce(events: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, every: str | None = None):
    """Starts a query that hands the queue's changed pages of each micro-batch to `apply`; state and progress lie in `checkpoint`."""
    out = debounced(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply(batch))
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, key: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events (ts, key) counted over tumbling windows; a window closes `late` after its end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


MINUTE = "request_id long, action string, at long, passed boolean, wait long, before long"


def minutes_stream(requests: DataFrame, session: int, ip: int, late: str = "10 minutes") -> DataFrame:
    """Requests (request_id, at, action, session, ip) of a stream as rows of MINUTE, by the limits of session and address.

    A minute of an action is a key of its own, which holds its requests until the watermark has passed its end: then they come in order,
    however they arrived. A request later than `late` behind the newest is dropped, as its minute may be closed."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.hasTimedOut:
            held = [tuple(r) for r in state.get[0]] if state.exists else []
            held += [row for f in frames for row in zip(f["at"].tolist(), f["request_id"].tolist(), f["session"].tolist(), f["ip"].tolist())]
            state.update((held,))
            state.setTimeoutTimestamp((int(key[1]) + 1) * 60_000)
            return
        buckets, out, passed = Buckets(session, ip, 0), [], 0
        for at, request, s, i in sorted(tuple(r) for r in state.get[0]):
            ok, wait = buckets.consume(s, i, at)
            out.append((request, key[0], at, ok, wait, passed))
            passed += ok
        state.remove()
        yield pd.DataFrame(out, columns=["request_id", "action", "at", "passed", "wait", "before"])

    rows = requests.withColumns({"ts": F.timestamp_seconds("at"), "minute": F.floor(F.col("at") / 60)}).withWatermark("ts", late)
    return rows.groupBy("action", "minute").applyInPandasWithState(
        fold, MINUTE, "rows array<struct<at:long,request_id:long,session:string,ip:string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


class DailyLimit:
    """The second stage: the micro-batches of `minutes_stream` under a daily limit.

    Minutes close in order of time, so of each action and day only the number of passed requests is kept, in a committed table with the number
    of the batch. A batch's answers are one folder, written before that commit: a batch that is run again writes the same or nothing."""

    def __init__(self, spark: SparkSession, root: str, daily: int):
        self.spark, self.root, self.daily = spark, root.rstrip("/"), daily
        self.tables = BucketedTables(spark, f"{self.root}/spent", {"spent": "page_key string, day long, n long"}, buckets=8)

    def __call__(self, batch: DataFrame, number: int) -> None:
        base = self.tables.head()
        if int(base.meta.get("batch", -1)) >= number:
            return
        rows = checkpointed(batch)
        if rows.isEmpty():
            return
        touched = self.tables.touched(base, rows, "action")
        spent = self.tables.read("spent", base, touched)
        found = daily_limited(rows, self.daily, spent.withColumnRenamed("page_key", "action")) if self.daily > 0 else rows.select("request_id", F.col("passed").alias("allowed"), F.col("wait").alias("retry_after"))
        found.write.mode("overwrite").parquet(f"{self.root}/answers/batch={number}")
        more = rows.groupBy(F.col("action").alias("page_key"), F.floor(F.col("at") / 86400).cast("long").alias("day")).agg(F.count_if("passed").alias("n"))
        # days before the last one that a batch has are over
        total = spent.unionByName(more).groupBy("page_key", "day").agg(F.sum("n").cast("long").alias("n"))
        last = total.groupBy("page_key").agg(F.max("day").alias("_last"))
        total = total.join(last, "page_key").where(F.col("day") >= F.col("_last") - 1).drop("_last")
        self.tables.commit(base, {"spent": self.tables.staged("spent", base, total, touched)}, meta={"batch": str(number)})

    def answers(self) -> DataFrame:
        """request_id, allowed, retry_after of all requests of closed minutes."""
        return self.spark.read.schema("request_id long, allowed boolean, retry_after long").parquet(f"{self.root}/answers").select("request_id", "allowed", "retry_after")


def coupled_limits_stream(requests: DataFrame, session: int, ip: int, daily: int, root: str, checkpoint: str, late: str = "10 minutes", every: str | None = None):
    """Starts `limits.coupled_limits` over a stream; its answers are those of DailyLimit(spark, root, daily)."""
    stage = DailyLimit(requests.sparkSession, root, daily)
    out = minutes_stream(requests, session, ip, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(stage)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
