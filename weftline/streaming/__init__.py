"""Structured Streaming forms of the incremental stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sightings(urls: DataFrame, *, url: str = "url", ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each URL once. With an event time, state is dropped after ``late``."""
    if ts is None:
        return urls.dropDuplicates([url])
    return urls.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([url])


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and kind; late events count until the watermark passes."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    grouped = timed.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "events", "value")


def host_limiter(per_second: int = 2):
    """A stateful processor for ``transformWithStateInPandas`` grouped by host: gives every URL the next
    free slot of its host and keeps the slot that is free next."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.free = handle.getValueState("free", "slot long")

        def handleInputRows(self, key, rows, timerValues):
            slot = self.free.get()[0] if self.free.exists() else 0
            for batch in rows:
                n = len(batch)
                slots = range(slot, slot + n)
                yield pd.DataFrame({"host": [key[0]] * n, "url": batch["url"], "slot": slots, "second": [s // per_second for s in slots]})
                slot += n
            self.free.update((slot,))

        def close(self) -> None:
            pass

    return Limiter()


def limited(urls: DataFrame, per_second: int = 2) -> DataFrame:
    """host, url, slot and second of a stream of URLs (host, url)."""
    return urls.groupBy("host").transformWithStateInPandas(statefulProcessor=host_limiter(per_second), outputStructType="host string, url string, slot long, second long", outputMode="Append", timeMode="None")
