"""Structured Streaming forms of the incremental filter, of counts over time and of the catalog's merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog
from ..sources.files import read_catalog, write_catalog


def first_seen(stream: DataFrame, time: str, key: str = "source_job_id", delay: str = "1 day") -> DataFrame:
    """Each key once: a record goes if its key came within ``delay`` of its time before, or if it is later than that.

    The state holds keys of the last ``delay`` only, whatever their number.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_over_time(stream: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, <by>, count) of windows; in append mode a window comes out once it can't change any more."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), by, "count")


def merged_into_catalog(stream: DataFrame, path: str, schema: str, at: str, checkpoint: str, policy: str = "updated_hash") -> StreamingQuery:
    """Merge every micro-batch of records (as ``catalog.merge`` takes them) into the catalog at ``path``, then stop.

    A batch is never taken for the whole of a board, so no key becomes inactive. Of several records of a key
    in a batch the one with the largest hash counts. A batch that is done again after a failure gives the
    same catalog.
    """

    def merge(batch: DataFrame, _: int) -> None:
        known = read_catalog(batch.sparkSession, path, schema)
        one = batch.groupBy("stable_key").agg(F.max_by(F.struct(*batch.columns), "payload_hash").alias("s")).select("s.*")
        write_catalog(catalog.merge(known, one, at, False, policy, -1).drop("change"), path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
