"""Column counts and checks that follow a stream: every micro-batch is a signed delta of the maintained value counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.parse import name, value_missing
from tablewright.operators.columns import CountStore, delta


def follow_counts(stream: DataFrame, load: str, store: CountStore, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start a query that adds each micro-batch to the store. A batch's number is its version in the store, so a batch that is
    replayed after a failure counts once."""

    def add(batch: DataFrame, number: int) -> None:
        counts = store.commit(delta(batch, load, store.columns), version=number + 1)
        if on_batch is not None:
            on_batch(counts, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_gaps(stream: DataFrame, time: str, columns: list[str], window: str = "1 day", late: str = "28 days") -> DataFrame:
    """(window_start, column_name, rows, missing) per event-time window; rows later than `late` behind the newest are dropped
    by the watermark, as a stream must."""
    missing = [F.sum(value_missing(name(c), stream.schema[c].dataType).cast("long")).alias(f"m{i}") for i, c in enumerate(columns)]
    sums = stream.withWatermark(time, late).groupBy(F.window(name(time), window).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *missing)
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)))
    return sums.select(F.col("w.start").alias("window_start"), "rows", F.explode(cells).alias("c")).select("window_start", "c.column_name", "rows", "c.missing")
