"""Bars of an event stream: the same windowed aggregate over a table or over ``readStream``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def bars(events: DataFrame, key: str = "event_type", at: str = "ts", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(asset, dt, open, high, low, close, n)`` for each key and tumbling window.

    On a stream, events later than ``late`` are left out and a bar is final when the watermark passes its end; on a table all count. Ties
    in time are decided by the value.
    """
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    order = F.struct(at, value)
    by = rows.groupBy(F.col(key).alias("asset"), F.window(at, width).alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n")
    )
    return by.select("asset", F.col("w.start").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", "n")


class _LastPrice(StatefulProcessor):
    """Keeps an asset's latest known price; a batch's rows of one asset are filled in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, id long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, own, price = self.last.get() if self.last.exists() else (None, None, None)
        table = pd.concat(list(rows)).sort_values(["dt", "id"], kind="stable")
        filled = []
        for micros, i, x in zip(table["dt"].astype("datetime64[us]").astype("int64"), table["id"], table["price"], strict=True):
            ahead = at is None or (micros, i) >= (at, own)
            if pd.notna(x):
                at, own, price = (micros, i, float(x)) if ahead else (at, own, price)
                filled.append(float(x))
            else:
                # a gap before the latest known price isn't filled from the future
                filled.append(price if ahead else None)
        if at is not None:
            self.last.update((int(at), int(own), price))
        yield pd.DataFrame({"asset": key[0], "dt": table["dt"], "id": table["id"], "price": filled})

    def close(self) -> None:
        pass


def filled_stream(prices: DataFrame, late: str) -> DataFrame:
    """A stream ``prices(asset, dt, id, price)`` with gaps filled by the asset's last known price, in order of (dt, id); state is a price an asset.

    Rows that come after their batch's turn, but within ``late``, keep their own price or stay null; later ones are dropped by the watermark.
    """
    spark = prices.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prices.withColumn("dt", F.col("dt").cast("timestamp")).withWatermark("dt", late)
    filled = rows.groupBy("asset").transformWithStateInPandas(_LastPrice(), "asset string, dt timestamp, id long, price double", "append", "eventTime")
    return filled.withColumn("dt", F.col("dt").cast("timestamp_ntz"))


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """What ``stream`` appends to Parquet under ``folder`` until it has read all there is."""
    made = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    made.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def latest(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The last state of every row of ``stream`` by ``keys`` when it has read all there is, those that the watermark hasn't closed too.

    Each batch writes the rows it changed to a folder of its own, so a batch that runs again replaces what it wrote.
    """

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    every = stream.sparkSession.read.schema(f"{_ddl(stream)}, batch long").parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*(c if c in keys else f"last.{c}" for c in stream.columns))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
