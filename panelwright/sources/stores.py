"""Tables that are written and read again: text chunks by universe, tracked runs, CSV results; and what identifies a panel."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def universe_key(tickers: Column) -> Column:
    """One key for a set of tickers, whatever their order and case."""
    return F.array_join(F.array_sort(F.transform(tickers, lambda t: F.upper(t))), ",")


def save_chunks(chunks: DataFrame, tickers: list[str], folder: str) -> bool:
    """Add ``chunks`` to the store under their universe, with the time; an empty table is not saved."""
    if chunks.isEmpty():
        return False
    key = universe_key(F.array(*map(F.lit, tickers)))
    chunks.withColumns({"universe": key, "saved_at": F.current_timestamp()}).write.mode("append").partitionBy("universe").parquet(folder)
    return True


def load_chunks(spark: SparkSession, tickers: list[str], folder: str, hours: int = 24) -> DataFrame:
    """The last chunks saved for this set of tickers, if they are at most ``hours`` old."""
    own = spark.read.parquet(folder).filter(F.col("universe") == universe_key(F.array(*map(F.lit, tickers))))
    fresh = own.filter(F.col("saved_at") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(hours)))
    last = fresh.agg(F.max("saved_at").alias("saved_at"))
    return fresh.join(F.broadcast(last), "saved_at").drop("saved_at", "universe")


def fingerprint(prices: DataFrame) -> DataFrame:
    """One row with the SHA-256 of a panel's assets, dates and prices, to the last bit: of the digests of buckets of assets, each of its assets' digests.

    An asset's digest is that of its rows in order of date. A bucket holds the assets whose own digest begins alike, so no row gathers them all.
    """
    day = F.concat_ws("|", "dt", F.format_string("%a", "price"))
    own = prices.groupBy("asset").agg(F.array_sort(F.collect_list(day)).alias("rows"))
    own = own.select(F.sha2(F.concat_ws("\n", "asset", F.array_join("rows", "\n")), 256).alias("h"))
    of = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
    return own.groupBy(F.substring("h", 1, 3)).agg(of().alias("h")).agg(of().alias("fingerprint"))


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder name where all executors share one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def save_zip(lines: DataFrame, folder: str) -> None:
    """``lines(file, i, line)`` as one ZIP archive for each ``file``, written by the task that has its lines in order."""

    def one(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, path = (fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{key[0]}.zip") as out:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"{key[0]}.csv", "\n".join(table.sort_values("i")["line"]) + "\n")
            out.write(held.getvalue())
        return pd.DataFrame({"file": [key[0]], "n": [len(table)]})

    lines.groupBy("file").applyInPandas(one, "file string, n long").write.format("noop").mode("overwrite").save()


def synthetic_prices(spark: SparkSession, assets: int, days: int, mu: float = 0.08, sigma: float = 0.2, seed: int = 42, periods: int = 252) -> DataFrame:
    """``(asset, dt, price)``: geometric Brownian motion from 100, on consecutive days; each (asset, day) draws by its own hash."""
    rows = spark.range(assets * days).select(
        F.format_string("SYN%03d", (F.col("id") / days).cast("int")).alias("asset"), (F.col("id") % days).cast("int").alias("i"), F.col("id")
    )
    uniform = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(2))
    step = F.when(F.col("i") > 0, (mu - sigma * sigma / 2) / periods + sigma / periods**0.5 * normal).otherwise(0.0)
    from pyspark.sql import Window

    path = F.sum("step").over(Window.partitionBy("asset").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("step", step).select("asset", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("dt"), (100 * F.exp(path)).alias("price"))


def save_run(run: DataFrame, params: dict[str, str], metrics: DataFrame, folder: str) -> None:
    """Append a tracked run: ``run(run_id, ...)``, its parameters and ``metrics(run_id, metric, value)`` as three tables."""
    run.write.mode("append").parquet(f"{folder}/runs")
    ids = run.select("run_id", F.explode(F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv])).alias("param", "value"))
    ids.write.mode("append").parquet(f"{folder}/run_params")
    metrics.write.mode("append").parquet(f"{folder}/run_metrics")


def save_csv(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(folder)
