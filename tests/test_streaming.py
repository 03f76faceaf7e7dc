"""Streams give what tables give; what comes late has a stated fate."""

from __future__ import annotations

import datetime
import time

from panelwright.streaming import appended, bars, filled_stream, latest

START = datetime.datetime(2024, 1, 1)


def _at(minutes: int) -> datetime.datetime:
    return START + datetime.timedelta(minutes=minutes)


def _landed(spark, folder, batches, schema):
    """One file for each batch, in order of time."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_filled_stream_keeps_state_over_batches(spark, tmp_path):
    first = [("a", _at(1), 1, 5.0), ("a", _at(2), 2, None), ("b", _at(2), 3, None), ("a", _at(3), 4, 7.0)]
    second = [("a", _at(4), 5, None), ("b", _at(5), 6, 2.0), ("b", _at(6), 7, None), ("a", _at(2), 8, None), ("a", _at(2), 9, 6.0)]
    third = [("a", _at(7), 10, None), ("b", _at(-9000), 11, 1.0)]
    stream = filled_stream(_landed(spark, tmp_path, [first, second, third], "asset string, dt timestamp, id long, price double"), "1 hour")
    got = {r["id"]: r["price"] for r in appended(stream, str(tmp_path)).collect()}
    # within the delay: a late gap stays null, a late price is its own and no later gap's; beyond it a row goes
    assert got == {1: 5.0, 2: 5.0, 3: None, 4: 7.0, 5: 7.0, 6: 2.0, 7: 2.0, 8: None, 9: 6.0, 10: 7.0}


def test_bars_leave_out_late_events(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    first = [("a", _at(5), 1.0), ("a", _at(10), 3.0), ("a", _at(61), 2.0)]
    second = [("a", _at(30), 9.0), ("a", _at(150), 4.0)]
    third, fourth = [("a", _at(155), 4.0)], [("a", _at(40), 100.0), ("a", _at(400), 0.0)]
    # a batch is held against the watermark that the batch before it began with
    stream = bars(_landed(spark, tmp_path, [first, second, third, fourth], schema), late="40 minutes")
    got = {(r["dt"].hour, r["high"], r["n"]) for r in appended(stream, str(tmp_path)).collect()}
    # the second batch's early event is in time for its hour, the fourth's isn't; the last bar isn't final
    assert got == {(0, 9.0, 3), (1, 2.0, 1), (2, 4.0, 2)}
    table = bars(spark.createDataFrame(first + second + third, schema)).collect()
    assert {(r["dt"].hour, r["high"], r["n"]) for r in table} == got


def test_latest_bars_hold_open_windows(spark, tmp_path):
    """Bars that later batches change count once, and the last one is there though nothing closes it."""
    schema = "event_type string, ts timestamp, value double"
    first = [("a", _at(5), 1.0), ("a", _at(61), 2.0)]
    second = [("a", _at(30), 9.0), ("b", _at(62), 4.0)]
    third = [("a", _at(65), 5.0), ("a", _at(150), 3.0)]
    stream = bars(_landed(spark, tmp_path, [first, second, third], schema), late="1 day")
    table = bars(spark.createDataFrame(first + second + third, schema))
    assert sorted(latest(stream, str(tmp_path), ["asset", "dt"]).collect()) == sorted(table.collect())
