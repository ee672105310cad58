"""Upserts by partition, the service source, order statistics of a symbol's rows and the stateful stream."""

import os
import time
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillpanel.functions import kernel, ts
from quillpanel.operators import features, statistics
from quillpanel.sources import market, partitions, vendor
from quillpanel.sources.panels import walk_panel
from quillpanel.streaming import state

BARS = "symbol long, date date, open double, high double, low double, close double, volume double"


def bars(rows):
    return [(s, d, c, c + 1, c - 1, c, 10.0) for s, d, c in rows]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_touch_only_what_can_change(spark, tmp_path):
    path = str(tmp_path / "panel")
    days = [date(y, 6, 1) for y in (2017, 2018, 2020, 2021)]
    old = spark.createDataFrame(bars([(s, d, 10.0) for s in range(8) for d in days]), BARS).withColumn("close_raw", F.col("close") * 2)
    partitions.create(old, path, buckets=4)
    before = files(path)
    mine = old.where("symbol = 3").select(partitions.bucket_of("symbol", 4)).first()[0]
    time.sleep(0.05)
    new = spark.createDataFrame(bars([(3, date(2018, 6, 1), 20.0), (3, date(2018, 6, 1), 19.0), (3, date(2018, 7, 1), 20.0)]), BARS)
    written = partitions.upsert(spark, path, new, buckets=4)
    assert written == [(2018, mine), (2020, mine)]  # 2020 begins with a row that follows the changed close
    after = files(path)
    assert {f for f in before if f not in after} == {f for f in before if f"bucket={mine}/" in f and ("year=2018" in f or "year=2020" in f)}
    assert all(after[f] == before[f] for f in before if f in after)
    merged = {(r["symbol"], r["date"]): r for r in partitions.read(spark, path).collect()}
    want = {(r["symbol"], r["date"]): r for r in market.merge(old, market.keep_last(new.withColumn("close_raw", F.col("close")), F.col("close")).drop("f_dup")).collect()}
    assert set(merged) == set(want) and all(merged[k]["close"] == want[k]["close"] and merged[k]["close_raw"] == want[k]["close_raw"] and merged[k]["f_big_move"] == want[k]["f_big_move"] for k in want)
    assert merged[3, date(2018, 6, 1)]["close_raw"] == 20.0 and merged[3, date(2020, 6, 1)]["f_big_move"]
    assert {r["symbol"]: r["last_date"] for r in partitions.high_water(spark, path).collect()} == {s: days[-1] for s in range(8)}
    partitions.upsert(spark, path, new, buckets=4)  # a repeated batch
    assert sorted(map(str, partitions.read(spark, path).collect())) == sorted(map(str, merged.values()))
    assert partitions.upsert(spark, path, new.limit(0), buckets=4) == [] and partitions.upsert(spark, path, new, buckets=4, since="2019-01-01") == []


def test_upserts_equal_a_merge_of_everything(spark, tmp_path):
    rng = np.random.default_rng(3)
    path = str(tmp_path / "panel")
    draw = lambda n: {(int(s), date(2016, 1, 1) + timedelta(days=int(d))): float(c) for s, d, c in zip(rng.integers(0, 6, n), rng.integers(0, 2000, n), rng.choice([10.0, 11.0, 13.0], n), strict=True)}
    table = lambda rows: spark.createDataFrame(bars([(s, d, c) for (s, d), c in rows.items()]), BARS).withColumn("close_raw", F.col("close") + 5)
    whole = table(draw(60))
    partitions.create(whole, path, buckets=2)
    for _ in range(3):
        new = table(draw(25))
        partitions.upsert(spark, path, new, buckets=2)
        whole = market.saved(market.merge(whole, new).select(*whole.columns), "whole")
    columns = ["symbol", "date", "close", "close_raw", "f_big_move", "f_any"]
    assert sorted(map(str, partitions.read(spark, path).select(*columns).collect())) == sorted(map(str, market.flag(whole).select(*columns).collect()))


def test_kernel_equals_frames(spark, sf):
    panel = walk_panel(spark, sf).where("symbol < 4").withColumn("x", F.when(F.col("volume") % 3 > 0, F.round("close", 1)))
    made = kernel.along(panel, {"rank": ("x", kernel.rank(20, 5)), "top": ("x", kernel.highest(30, 4)), "least": ("x", kernel.lowest(15)), "first": ("close", kernel.argmax(12))})
    rows = made.withColumns({"r": ts.rank("x", 20, 5), "h": ts.highest("x", 30, 4), "l": ts.lowest("x", 15), "f": ts.argmax("close", 12)}).collect()
    near = lambda a, b: (a is None) == (b is None) and (a is None or a == pytest.approx(b))
    assert rows and all(near(r["rank"], r["r"]) and near(r["top"], r["h"]) and near(r["least"], r["l"]) and near(r["first"], r["f"]) for r in rows)


def test_argmax_by_brute_force():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, 400).astype(float)
    x[rng.integers(0, 400, 20)] = np.nan
    want = [float(np.argmax(x[i - 6 : i + 1]) + 1) if i >= 6 and not np.isnan(x[i - 6 : i + 1]).any() else np.nan for i in range(400)]
    assert np.array_equal(kernel.argmax(7)(x), want, equal_nan=True)


def test_stateful_stream_equals_the_batch(spark, sf, tmp_path):
    panel = walk_panel(spark, sf).where("symbol < 4").withColumn("close", F.when(F.col("volume") % 7 > 0, F.col("close")))  # gaps inside
    panel = market.saved(panel, "panel")
    for lo, hi in (("1900-01-01", "1995-12-31"), ("1996-01-01", "1998-12-31"), ("1999-01-01", "2999-12-31")):
        panel.where(F.col("date").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    panel.where("date = '1994-02-01'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # comes late
    stream = spark.readStream.schema(panel.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.follow(stream, 0.01).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert out["late"].sum() == panel.where("date = '1994-02-01'").count()
    out = out[~out["late"]].set_index(["symbol", "date"]).sort_index()
    flags = market.flag(panel, 0.01).toPandas().set_index(["symbol", "date"]).sort_index()
    lines = features.exponential_features(panel).toPandas().set_index(["symbol", "date"]).sort_index()
    assert len(out) == len(flags)
    for c in ("f_nan", "f_bad_ohlc", "f_zero_vol", "f_big_move", "f_any"):
        assert (out[c].astype(bool) == flags[c].astype(bool)).all(), c
    for c in ("EMA_9", "EMA_200", "RSI_14"):
        assert np.allclose(out[c].astype(float), lines[c].astype(float), equal_nan=True), c


def test_service_gets_the_filters(spark, tmp_path):
    log = str(tmp_path)

    def fetch(symbols, first, last):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{symbols}|{first}|{last}")
        days = [date(2020, 1, d) for d in range(1, 11) if (first is None or date(2020, 1, d) >= first) and (last is None or date(2020, 1, d) <= last)]
        return pa.table({"symbol": [s for s in symbols for _ in days], "date": days * len(symbols)}, schema=pa.schema([("symbol", pa.string()), ("date", pa.date32())]))

    table = vendor.scan(spark, "test_service", "symbol string, date date", ["b", "a", "c", "d", "a"], fetch, groups=2)
    assert table.count() == 40
    for f in os.listdir(log):
        os.remove(f"{log}/{f}")
    found = table.where("symbol in ('a', 'c', 'x') and date >= '2020-01-03' and date < '2020-01-06'")
    assert sorted({r["symbol"] for r in found.collect()}) == ["a", "c"] and found.count() == 6
    asked = {open(f"{log}/{f}").read() for f in os.listdir(log)}
    assert asked == {"['a']|2020-01-03|2020-01-06", "['c']|2020-01-03|2020-01-06"}


def test_retries_wait_as_told():
    waits, left = [], [3]

    def fetch():
        left[0] -= 1
        if left[0]:
            raise ValueError("limit reached, try again in 7 seconds" if left[0] == 2 else "down")
        return pa.table({})

    vendor.attempt(fetch, 3, 0.5, waits.append)
    assert waits == [7.0, 1.0]
    with pytest.raises(ZeroDivisionError):
        vendor.attempt(lambda: 1 / 0, 2, 0.1, waits.append)


def test_holm_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(300) ** 3, 4)
    table = spark.createDataFrame(pd.DataFrame({"comparison": [f"c{i:03d}" for i in range(300)], "p_value": p}))
    found = {r["comparison"]: r["p_holm"] for r in statistics.holm(table).collect()}
    highest, want = 0.0, {}
    for k, i in enumerate(sorted(range(300), key=lambda i: (p[i], i))):
        highest = max(highest, (300 - k) * p[i])
        want[f"c{i:03d}"] = min(1.0, highest)
    assert all(found[c] == pytest.approx(want[c]) for c in want)
