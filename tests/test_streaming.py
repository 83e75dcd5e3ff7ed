from datetime import date, timedelta

import numpy as np

from panelscope.operators.detectors import detect_cusum
from panelscope.streaming.cusum import stream_cusum


def test_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, 150)
    x[90:] += 2
    # null returns hold their place in the window, and are passed over
    rows = [(t, k, date(2020, 1, 1) + timedelta(k), None if t == "b" and k in (0, 20, 69, 70, 95) else float(v)) for t in "ab" for k, v in enumerate(x if t == "a" else -x)]
    df = spark.createDataFrame(rows, "ticker string, t int, date date, r double")
    for k, (low, high) in enumerate(((0, 70), (70, 150))):
        df.where(f"t >= {low} and t < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stream_cusum(stream, 30, 4.0, 15).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["ticker"], r["t"]) for r in spark.sql("select * from found").collect()}
    assert got == {(r["ticker"], r["t"]) for r in detect_cusum(df, 30, 4.0, 15).collect()} and got
