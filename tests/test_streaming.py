"""The streams, driven to their end over the small table of events."""

from conftest import SMALL
from millrace.streaming import monitor


def _folder(tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "in/events.parquet")
    return f"{tmp_path}/in"


def test_windows(spark, tmp_path):
    stream = monitor.windowed(monitor.events(spark, _folder(tmp_path)))
    monitor.written(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert 0 < out.groupBy().sum("n").first()[0] <= 1000


def test_keyed_state(spark, tmp_path):
    made = []
    stream = monitor.ema(monitor.events(spark, _folder(tmp_path)))
    query = stream.writeStream.foreachBatch(lambda df, _: made.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(r.steps for r in made) == 1000
