from tablecheck.streaming import parity_stream
from tests.conftest import SF


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id")
    events.write.parquet(f"{tmp_path}/a")
    events.where("event_id % 10 <> 3").write.parquet(f"{tmp_path}/b")
    read = lambda d: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/{d}")
    rows = run(spark, parity_stream.windowed_counts(read("a"), read("b"), "ts", "1 day", "1 hour"), "w")
    assert rows and all(r.source_rows >= r.target_rows for r in rows)
    pairs = run(spark, parity_stream.unmatched(read("a"), read("b"), "event_id", "ts"), "u")
    assert pairs and all(r.t_key == r.s_key for r in pairs if r.t_key is not None) and all(r.s_key % 10 == 3 for r in pairs if r.t_key is None)
    sessions = run(spark, parity_stream.session_counts(read("a"), "user_id", "ts"), "s")
    assert sessions and all(r.session_start < r.session_end for r in sessions)
