import pytest

from tessera.operators import log
from tessera.streaming import log_stream

ROWS = [(1, "a", 1, "x"), (2, "a", 1, "y"), (3, "b", 1, "z"), (4, "b", 2, None), (5, "c", 2, None), (6, "c", 1, "w")]
SCHEMA = "seq long, id string, op int, v string"


def test_replay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    assert {(r.id, r.v) for r in log.replay(df, ["id"], ["seq"]).collect()} == {("a", "y"), ("c", "w")}
    assert {r.id for r in log.tombstones(df, ["id"], ["seq"]).collect()} == {"b"}
    assert {(r.seq, r.created) for r in log.upsert_flags(df, ["id"], ["seq"]).collect()} == {(1, True), (2, False), (3, True), (4, False), (5, True), (6, False)}
    assert [r.id for r in log.compacted(df, ["id"], ["seq"]).collect()] == ["a", "c"]
    assert log.replay(df.limit(0), ["id"], ["seq"]).count() == 0
    with pytest.raises(Exception, match="CORRUPTED_SEGMENT"):
        spark.createDataFrame([(255,)], "op int").select(log.decode_op(log.F.col("op"))).collect()


def test_streams(spark, tmp_path):
    src = tmp_path / "log"
    for k in range(3):
        spark.createDataFrame(ROWS[2 * k : 2 * k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = log_stream.read_log_stream(spark, str(src), spark.read.parquet(str(src)).schema, 1)
    snapshot = log_stream.Snapshot(spark, f"file://{tmp_path}/state", ["id"], ["seq"])
    epochs = []
    log_stream.merge_into(stream, snapshot, str(tmp_path / "cp"), epochs.append).awaitTermination()
    assert epochs == [0, 1, 2]
    state = lambda: {(r.id, r.v) for r in snapshot.state(log.F.col("op") == log.DELETE).collect()}
    assert state() == {("a", "y"), ("c", "w")}
    snapshot.merge(spark.createDataFrame([(9, "a", 2, None)], SCHEMA), 2)  # run again: nothing changes
    assert state() == {("a", "y"), ("c", "w")}
    q = log_stream.replay_stream(stream, ["id"], ["seq"], ["op", "v"]).writeStream.outputMode("complete").format("memory").queryName("replayed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.v) for r in spark.sql("select * from replayed where op = 1").collect()} == {("a", "y"), ("c", "w")}
