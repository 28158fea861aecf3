"""Events of token streams: numbering, pings while idle, state kept inside a reasoning block."""

import time

from quarry.streaming import streams

SCHEMA = "stream_id string, seq int, delta string, last boolean"


def test_pings_keep_an_open_block(spark, tmp_path):
    def put(rows, name):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for part in (tmp_path / name).glob("part-*.parquet"):
            part.rename(tmp_path / "in" / f"{name}-{part.name}")

    def seen(event):
        return spark.table("protocol_events").where(f"stream_id = 's' and event = '{event}'").count()

    def until(done, limit=90):
        end = time.time() + limit
        while not done() and time.time() < end:
            time.sleep(0.3)
        assert done()

    (tmp_path / "in").mkdir()
    put([("s", 0, "a<think>se", False), ("s", 1, "cret </th", False), ("u", 0, "whole", True)], "first")
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    made = streams.event_stream(source, idle_ms=500)
    query = made.writeStream.format("memory").queryName("protocol_events").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        until(lambda: seen("ping") >= 2)
        put([("s", 2, "ink>b", False), ("s", 3, None, False), ("s", 4, "c", True)], "second")
        until(lambda: seen("done") == 1)
    finally:
        query.stop()
    rows = {k: [r for r in spark.table("protocol_events").orderBy("number").collect() if r["stream_id"] == k] for k in "su"}
    assert [r["number"] for r in rows["s"]] == list(range(len(rows["s"])))
    kinds = [r["event"] for r in rows["s"]]
    assert kinds[0] == "start" and kinds[-1] == "done" and set(kinds[1:-1]) <= {"token", "ping"}
    assert "".join(r["text"] for r in rows["s"]) == "abc" and rows["s"][-1]["seq"] == 4
    assert [(r["event"], r["text"]) for r in rows["u"]] == [("start", ""), ("token", "whole"), ("done", "")]
