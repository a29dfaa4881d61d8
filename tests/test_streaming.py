"""The event stream gives the same counts as a batch over the same files."""

import json

from saltmarsh.streaming import sessions


def test_running_accept_precision(spark, tmp_path):
    rows = [{"event": e, "session_id": s, "timestamp": f"2024-01-0{d}T10:00:00Z", "turn": 1, "flag_id": "x"} for s, d, e in (("a", 1, "accept"), ("a", 1, "dismiss"), ("a", 1, "accept"), ("b", 1, "flags"), ("b", 2, "dismiss"), ("z", 9, "accept"))]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    stream = sessions.running_accept_precision(sessions.event_stream(spark, str(tmp_path / "log")))
    query = stream.writeStream.outputMode("append").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["session_id"], r["day"].day): (r["accepts"], r["answers"]) for r in spark.table("scores").collect()}
    assert got == {("a", 1): (2, 3), ("b", 2): (0, 1)}
