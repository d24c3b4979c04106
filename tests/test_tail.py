"""The tail of one log that grows, is cut and grows again."""

from tidemark.schemas import EVENT
from tidemark.sources import logs, tail


def test_offsets(tmp_path):
    path = tmp_path / "log"
    reader = tail.TailReader(str(path), 10)
    assert reader.initialOffset() == {"at": 0} and list(reader.read({"at": 5})[0]) == []
    path.write_bytes(b"one\ntwo\r\n")
    assert list(reader.read({"at": 0})[0]) == [("one",), ("two",)] and tail.TailReader(str(path), 10, False).initialOffset() == {"at": 9}
    path.write_bytes(b"one\ntwo\nthree and more than ten\nfour")
    rows, end = reader.read({"at": 0})
    assert list(rows) == [("one",), ("two",)] and end == {"at": 8}
    rows, after = reader.read(end)
    assert list(rows) == [("three and more than ten",)]
    assert list(reader.read(after)[0]) == [] and reader.read(after)[1] == after
    assert list(reader.readBetweenOffsets({"at": 0}, after)) == [("one",), ("two",), ("three and more than ten",)]
    path.write_bytes(b"new\n")
    rows, end = reader.read(after)
    assert list(rows) == [("new",)] and end == {"at": 4}


def test_stream(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    rows = logs.parse_lines(tail.tail_lines(spark, str(path)), EVENT).select("timestamp")
    query = rows.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    seen = lambda: sorted(r.timestamp for r in spark.table("tailed").collect())
    try:
        path.write_text('{"timestamp": 1.0}\n{"timestamp": 2.0}\nbroken\n{"timest')
        query.processAllAvailable()
        assert seen() == [1.0, 2.0]
        with path.open("a") as f:
            f.write("amp\": 3.0}\n{'timestamp': 4.0}\n")
        query.processAllAvailable()
        assert seen() == [1.0, 2.0, 3.0, 4.0]
        path.write_text('{"timestamp": 5.0}\n')
        query.processAllAvailable()
        assert seen() == [1.0, 2.0, 3.0, 4.0, 5.0]
    finally:
        query.stop()
