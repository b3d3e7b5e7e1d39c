"""Line-delimited JSON as a batch and as a stream."""

import json
import random
from datetime import datetime

import pytest
from pyarrow import fs

from tidemill.sources import jsonlines
from tidemill.sources.jsonlines import dealt, json_lines, lines
from tidemill.sources.tables import write_json_lines

COLUMNS = "id long, x double, name string, `is on` boolean, at timestamp_ntz"


def test_ranges_share_out_each_line_once(tmp_path):
    rng = random.Random(5)
    want = [b"x" * rng.choice([0, 1, 7, 40]) + rng.choice([b"\n", b"\r\n"]) for _ in range(60)] + [b"no end"]
    (tmp_path / "f").write_bytes(b"".join(want))
    size = sum(map(len, want))
    for step in (1, 2, 3, 11, 64, size, size + 9):
        parts = dealt([(str(tmp_path / "f"), 0, size)], step)
        assert [x for p in parts for r in p.ranges for x in lines(fs.LocalFileSystem(), *r)] == want


def test_many_small_files_share_partitions_and_their_number_has_a_ceiling():
    parts = dealt([(f"{i:04}", 0, 10) for i in range(1000)], 1000)
    assert len(parts) == 10 and sum(e - s for p in parts for _, s, e in p.ranges) == 10_000
    assert len(dealt([("f", 0, 10**15)], 1 << 20)) <= jsonlines.MOST_PARTITIONS
    assert dealt([("f", 0, 0)], 5) == []


def test_values_and_malformed_lines(spark, tmp_path):
    bad = ["[1]", "{", '{"id": 1.5}', '{"id": true}', '{"id": 9223372036854775808}', '{"x": NaN}', '{"x": 1' + "0" * 400 + "}", '{"name": 3}', '{"is on": 1}', '{"at": "soon"}', '{"name": "\\ud800"}', '{"at": "2024-01-01T00:00:00Z"}']
    good = ['{"id": 1, "x": 2, "name": "é\\n", "is on": true, "at": "2024-01-02T03:04:05.000006", "other": [1]}', '{"id": null}', "{}", '{"id": -1, "id": 4}']
    (tmp_path / "_SUCCESS").write_text("no line")
    (tmp_path / "a.json").write_text("\n".join([*bad, "", "  ", *good]))
    (tmp_path / "b.json").write_bytes(b"\xff\r\n")
    found = [tuple(r) for r in json_lines(spark, f"file://{tmp_path}", COLUMNS, partition_bytes=50).collect()]
    assert sorted(r[5] for r in found if r[5] is not None) == sorted([*bad, "�"])
    assert all(r[:5] == (None,) * 5 for r in found if r[5] is not None)
    kept = [(1, 2.0, "é\n", True, datetime(2024, 1, 2, 3, 4, 5, 6)), (None,) * 5, (None,) * 5, (4, None, None, None, None)]
    assert sorted((r[:5] for r in found if r[5] is None), key=str) == sorted(kept, key=str)


def test_no_lines_no_folder_and_bad_columns(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert json_lines(spark, str(tmp_path / "empty"), "id long").count() == 0
    (tmp_path / "empty" / "a").write_text("")
    assert json_lines(spark, str(tmp_path / "empty"), "id long").count() == 0
    for path, columns, message in ((tmp_path / "none", "id long", "no such file"), (tmp_path, "Malformed string", "clash"), (tmp_path, "id map<string, long>", "types")):
        with pytest.raises(Exception, match=message):
            json_lines(spark, str(path), columns).count()


def rows_of(spark, tmp_path):
    found = spark.read.schema("id long, malformed string").parquet(str(tmp_path / "out"))
    return sorted(((r.id, r.malformed) for r in found.collect()), key=str)


def run(spark, tmp_path):
    stream = json_lines(spark, str(tmp_path / "in"), "id long", stream=True, partition_bytes=7)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_follows_growing_files_once_each_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "2024-01-01"
    line = lambda i: json.dumps({"id": i})
    log.write_text(line(1) + "\n" + line(2)[:4])
    run(spark, tmp_path)
    assert rows_of(spark, tmp_path) == [(1, None)]
    with log.open("a") as f:
        f.write(line(2)[4:] + "\n{\n" + line(3))
    run(spark, tmp_path)
    assert rows_of(spark, tmp_path) == [(1, None), (2, None), (None, "{")]
    (tmp_path / "in" / "2024-01-02").write_text(line(4) + "\n")
    run(spark, tmp_path)
    run(spark, tmp_path)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in found.where("id is not null").collect()) == [1, 2, 3, 4] and found.count() == 5


def test_a_stream_stops_where_lines_would_be_lost(tmp_path):
    from pyspark.sql import types as T

    for name in "bd":
        (tmp_path / name).write_text('{"id": 1}\n')
    reader = jsonlines.StreamReader(T.StructType().add("id", "long"), {"path": str(tmp_path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    first = reader.partitions(start, end)
    (tmp_path / "e").write_text('{"id": 2}\n')
    assert reader.partitions(start, end) == first and len(reader.partitions(end, reader.latestOffset())) == 1
    (tmp_path / "d").write_text("")
    with pytest.raises(ValueError, match="shrank"):
        reader.partitions(start, end)
    (tmp_path / "c").write_text('{"id": 3}\n')
    with pytest.raises(ValueError, match="behind"):
        reader.partitions(end, reader.latestOffset())


def test_a_table_survives_the_round_trip(spark, tmp_path):
    rows = [(1, 0.1, "é\n\"\u2028", True, datetime(2024, 1, 2, 3, 4, 5, 6)), (2, 1e300, "", False, datetime(1969, 12, 31)), (3, None, None, None, None)]
    write_json_lines(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "t"))
    found = json_lines(spark, str(tmp_path / "t"), COLUMNS)
    assert found.where("malformed is null").drop("malformed").orderBy("id").collect() == rows and found.count() == 3
