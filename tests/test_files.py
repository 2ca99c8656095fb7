import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.schema import Header
from voxelspan.sources import las, parts
from voxelspan.streaming import assembly


def file_of(fmt, records, extra=b"", count=None, offset=(0.0, 0.0, 0.0)):
    length = las.RECORD_LENGTH.get(fmt, 40)
    h = Header(len(records) if count is None else count, (0.5, 0.25, 0.125), offset, (0, 0, 0), (10, 10, 10), fmt, length, 240)
    out = las.header_bytes(h)
    for i, (x, y, z, intensity, cls, rgb) in enumerate(records):
        r = bytearray(length)
        struct.pack_into("<iiiH", r, 0, x, y, z, intensity)
        r[15] = cls
        if fmt in las.COLOUR_AT:
            struct.pack_into("<HHH", r, las.COLOUR_AT[fmt], *rgb)
        out += bytes(r)
    return out + extra


RECORDS = [(i - 2, 10 * i, -i, 60000 + i, [0, 1, 2, 16, 17, 255][i % 6], (i % 2 * 65535, 0, i)) for i in range(25)]


@pytest.mark.parametrize("fmt", [0, 1, 2, 3])
@pytest.mark.parametrize("cuts", [[], [100], [241, 250, 300, 301]])
def test_read_in_parts(spark, tmp_path, fmt, cuts):
    data = file_of(fmt, RECORDS, extra=b"trailing bytes that are longer than a record or two, all the same")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)])):
        (tmp_path / f"part-{k}.las").write_bytes(data[a:b])
    las.register(spark)
    rows = spark.read.format("las").option("recordsPerPartition", "7").load(f"file://{tmp_path}").orderBy("pos").collect()
    colours = [r[5] if fmt in las.COLOUR_AT else (0, 0, 0) for r in RECORDS]
    assert [tuple(r) for r in rows] == [(i, *r[:5], *c) for i, (r, c) in enumerate(zip(RECORDS, colours))]
    few = spark.read.format("las").option("recordsPerPartition", "7").load(f"file://{tmp_path}").where("pos >= 5 and pos < 9").select("iy", "pos")
    assert sorted(tuple(r) for r in few.collect()) == [(10 * i, i) for i in range(5, 9)]


def test_points_and_modes(spark, tmp_path):
    path = tmp_path / "a.las"
    path.write_bytes(file_of(2, RECORDS[:2], offset=(100.0, 200.0, 300.0)))
    seen = las.read_points(spark, f"file://{path}").orderBy("pos").collect()[1]
    assert (seen["x"], seen["y"], seen["z"], seen["r"], seen["g"]) == (-0.5, -0.125, 2.5, 257.0, 1.0)
    meant = las.read_points(spark, f"file://{path}", "intended").orderBy("pos").collect()[1]
    assert (meant["x"], meant["y"], meant["z"]) == (99.5, 299.875, 202.5)
    path.write_bytes(file_of(6, RECORDS[:2]))
    assert las.read_points(spark, f"file://{path}").count() == 2
    with pytest.raises(Exception, match="not known"):
        las.read_points(spark, f"file://{path}", "intended").count()


@pytest.mark.parametrize("count,there,want", [(0, 3, 0), (5, 3, 3), (2, 3, 2)])
def test_counts(spark, tmp_path, count, there, want):
    path = tmp_path / "a.las"
    path.write_bytes(file_of(1, RECORDS[:there], count=count)[: None if count != 5 else -1] + (b"\0" if count == 5 else b""))
    assert las.read_points(spark, f"file://{path}").count() == want


def test_written_file(spark):
    h = Header(4, (0.5, 0.25, 0.125), (0, 0, 0), (0, 0, 0), (10, 10, 10))
    pts = spark.createDataFrame([(0, 1.2, 2.0, 3.0, 9.0, 5.0), (1, -0.1, 2.0, 3.0, 9.0, 5.0), (2, 1.0, -1.0, 3.0, 9.0, 5.0), (3, 1.0, 1.0, 0.0, 9.0, 5.0)], "pos bigint, x double, y double, z double, intensity double, classification double")
    assert [tuple(r) for r in las.file_records(pts, h).orderBy("pos").collect()] == [(0, 2, 24, 8, 9, 2), (3, 2, 0, 4, 9, 2)]
    assert [tuple(r) for r in las.file_records(pts, h, "intended").where("pos = 1").collect()] == [(1, 0, 12, 16, 9, 5)]
    records = spark.createDataFrame([(i, i, -i, 7, i % 9, 3, 1, 2, 3) for i in range(50)], las.SCHEMA).repartition(6)
    assert sorted(map(tuple, las.round_trip(records, h).collect())) == sorted(map(tuple, records.collect()))


def upload(*numbers, total=3, who="u"):
    return [(who, n, total, bytes([65 + n])) for n in numbers]


SCHEMA = "uploader_id string, chunk_number int, total_chunks int, content binary"


def test_batch_assembly(spark):
    df = spark.createDataFrame(upload(2, 0, 1, 1) + upload(0, 1, 1, who="v") + upload(0, total=1, who="w"), SCHEMA)
    state = {r["uploader_id"]: (r["triggered"], r["complete"]) for r in assembly.upload_state(df).collect()}
    assert state == {"u": (True, True), "v": (True, False), "w": (True, True)}
    assert {r["uploader_id"]: r["content"] for r in assembly.assemble(df.withColumn("content", F.col("content").cast("string"))).collect()} == {"u": "ABC", "w": "A"}


def test_landing_folder_and_json(spark, tmp_path):
    for n in (1, 0):
        (tmp_path / f"up.{n}.2.part").write_bytes(bytes([48 + n]))
    (tmp_path / "other.txt").write_text("x")
    assert sorted((r["uploader_id"], r["chunk_number"], r["total_chunks"], bytes(r["content"])) for r in parts.read_parts(spark, f"file://{tmp_path}").collect()) == [("up", 0, 2, b"0"), ("up", 1, 2, b"1")]
    (tmp_path / "p.json").write_text(json.dumps({"points": [float(i) for i in range(16)]}))
    rows = parts.read_json_points(spark, f"file://{tmp_path}/p.json").orderBy("pos").collect()
    assert [(r["pos"], r["x"], r["classification"]) for r in rows] == [(0, 0.0, 7.0), (1, 8.0, 15.0)]


def wait(done, seconds=60):
    """A query with timeouts runs on without data, so it can't be asked whether it has seen all."""
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)
    assert done()
    time.sleep(0.5)


def test_stream_is_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = assembly.assemble_stream(parts.stream_parts(spark, f"file://{folder}"))
    q = stream.writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    try:
        for names in (["a.2.3", "b.0.1", "c.1.2"], ["a.0.3", "a.9.3"], ["a.1.3"], ["a.1.3x"]):
            for n in names:
                (folder / f"{n.rstrip('x')}.part{'x' * n.count('x')}").write_bytes(n[:3].encode())
            wait(lambda: q.lastProgress and sum(p["numInputRows"] for p in q.recentProgress) >= sum(1 for _ in folder.glob("*.part")))
        assert {(r["uploader_id"], r["n_parts"], bytes(r["content"])) for r in spark.table("whole").collect()} == {("b", 1, b"b.0"), ("a", 3, b"a.0a.1a.2")}
    finally:
        q.stop()


def test_session_points(spark):
    rows = [("s", 0, "points", "a"), ("s", 2, "points", "c"), ("s", 1, "points", "b"), ("s", 3, "done", None), ("s", 4, "points", "late"), ("t", 0, "points", "x")]
    got = assembly.session_points(spark.createDataFrame(rows, "session string, seq int, event string, payload string")).collect()
    assert sorted(map(tuple, got)) == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c")]


def test_clicks_make_shapes(spark):
    rows = [("s", i) for i in range(7)]
    got = assembly.click_shapes(spark.createDataFrame(rows, "s string, i int"), "s", ["i"], 3).collect()
    assert sorted((r["i"], r["shape_no"]) for r in got) == [(i, i // 3) for i in range(7)]


def test_click_stream_is_the_batch(spark, tmp_path):
    folder = tmp_path / "clicks"
    folder.mkdir()
    stream = assembly.click_stream(spark.readStream.schema("session bigint, event_id bigint").json(f"file://{folder}"), 3)
    q = stream.writeStream.format("memory").queryName("shapes").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck2").start()
    try:
        for k, rows in enumerate(([(1, 1), (2, 2), (1, 3)], [(1, 4), (1, 5), (2, 6)], [(2, 7), (1, 8), (1, 9), (1, 10)])):
            (folder / f"{k}.json").write_text("\n".join(json.dumps({"session": a, "event_id": b}) for a, b in rows))
            wait(lambda: q.lastProgress and sum(p["numInputRows"] for p in q.recentProgress) >= 3 * k + 3)
        got = sorted((r["session"], r["shape_no"], list(r["clicks"])) for r in spark.table("shapes").collect())
        assert got == [(1, 0, [1, 3, 4]), (1, 1, [5, 8, 9]), (2, 0, [2, 6, 7])]
    finally:
        q.stop()


def test_options_lie_beside_the_parts(spark, tmp_path):
    (tmp_path / "up.1.options.json").write_text(json.dumps({"clustering": "T", "lod": "yes", "density": "12.5"}))
    (tmp_path / "v.options.json").write_text("{}")
    (tmp_path / "v.0.1.part").write_bytes(b"x")
    got = sorted(map(tuple, parts.read_options(spark, f"file://{tmp_path}").collect()))
    assert got == [("up.1", True, False, False, 12.5), ("v", False, False, False, 0.0)]


def test_intended_mode_rejects_later_versions(spark, tmp_path):
    data = bytearray(file_of(1, RECORDS))
    data[24:26] = b"\x01\x04"
    (tmp_path / "late.las").write_bytes(data)
    assert las.read_points(spark, f"file://{tmp_path}/late.las").count() == len(RECORDS)
    with pytest.raises(Exception, match="version 1.4"):
        las.read_points(spark, f"file://{tmp_path}/late.las", mode="intended").count()


def test_reduced_file_keeps_the_header(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(file_of(2, RECORDS))
    source, out = f"file://{tmp_path}/a.las", f"file://{tmp_path}/out"
    records = spark.createDataFrame([(5, 1, 2, 3, 4, 2)], "pos bigint, ix int, iy int, iz int, intensity int, classification int")
    las.write_reduced(records, source, out, 2)
    a, b = las.read_header(source), las.read_header(out)
    assert b.count == 1 and (a.scale, a.low, a.high, a.format_id, a.record_length) == (b.scale, b.low, b.high, b.format_id, b.record_length)
    assert [tuple(r) for r in spark.read.format("las").load(out).collect()] == [(0, 1, 2, 3, 4, 2, 0, 0, 0)]


def test_header_fields_stand_where_files_have_them():
    data = las.header_bytes(Header(7, (1, 2, 3), (4, 5, 6), (-1, -2, -3), (10, 20, 30), 2, 26, 227))
    assert struct.unpack_from("<I", data, 96) == (227,) and data[104] == 2 and struct.unpack_from("<HI", data, 105) == (26, 7)
    assert struct.unpack_from("<12d", data, 131) == (1, 2, 3, 4, 5, 6, 10, -1, 20, -2, 30, -3)


def test_writer_commits_whole_files_or_nothing(spark, tmp_path):
    las.register(spark)
    head = las.header_bytes(Header(0, (1.0, 1.0, 1.0), format_id=2, record_length=26)).hex()
    rows = spark.createDataFrame([(i, i, -i, 7, i % 9, 3, 1, 2, 3) for i in range(90)], las.SCHEMA)
    target = f"file://{tmp_path}/cloud"
    save = lambda df, mode: df.repartitionByRange(5, "pos").sortWithinPartitions("pos").write.format("las").option("head", head).mode(mode).save(target)
    save(rows, "append")
    read = lambda: sorted(map(tuple, spark.read.format("las").load(target).collect()))
    assert read() == sorted(map(tuple, rows.collect())) and las.read_header(target).count == 90
    assert len(list((tmp_path / "cloud").glob("part-*.las"))) == 6 and not list((tmp_path / "cloud").glob(".*-*"))
    with pytest.raises(Exception, match="holds a point file"):
        save(rows, "append")

    def fails(batches):
        for b in batches:
            yield b
        if 70 in b.column("pos").to_pylist():
            raise RuntimeError("lost")

    lost = rows.repartitionByRange(5, "pos").sortWithinPartitions("pos").mapInArrow(fails, rows.schema)
    for mode in ("overwrite", "append"):
        folder = tmp_path / f"lost-{mode}"
        with pytest.raises(Exception, match="lost"):
            lost.write.format("las").option("head", head).mode(mode).save(f"file://{folder}")
        assert not list(folder.glob("*.las"))
    with pytest.raises(Exception, match="lost"):
        lost.write.format("las").option("head", head).mode("overwrite").save(target)
    assert len(read()) == 90  # a write that fails leaves what was there
    save(rows.where("pos < 7"), "overwrite")
    assert [r[0] for r in read()] == list(range(7))
    save(rows.where("false"), "overwrite")
    assert read() == [] and las.read_header(target).count == 0
    with pytest.raises(Exception, match="overlap"):
        rows.repartition(3).write.format("las").option("head", head).mode("append").save(f"file://{tmp_path}/mixed")
    assert not list((tmp_path / "mixed").glob("*.las"))


def point_file_bytes(n, shift=0):
    h = Header(n, (0.5, 0.5, 0.5), format_id=2, record_length=26)
    rows = np.zeros(n, las.record_type(2, 26))
    rows["ix"], rows["iy"], rows["iz"], rows["classification"] = np.arange(n) + shift, 2, 3, 4
    return las.header_bytes(h) + rows.tobytes()


def test_messages_of_streamed_uploads_come_once(spark, tmp_path):
    from voxelspan.streaming import messages

    messages.register(spark)
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()

    def land(who, data, which, total=3):
        size = -(-len(data) // total)
        for k in which:
            (folder / f"{who}.{k}.{total}.part").write_bytes(data[k * size : (k + 1) * size])

    def run():
        whole = assembly.assemble_stream(parts.stream_parts(spark, f"file://{folder}"), expire_ms=None)
        q = messages.point_messages(whole, window=250).writeStream.format("messages").option("path", out).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)

    files = {"a": point_file_bytes(700), "b": point_file_bytes(10, 5), "c": point_file_bytes(251, 9)}
    land("a", files["a"], (2, 0))
    land("b", files["b"], (0, 1, 2))
    run()
    assert {r["uploader_id"] for r in messages.read_messages(spark, out).collect()} == {"b"}
    land("a", files["a"], (1,))
    run()  # a new run goes on from the checkpoint: parts of a that came before are in its state
    # the last batch's commit is lost: the restart does that batch again
    commits = sorted((int(f.name), f) for f in (tmp_path / "ck" / "commits").glob("[0-9]*"))
    commits[-1][1].unlink()
    crc = commits[-1][1].parent / f".{commits[-1][0]}.crc"
    crc.unlink(missing_ok=True)
    land("c", files["c"], (0, 1, 2))
    run()
    run()
    got = sorted(map(tuple, messages.read_messages(spark, out).collect()))
    batch = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "uploader_id string, content binary")
    assert got == sorted(map(tuple, messages.point_messages(batch, window=250).collect()))
    first = json.loads(next(g[3] for g in got if g[:3] == ("a", 0, 0)))
    assert len(first["Points"]) == 162 * 8 and first["TotalChunks"] == 2 + 2 + 2 and first["Points"][8:11] == [0.5, 1.5, 1.0]
    assert [(w, c) for who, w, c, _ in got if who == "a"] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert not list((tmp_path / "out").glob(".*-*"))
    # a batch without its manifest isn't there
    last = max((tmp_path / "out").glob("*.manifest"))
    last.unlink()
    assert len(messages.read_messages(spark, out).collect()) < len(got)


def test_parts_come_late_repeated_and_after_the_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run(names):
        for n in names:
            (folder / f"{n}.part").write_bytes(n.encode())
        stream = assembly.assemble_stream(parts.stream_parts(spark, f"file://{folder}"), expire_ms=None, whole=False)
        q = stream.writeStream.format("json").option("path", f"file://{tmp_path}/got").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r["uploader_id"], r["chunk_number"], bytes(r["content"])) for r in spark.read.schema("uploader_id string, chunk_number int, content binary").json(f"file://{tmp_path}/got").collect())

    assert run(["x.1.2", "y.0.3", "y.5.3"]) == []
    first = run(["x.0.2", "y.2.3"])
    assert [(who, k) for who, k, _ in first] == [("x", 0), ("x", 1)]
    again = run(["y.1.3"])
    assert [(who, k) for who, k, _ in again] == [("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 2)]
    assert run(["z.0.1"])[-1][:2] == ("z", 0)


def test_an_upload_at_rest_is_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = assembly.assemble_stream(parts.stream_parts(spark, f"file://{folder}"), expire_ms=1500)
    q = stream.writeStream.format("memory").queryName("forgotten").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck3").start()
    try:
        (folder / "a.0.2.part").write_bytes(b"0")
        wait(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 1)
        wait(lambda: q.lastProgress and all(o["numRowsTotal"] == 0 for o in q.lastProgress["stateOperators"]))
        (folder / "a.1.2.part").write_bytes(b"1")
        wait(lambda: sum(p["numInputRows"] for p in q.recentProgress) >= 2)
        assert spark.table("forgotten").count() == 0
    finally:
        q.stop()


def test_a_landed_upload_runs_as_its_options_say(spark, tmp_path):
    from voxelspan.plans import upload

    data, folder = point_file_bytes(500), tmp_path / "landing"
    folder.mkdir()
    size = -(-len(data) // 12)
    for k in range(12):
        (folder / f"u1.{k}.12.part").write_bytes(data[k * size : (k + 1) * size])
    (folder / "u1.options.json").write_text(json.dumps({"clustering": "true", "lod": "1", "density": "x"}))
    for k in range(2):
        (folder / f"u11.{k}.2.part").write_bytes(point_file_bytes(9)[k * 300 : (k + 1) * 300])
    las.register(spark)
    landed = f"file://{folder}"
    points = las.read_points(spark, f"{landed}/u1.*.part")
    assert sorted(r["x"] for r in points.collect()) == [0.5 * i for i in range(500)]  # part 10 after part 9
    out = upload.process_landed(spark, landed, "u11", "s")
    assert out.header.count == 9 and out.file is None and {r["event"] for r in out.messages.collect()} >= {"sessionId", "points", "done"}
    boxed = las.header_bytes(Header(500, (0.5, 0.5, 0.5), low=(0.0, 0.0, 0.0), high=(249.5, 2.0, 3.0), format_id=2, record_length=26)) + data[227:]
    for k in range(12):
        (folder / f"u1.{k}.12.part").write_bytes(boxed[k * size : (k + 1) * size])
    out = upload.process_landed(spark, landed, "u1", "s", depth=4)
    assert list(out.levels) == ["base", "medium", "low"] and out.file and las.read_header(out.file).count > 0
