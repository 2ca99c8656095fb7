import gzip
import hashlib

from pyspark.sql import functions as F

from voxelspan.llm import warc
from voxelspan.llm.common import shared_dir

PAGES = "page_id bigint, url string, html string"


def pages():
    long, edge = "é" * 700, "x" * 1000
    data = [(1, "http://a/1", long), (5, "http://a/5", long), (3, "http://a/3", long), (4, None, "x" * 999), (6, "u", "x" * 999), (7, "u\r\nWARC-Type: metadata", edge), (9, "v", edge)]
    data += [(10, "n", None), (11, "e", ""), (12, "big", "b\r\n\r\n" * 300000), (9, "v", edge), (None, "w", edge), (None, "w", "y" * 2000), (None, "w2", "y" * 2000)]
    return data


def want(data):
    out = []
    for k, (i, u, h) in enumerate(data):
        b = (h or "").encode()
        same = [(x[0] is not None, x[0] or 0) for x in data if (x[2] or "").encode() == b]
        top = max(same)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), len(b) >= 1000 and len(same) > 1, top[1] if top[0] else None))
    return out


def test_round_trip(spark):
    data = pages()
    got = warc.round_trip(spark.createDataFrame(data, PAGES).withColumns({"payload": F.lit(1), "row": F.lit("x")})).collect()
    groups = {}
    for i, n, d, shared, top in want(data):
        groups.setdefault(d, []).append((i, n, shared, top))
    assert len(got) == len(data)
    for d, rows in groups.items():
        mine = [r for r in got if r["payload_digest"] == d]
        assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in mine) == sorted((str(x[0]), x[1]) for x in rows)
        responses = [r for r in mine if r["record_type"] == "response"]
        if rows[0][2]:
            assert [r["page_id"] for r in responses] == [rows[0][3]]
            assert {r["refers_to"] for r in mine if r["record_type"] == "revisit"} == {rows[0][3]}
        else:
            assert len(responses) == len(mine)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_pushdown_skips_other_records(spark):
    folder = shared_dir(spark)
    warc.write(warc.mark_revisits(spark.createDataFrame(pages(), PAGES)), folder)
    warc.register(spark)
    rows = spark.read.format("warc").load(folder)
    assert {r["page_id"] for r in rows.where("record_type = 'revisit'").collect()} >= {1, 3, 7}
    hit = rows.where("page_id in (4, 12)").select("page_id", F.octet_length("payload").alias("n")).collect()
    assert sorted(map(tuple, hit)) == [(4, 999), (12, 1500000)]
    bare = spark.read.format("warc").option("payload", "false").load(folder).where("page_id = 12").first()
    assert bare["payload"] is None and bare["payload_bytes"] == 1500000 and bare["payload_digest"] == hashlib.sha1(b"b\r\n\r\n" * 300000).hexdigest()


def test_archives_of_other_writers(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <b>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one) + gzip.compress(info))
    (tmp_path / "b.warc").write_bytes(info + one)
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}")
    assert sorted((r["record_type"], bytes(r["payload"])) for r in rows.collect()) == [("response", b"hello")] * 2 + [("warcinfo", b"abc")] * 3
    assert [r["payload_bytes"] for r in rows.where("record_id = '<a>'").collect()] == [5, 5]


def test_damaged_records(spark, tmp_path):
    folder = f"file://{tmp_path}/x"
    (tmp_path / "x").mkdir()
    data = [(i, "u", "text %d " % i * 3000) for i in range(6)]
    warc.write(warc.mark_revisits(spark.createDataFrame(data, PAGES).coalesce(1)), folder)
    file = next((tmp_path / "x").glob("*.warc.gz"))
    whole = file.read_bytes()
    starts = [i for i in range(len(whole)) if whole[i : i + 4] == b"\x1f\x8b\x08\x04"]
    broken = bytearray(whole)
    broken[starts[2] + 60 : starts[2] + 90] = b"\xff" * 30
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "broken.warc.gz").write_bytes(broken)
    (tmp_path / "y" / "cut.warc.gz").write_bytes(whole[: starts[4] + 100])
    warc.register(spark)
    read = spark.read.format("warc")
    for name in ("broken", "cut"):
        try:
            read.load(f"file://{tmp_path}/y/{name}.warc.gz").collect()
            raise AssertionError
        except Exception as e:
            assert f"{name}.warc.gz" in str(e)
    order = [r["page_id"] for r in read.load(folder).collect()]
    got = [r["page_id"] for r in read.option("damaged", "skip").load(f"file://{tmp_path}/y/broken.warc.gz").collect()]
    assert got == order[:2] + order[3:]
    got = [r["page_id"] for r in read.option("damaged", "skip").load(f"file://{tmp_path}/y/cut.warc.gz").collect()]
    assert got == order[:4]


def test_query_sql_on_repeated_rows(spark, tmp_path):
    duckdb = __import__("duckdb")
    docs = spark.createDataFrame(pages(), PAGES)
    docs.write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    found = con.execute(f"SELECT {', '.join(names)} FROM ({warc.ROUND_TRIP_SQL})").fetchall()
    mine = warc.round_trip(docs).withColumn("target_uri", F.regexp_replace(F.regexp_replace("target_uri", "%0D", "\r"), "%0A", "\n"))
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in mine.select(*names).collect())


def _read(path, damaged, payload="true"):
    """The first rows only: a reader that doesn't end would give more."""
    from itertools import islice

    from pyspark.sql.types import _parse_datatype_string as parse

    reader = warc.Reader({"path": f"file://{path}", "damaged": damaged, "payload": payload}, parse(warc.SCHEMA))
    return [dict(zip(reader.names, r))["record_id"] for p in reader.partitions() for r in islice(reader.read(p), 50)]


def test_lengths_that_lead_nowhere_end_the_read(tmp_path):
    import struct

    import pytest

    good = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <good>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bad = lambda n: b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <bad>\r\nContent-Length: %s\r\n\r\nabc\r\n\r\n" % n
    for i, n in enumerate((b"-1", b"-9", b"-200", b"-100000", b"900", b"9999999999", b"x")):
        path = tmp_path / f"{i}.warc"
        path.write_bytes(good + bad(n) + good)
        for payload in ("true", "false"):
            with pytest.raises(ValueError):
                _read(path, "fail", payload)
            assert _read(path, "skip", payload) in (["<good>"], ["<good>", "<good>"])
    zero = tmp_path / "zero.warc"
    zero.write_bytes(good + bad(b"0").replace(b"abc", b"") + good)
    assert _read(zero, "fail") == ["<good>", "<bad>", "<good>"]
    assert _read(zero, "skip") == ["<good>", "<bad>", "<good>"]
    member = warc.record(7, "u", b"payload " * 40, 320, "00", None, False)
    at = member.index(b"sl") + 4
    for i, n in enumerate((0, 1, 19, 60, len(member) + 5, 0xFFFFFFFF)):
        path = tmp_path / f"{i}.warc.gz"
        path.write_bytes(member + member[:at] + struct.pack("<I", n) + member[at + 4 :] + member)
        for payload in ("true", "false"):
            with pytest.raises(ValueError):
                _read(path, "fail", payload)
            assert 1 <= len(_read(path, "skip", payload)) <= 3
    (tmp_path / "empty.warc").write_bytes(b"")
    assert _read(tmp_path / "empty.warc", "fail") == []
