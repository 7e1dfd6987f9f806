import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm import warc

SCHEMA = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType())]
)
LONG = "<p>é😀</p>\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [(7, "http://a/\r\nX: 1", LONG, "c"), (3, None, LONG, "c"), (9, "u", "short", ""), (8, "u", "short", ""), (1, "u", None, ""), (2, "", "", "")]
ROWS += [(None, "n", LONG, ""), (3, None, LONG, ""), (11, "big", "x" * 3_000_000, "")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    warc.write_warc(warc.with_revisits(spark.createDataFrame(ROWS, SCHEMA).repartition(3)), folder)
    return folder


def test_round_trip(spark, archive):
    got = sorted(((r.record_id, r.record_type, r.target_uri, r.payload_bytes, r.refers_to, r.payload_digest, r.payload) for r in warc.read_warc(spark, archive).collect()), key=repr)
    want = []
    for page, url, html, _ in ROWS:
        body = (html or "").encode()
        again = page == 7
        urn = None if page is None else f"<urn:page:{page}>"
        uri = url.replace("\r", " ").replace("\n", " ") if url is not None else None
        want.append((urn, "revisit" if again else "response", uri, len(body), "<urn:page:3>" if again else None, "sha256:" + hashlib.sha256(body).hexdigest(), None if again else body))
    assert got == sorted(want, key=repr)


def test_predicates_are_pushed_and_payloads_left_alone(spark, archive):
    few = warc.read_warc(spark, archive, payload=False).filter((F.col("record_type") == "revisit") | F.lit(False))
    assert [r.payload for r in few.collect()] == [None]
    big = warc.read_warc(spark, archive).filter(F.col("payload_bytes") > 1_000_000)
    assert [len(r.payload) for r in big.collect()] == [3_000_000]
    both = warc.read_warc(spark, archive).filter("record_type = 'response' AND target_uri IN ('u', 'n')")
    assert sorted(r.record_id or "" for r in both.collect()) == ["", "<urn:page:1>", "<urn:page:8>", "<urn:page:9>"]
    reader = warc.Reader(archive, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])) == [] and len(reader.tests) == 1
    rows = [x for s in reader.partitions() for b in reader.read(s) for x in b.to_pylist()]
    assert [x["record_type"] for x in rows] == ["revisit"]


def test_members_are_plain_gzip_and_foreign_members_are_read(tmp_path, archive):
    name = next(f for f in os.listdir(archive) if f.endswith(".warc.gz"))
    with gzip.open(os.path.join(archive, name)) as f:
        assert f.read().startswith(b"WARC/1.1\r\n")
    rows = [{"payload": bytes([65 + k]) * 5000, "record_type": "response", "record_id": f"<{k}>", "payload_digest": None} for k in range(3)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    size = (tmp_path / "x.warc.gz").stat().st_size
    got = [x for b in warc.Reader(str(tmp_path), True).read(warc.Split(str(tmp_path / "x.warc.gz"), 0, size)) for x in b.to_pylist()]
    assert [(g["record_id"], g["payload"]) for g in got] == [(r["record_id"], r["payload"]) for r in rows]


def test_folder_without_a_manifest(spark, tmp_path):
    for name, sizes in (("x", (5000, 10)), ("y", (20,))):
        rows = [{"payload": b"A" * n, "record_type": "response", "record_id": f"<{name}{n}>", "payload_digest": None} for n in sizes]
        plain = [b"\r\n".join(h for h in warc.record(r).split(b"\r\n") if not h.lower().startswith(b"x-payload-length")) for r in rows]
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in plain))
    back = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_id, r.payload_bytes, len(r.payload)) for r in back.collect()) == [("<x10>", 10, 10), ("<x5000>", 5000, 5000), ("<y20>", 20, 20)]
    assert sorted(r.record_id for r in back.filter("payload_bytes < 100").collect()) == ["<x10>", "<y20>"]


def test_files_of_failed_attempts_are_not_read_and_empty_tables_work(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_warc(warc.with_revisits(spark.createDataFrame([], SCHEMA)), folder)
    (tmp_path / "w" / "part-left.warc.gz").write_bytes(b"broken")
    assert warc.read_warc(spark, folder).collect() == []


def test_members_of_many_records_plain_files_and_nested_folders(spark, archive, tmp_path):
    rows = [{"payload": bytes([65 + k]) * (90_000 * (k % 3)), "record_type": "response", "record_id": f"<{k}>"} for k in range(6)]
    texts = [warc.record(r) for r in rows]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(b"".join(texts[:3])) + gzip.compress(texts[3]))
    (tmp_path / "plain.warc").write_bytes(b"".join(texts[4:]))
    back = warc.read_warc(spark, str(tmp_path))
    assert sorted((r.record_id, r.payload) for r in back.collect()) == [(r["record_id"], r["payload"]) for r in rows]
    assert [r.record_id for r in back.filter("record_id = '<5>'").collect()] == ["<5>"]
    assert sorted(r.record_id for r in back.filter("payload_bytes >= 90000").collect()) == ["<1>", "<2>", "<4>", "<5>"]
    # Beside a manifest, files of other writers are read too.
    folder = str(tmp_path / "own")
    warc.write_warc(warc.with_revisits(spark.createDataFrame(ROWS[:2], SCHEMA)), folder)
    (tmp_path / "own" / "more.warc").write_bytes(texts[0])
    assert sorted(r.record_id for r in warc.read_warc(spark, folder).collect()) == ["<0>", "<urn:page:3>", "<urn:page:7>"]


def test_broken_archives_are_errors(tmp_path):
    text = warc.record({"payload": b"x" * 500, "record_type": "response", "record_id": "<1>"})
    for name, data in (("a.warc", text[:-100]), ("b.warc", b"no header"), ("c.warc.gz", gzip.compress(text)[:-60]), ("d.warc.gz", b"broken file")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(OSError):
            list(warc.Reader(str(tmp_path), True).read(warc.Split(str(tmp_path / name), 0, len(data))))
