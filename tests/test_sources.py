"""Files, ingest and streams."""

import gzip
import json
import zipfile

from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.streaming import ingest as streams

DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>First </w:t><w:t>line</w:t></w:r></w:p><w:p/></w:body></w:document>'


def test_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hello \xff world\n" + b"x" * 2000)
    (tmp_path / "sub/copy.TXT").write_bytes((tmp_path / "a.txt").read_bytes())
    (tmp_path / "empty.txt").write_bytes(b"  ")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"1")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", DOCX)
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    found = files.discover(spark, str(tmp_path))
    assert found.count() == 6
    status, chunks = files.ingest(found, spark.createDataFrame([], "sha256 string"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in status.collect()}
    assert {n: r["status"] for n, r in got.items()} == {"a.txt": "ingested", "copy.TXT": "skipped_duplicate", "empty.txt": "error", "c.pdf": "error", "d.docx": "ingested", "bad.docx": "error"}
    assert got["a.txt"]["n_chunks"] == 2 or got["a.txt"]["n_chunks"] == 3
    words = {r["content"] for r in chunks.collect()}
    assert "First line\na | b" in words and any("hello � world" in w for w in words)
    again, none = files.ingest(found, status.select("sha256"))
    assert {r["status"] for r in again.collect()} == {"skipped_duplicate"} and none.count() == 0


def test_pdf_provider(spark):
    parsers = files.PARSERS | {"pdf": lambda content: [(1, "x"), (2, "")]}
    assert files.parse_one("a.pdf", b"", parsers) == ("needs_ocr", "", [(1, "x")])
    assert files.parse_one("A.PDF", b"", files.PARSERS | {"pdf": lambda c: [(1, "long enough to be a text")]})[0] == "ingested"


def test_jsonl(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps({"a": 1, "t": "x y"}, ensure_ascii=False) + "\n\n" + json.dumps({"a": 2}) + "\n")
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "a int, t string").collect()
    assert sorted((r["a"], r["t"]) for r in got) == [(1, "x y"), (2, None)]


def test_stream(spark, tmp_path):
    schema, src, out = "doc_id long, text string", str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(3, "a"), (4, "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.ingest_stream(spark, src, schema, out, str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert {r["text"] for r in got.collect()} == {"a", "b", "c"} and got.count() == 3


def test_activity_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = streams.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.sql("SELECT * FROM activity").collect()} == {tuple(r) for r in streams.activity(events).collect()}
    assert events.count() == spark.sql("SELECT sum(n) FROM activity").first()[0]
