"""Folders as a data source."""

import zipfile

from lexmill.sources import datasource


def test_a_folder_of_files(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("One text.\nTwo lines.")
    (tmp_path / "sub" / "b.TXT").write_bytes(b"\xff broken bytes are replaced")
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "other.csv").write_text("1,2")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Said in Word</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    read = spark.read.format(datasource.FORMAT)
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in read.load(str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a.txt": "ingested", "sub/b.TXT": "ingested", "empty.txt": "error", "bad.docx": "error", "c.pdf": "error", "d.docx": "ingested"}
    assert rows["d.docx"]["blocks"][0]["text"] == "Said in Word" and rows["a.txt"]["length"] == 20 and len(rows["a.txt"]["sha256"]) == 64
    own = read.option("suffixes", "txt").option("recursive", "false").option("partitionBytes", "1").load(f"file://{tmp_path}")
    assert own.rdd.getNumPartitions() == 2 and own.count() == 2
    assert read.option("wholeBytes", "3").load(f"{tmp_path}/a.txt").first()["status"] == "error"
