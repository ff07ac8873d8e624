"""Files as sources: discovery, text, Word and PDF parsing, JSON lines; and the ingest pipeline.

Spark lists and reads the files; a Python parser sees one file's bytes at a time. A file that can't be parsed is a row with a
status, never an exception.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunk_text, strip

SUPPORTED = ["pdf", "docx", "txt"]
LEAST_CHARS = 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Block = tuple[int | None, str]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of the supported files below root (or of one file), in order of path when collected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SUPPORTED)).select("path", "length", "content")


def parse_text(content: bytes) -> list[Block]:
    return [(None, content.decode("utf-8", errors="replace"))]


def parse_docx(content: bytes) -> list[Block]:
    """Paragraphs that aren't blank, then the tables' rows with cells joined by bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{WORD}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    lines = [words(p) for p in body.findall(f"{WORD}p")]
    lines = [x for x in lines if x.strip()]
    for table in body.findall(f"{WORD}tbl"):
        for row in table.findall(f"{WORD}tr"):
            lines.append(" | ".join(words(cell).strip() for cell in row.findall(f"{WORD}tc")))
    return [(None, "\n".join(lines))]


#: Parsers by suffix; a PDF parser is plugged in where there is one: it gives the text of each page, from 1.
PARSERS: dict[str, Callable[[bytes], list[Block]]] = {"txt": parse_text, "text": parse_text, "docx": parse_docx}

PARSED = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())]))),
    ]
)


def parse_one(path: str, content: bytes, parsers: dict[str, Callable[[bytes], list[Block]]]) -> tuple[str, str, list[Block]]:
    parser = parsers.get(os.path.splitext(path)[1].lower().lstrip("."))
    if parser is None:
        return "error", "no parser for this kind of file", []
    try:
        blocks = [(p, t) for p, t in parser(content) if t.strip()]
    except Exception as e:  # one bad file is one row
        return "error", f"{type(e).__name__}: {e}"[:500], []
    if path.lower().endswith(".pdf") and sum(len(t.strip()) for _, t in blocks) < LEAST_CHARS:
        return "needs_ocr", "", blocks
    return ("ingested" if blocks else "error"), ("" if blocks else "no text"), blocks


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[Block]]] | None = None) -> DataFrame:
    """path, sha256, status, detail, blocks of files (path, content)."""
    known = parsers or PARSERS

    @F.pandas_udf(PARSED)
    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [parse_one(p, c, known) for p, c in zip(path, content)]
        return pd.DataFrame([(s, d, [{"page": p, "text": t} for p, t in b]) for s, d, b in rows], columns=["status", "detail", "blocks"])

    return files.select("path", F.sha2("content", 256).alias("sha256"), run("path", "content").alias("r")).select("path", "sha256", "r.*")


def ingest(files: DataFrame, known: DataFrame, parsers: dict[str, Callable[[bytes], list[Block]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Status rows (path, sha256, status, detail, n_chunks) and chunks (sha256, chunk_index, page, content).

    known: sha256 of what is there already; known and repeated contents are told apart by hash before anything is parsed.
    """
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    first = hashed.groupBy("sha256").agg(F.min("path").alias("path"))
    new = first.join(known.select("sha256"), "sha256", "left_anti")
    parsed = parse(hashed.join(new, ["sha256", "path"]).select("path", "content"), parsers)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("content", T.StringType())])))
    def cut(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda own: [{"page": b["page"], "content": c} for b in own for c in chunk_text(b["text"])])

    chunked = parsed.withColumn("chunks", cut("blocks"))
    chunks = chunked.filter("status = 'ingested'").select("sha256", F.posexplode("chunks").alias("chunk_index", "c")).select("sha256", "chunk_index", "c.page", "c.content")
    seen = hashed.select("path", "sha256").join(new.select("path"), "path", "left_anti").select("path", "sha256", F.lit("skipped_duplicate").alias("status"), F.lit("").alias("detail"), F.lit(0).alias("n_chunks"))
    status = chunked.select("path", "sha256", "status", "detail", F.size("chunks").alias("n_chunks")).unionByName(seen)
    return status, chunks


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, plain or gzipped; lines end at \\n alone, as texts hold other separators; blank lines are skipped."""
    lines = spark.read.option("lineSep", "\n").text(path).filter(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def largest_text(files: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Of several texts for the same keys the longest; of equally long ones that of the least `order`, where it is given."""
    size = F.struct(F.length("text"), -F.col(order)) if order else F.length("text")
    return files.filter("text IS NOT NULL").groupBy(*keys).agg(F.max_by("text", size).alias("text"))


def content_path(sha256: str, suffix: str) -> str:
    """Where a content-addressed store keeps an original."""
    return f"{sha256[:2]}/{sha256}{suffix}"
