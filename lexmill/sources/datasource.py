"""Folders of documents as a data source of Spark: `spark.read.format("document_files").load(folder)` gives a row for each file.

The driver lists the files; a partition holds some of them, about `partitionBytes` together; a task reads one at a time and yields its status and blocks, so a folder
with any number of files, or large ones, needs memory for one file a task. Options: path, suffixes (comma-separated, all that can be parsed by default),
recursive (true), partitionBytes (16 MB), wholeBytes (files beyond it are rows with an error, 256 MB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import PARSERS, SUPPORTED, parse_one

FORMAT = "document_files"
ROW = "path string, length long, sha256 string, status string, detail string, blocks array<struct<page:int,text:string>>"


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        if not low.get("path"):
            raise ValueError("give the folder to load")
        self.root = low["path"]
        self.suffixes = {s.strip().lower() for s in low.get("suffixes", ",".join(SUPPORTED)).split(",")}
        self.recursive = low.get("recursive", "true").lower() != "false"
        self.size, self.most = int(low.get("partitionbytes", 16_000_000)), int(low.get("wholebytes", 256_000_000))

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[Files]:
        """The files in order of path, in runs of about the size asked for."""
        system, path = self._place()
        one = system.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=self.recursive))
        own = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() in self.suffixes)
        parts, held = [[]], 0
        for f in own:
            if parts[-1] and held + f[1] > self.size:
                parts.append([])
                held = 0
            parts[-1].append(f)
            held += f[1]
        return [Files(p) for p in parts if p] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._place()
        for path, length in partition.paths:
            if length > self.most:
                yield path, length, None, "error", f"larger than {self.most} bytes", []
                continue
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
            except OSError as e:  # a file that has gone is a row, too
                yield path, length, None, "error", str(e)[:500], []
                continue
            status, detail, blocks = parse_one(path, content, PARSERS)
            yield path, length, hashlib.sha256(content).hexdigest(), status, detail, blocks


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
