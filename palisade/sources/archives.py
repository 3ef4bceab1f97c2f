"""Archives as a Spark data source: tasks read members by range, and what can't be read becomes a row.

`spark.dataSource.register(ZipSource)` and then `spark.read.format("zip_rows").option("path", ...)`, or read_archives. The
driver lists files and reads their tables of contents only; members are packed into partitions by size, and a task
opens an archive and reads its own members from it. Lines and CSV records are read as a stream; a JSON member is a list that is read
whole and so is limited in size, as are all members.

Defined results: a file that is no archive gives one row without a record, and so does a member that can't be read
from where it breaks; rows before that stay. An empty archive gives no rows. Members of other kinds, and those over the
limit, are left out. Paths are anything that pyarrow's file systems open: local files, or URIs of a store.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = "source string, file string, original_split string, ordinal long, row string"
MAX_MEMBER = 100 * 1024 * 1024
#: A partition takes members until it holds so many bytes.
PARTITION_BYTES = 64 * 1024 * 1024
_KINDS = (".json", ".jsonl", ".csv")
_BATCH = 1000


def _open(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The file, or the .zip files under a folder, in order."""
    from pyarrow import fs

    system, inner = _open(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".zip"))
    return [inner]


def _archive(f) -> zipfile.ZipFile:
    # a short file is read whole: looking for an archive's end before a file's start isn't an error of every file system
    return zipfile.ZipFile(io.BytesIO(f.read()) if f.size() < 65_536 else f)


def list_of_records(value) -> list:
    """A list, or the first list among an object's data, records and examples; else nothing."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("data", "records", "examples") if isinstance(value.get(k), list)), None)
    return value if isinstance(value, list) else []


def member_rows(stream, suffix: str) -> Iterator[str]:
    """The records of a member as JSON texts, one at a time but for .json."""
    if suffix == ".json":
        yield from (json.dumps(r) for r in list_of_records(json.loads(stream.read().decode("utf-8-sig"))))
        return
    text = io.TextIOWrapper(stream, "utf-8-sig", newline="" if suffix == ".csv" else "\n")
    if suffix == ".csv":
        yield from (json.dumps(r) for r in csv.DictReader(text))
    else:
        yield from (line.rstrip("\n") for line in text if line.strip())


def _suffix(name: str) -> str:
    return "." + name.rsplit("/", 1)[-1].rpartition(".")[2]


@dataclass
class Members(InputPartition):
    """(file, member names); no names: the file is no archive."""

    parts: list[tuple[str, list[str]]]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.source, self.split = options["path"], options.get("source", ""), options.get("split", "unspecified")
        self.most, self.bytes = int(options.get("maxMember", MAX_MEMBER)), int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, _ = _open(self.path)
        out: list[Members] = []
        held = self.bytes
        for file in _files(self.path):
            try:
                with system.open_input_file(file) as f, _archive(f) as archive:
                    items = [(i.filename, i.file_size) for i in archive.infolist() if _suffix(i.filename) in _KINDS and i.file_size <= self.most]
            except (zipfile.BadZipFile, OSError, ValueError):
                items = [("", 0)]
            for name, size in items:
                if held + size > self.bytes:
                    out.append(Members([]))
                    held = 0
                held += size + 4096
                parts = out[-1].parts
                if not parts or parts[-1][0] != file:
                    parts.append((file, []))
                if name:
                    parts[-1][1].append(name)
        return out or [Members([])]

    def _batch(self, file: str, split: str, at: int, rows: list[str | None]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.source] * n), pa.array([file] * n), pa.array([split] * n), pa.array(range(at, at + n), pa.int64()), pa.array(rows, pa.string())],
            names=["source", "file", "original_split", "ordinal", "row"],
        )

    def _member(self, archive: zipfile.ZipFile, name: str) -> Iterator[pa.RecordBatch]:
        split, rows, at = f"{self.split}/{name}", [], 0
        try:
            with archive.open(name) as stream:
                for row in member_rows(stream, _suffix(name)):
                    rows.append(row)
                    if len(rows) == _BATCH:
                        yield self._batch(name, split, at, rows)
                        at, rows = at + len(rows), []
        except Exception:  # encrypted, cut off, another compression, no text, no JSON: the rest is one row without a record
            rows.append(None)
        if rows:
            yield self._batch(name, split, at, rows)

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for file, names in partition.parts:
            if not names:
                yield self._batch(file.rsplit("/", 1)[-1], self.split, 0, [None])
                continue
            with system.open_input_file(file) as f, _archive(f) as archive:
                for name in names:
                    yield from self._member(archive, name)


class ZipSource(DataSource):
    """Options: path (a file or a folder), source, split, maxMember and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_rows"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def read_archives(spark: SparkSession, path: str, source: str, split: str = "unspecified", **options) -> DataFrame:
    """Records of the .json, .jsonl and .csv members. The split is split/member, so a path can hold out."""
    spark.dataSource.register(ZipSource)
    reader = spark.read.format("zip_rows").option("path", path).option("source", source).option("split", split)
    return reader.options(**options).load()


def injection_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The attacks (i, attack, file, category) and contexts (i, context, file, index) of a benchmark's archive, numbered in order.

    Attacks are the strings in the lists, by category, of .json members named *_attack_*; contexts are the `context` of the
    lines of .jsonl members under a folder named benchmark. They go to operators.prepare.compose_bipia.
    """
    from ..operators.prepare import numbered

    def run(batches):
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                        for number, item in enumerate(archive.infolist()):
                            key = f"{path_}\0{number:08d}"
                            if "_attack_" in item.filename and item.filename.endswith(".json"):
                                told = json.loads(archive.read(item))
                                flat = [(v, c) for c, values in told.items() for v in values if isinstance(v, str)]
                                out += [("a", f"{key}\0{n:010d}", v, item.filename, c, n) for n, (v, c) in enumerate(flat)]
                            elif "/benchmark/" in item.filename and item.filename.endswith(".jsonl"):
                                with archive.open(item) as stream:
                                    rows = [json.loads(r) for r in member_rows(stream, ".jsonl")]
                                out += [("c", f"{key}\0{n:010d}", r["context"], item.filename, "", n) for n, r in enumerate(rows) if isinstance(r, dict) and isinstance(r.get("context"), str)]
                except Exception as broken:  # a benchmark that can't be read whole isn't composed from in part
                    raise ValueError(f"unreadable archive {path_}") from broken
                for at in range(0, len(out), _BATCH):
                    columns = list(zip(*out[at : at + _BATCH]))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:5]], pa.array(columns[5], pa.int64())], names=["kind", "key", "value", "file", "category", "index"])

    # an archive of this benchmark is a few megabytes
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "kind string, key string, value string, file string, category string, index long")
    attacks = numbered(found.where("kind = 'a'").drop("kind", "index"), "key").select("i", F.col("value").alias("attack"), "file", "category")
    contexts = numbered(found.where("kind = 'c'").drop("kind", "category"), "key").select("i", F.col("value").alias("context"), "file", "index")
    return attacks, contexts
