"""Logs as streams: lines appended once, and growing files followed by byte offset.

``append`` writes the lines of each micro-batch into a folder named by the batch's number. A batch that is run again, because the
query died before it was committed, replaces its folder; a folder counts once its success mark is there. So each line is there
once, whatever happens in between.

``tail`` is a Python data source. Its offset is a number of bytes for each file; a batch reads whole lines between two offsets, a
part of ``SPLIT`` bytes a task, and a half line at a file's end waits for its rest. A file that has become shorter was replaced and
is read from its start. Only sizes and the ends of files are looked at by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.catalog import listed

#: Bytes that a task reads; bytes looked at in one go for a line's end; lines in an Arrow batch.
SPLIT, STEP, ROWS = 32 << 20, 64 << 10, 10_000


def append(df: DataFrame, path: str, checkpoint: str, column: str = "value", once: bool = True) -> StreamingQuery:
    """The stream's lines, appended under ``path``; with ``once`` the query runs through what is there and stops."""

    def run(batch: DataFrame, number: int) -> None:
        batch.select(F.col(column).alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}/batch={number:012d}")

    writer = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_records(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows as JSON lines."""
    return append(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, checkpoint, once=once)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """batch and line of all batches that were written to their end."""
    whole = [f for f in listed(spark, path, missing=True) if f.rpartition("/")[2].startswith("batch=") and _marked(spark, f)]
    if not whole:
        return spark.createDataFrame([], "batch long, line string")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long")
    return spark.read.text(whole).select(number.alias("batch"), F.col("value").alias("line"))


def _marked(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@dataclass
class Span(InputPartition):
    """Bytes of a file, from a line's start to a line's end."""

    path: str
    start: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_line_end(handle, start: int, end: int) -> int:
    """Behind the last newline between two places, or the first of them: looked for from the end, a step at a time."""
    while end > start:
        at = max(start, end - STEP)
        handle.seek(at)
        found = handle.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return start


def next_line(handle, at: int, end: int) -> int:
    """Behind the first newline from a place on, or ``end``."""
    handle.seek(at)
    while at < end:
        data = handle.read(min(STEP, end - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return end


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def _sizes(self) -> dict[str, int]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return {}
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        return {i.path: i.size for i in found if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file."""
        system, _ = _system(self.path)
        known = getattr(self, "known", {})
        ends = {}
        for path, size in sorted(self._sizes().items()):
            start = known.get(path, 0)
            with system.open_input_file(path) as f:
                ends[path] = start if size == start else last_line_end(f, start if size > start else 0, size)
        self.known = ends
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        system, _ = _system(self.path)
        spans = []
        for path, stop in after.items():
            at = before.get(path, 0)
            if stop < at:
                at = 0  # the file was replaced
            if at >= stop:
                continue
            if stop - at <= SPLIT:
                spans.append(Span(path, at, stop))
                continue
            with system.open_input_file(path) as f:
                while at < stop:
                    cut = next_line(f, at + SPLIT, stop) if at + SPLIT < stop else stop
                    spans.append(Span(path, at, cut))
                    at = cut
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            left, rest, at = partition.end - partition.start, b"", partition.start
            while left:
                data = f.read(min(left, 4 << 20))
                if not data:
                    raise EOFError(f"{partition.path} has become shorter")
                left -= len(data)
                whole = rest + data
                cut = whole.rfind(b"\n") + 1
                found, rest = whole[:cut].split(b"\n")[:-1], whole[cut:]
                for i in range(0, len(found), ROWS):
                    part = found[i : i + ROWS]
                    offsets = []
                    for line in part:
                        offsets.append(at)
                        at += len(line) + 1
                    text = [line.decode("utf-8", "replace").removesuffix("\r") for line in part]
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(part)), pa.array(offsets, type=pa.int64()), pa.array(text)], names=["file", "offset", "value"])

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("suffix", ""))


def tail(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """file, offset (of the line's first byte) and value of each whole line that a file, or the files of a folder, gain."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", path)
    return (reader.option("suffix", suffix) if suffix else reader).load()
