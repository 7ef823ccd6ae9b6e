"""Arrow files as a Python data source: a task a record batch, planned from the files' own footers.

The file layout ends with a list of its record batches, so the driver reads that alone and plans partitions of whole batches of
about ``TARGET`` bytes; each task opens the file at its batches. The stream layout has no such list and no way to start in its
middle, so a stream is one partition and its batches are read one after another. Only needed columns are decoded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: how a file of the file layout begins.
MAGIC = b"ARROW1"
#: Bytes of a partition; rows handed over at once.
TARGET, ROWS = 64 << 20, 10_000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Batches(InputPartition):
    """Record batches ``first`` to ``end`` - 1 of a file; all of a stream if ``end`` is none."""

    path: str
    first: int
    end: int | None


def _has_footer(path: str) -> bool:
    system, at = _system(path)
    with system.open_input_file(at) as f:
        return f.read(len(MAGIC)) == MAGIC


def schema_of(path: str) -> pa.Schema:
    """A file's schema: of its footer or its first message."""
    system, at = _system(path)
    with system.open_input_file(at) as f:
        return (pa.ipc.open_file(f) if _has_footer(path) else pa.ipc.open_stream(f)).schema


def plan(path: str, target: int = TARGET) -> list[Batches]:
    """A file's partitions. Batches are taken to be of like size; one that is larger is a partition of its own."""
    if not _has_footer(path):
        return [Batches(path, 0, None)]
    system, at = _system(path)
    size = system.get_file_info(at).size
    with system.open_input_file(at) as f:
        n = pa.ipc.open_file(f).num_record_batches
    step = max(1, n * target // max(size, 1))
    return [Batches(path, i, min(n, i + step)) for i in range(0, n, step)]


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[str], schema: StructType, target: int):
        self.files, self.schema, self.target = files, schema, target

    def partitions(self) -> Sequence[Batches]:
        return [p for f in self.files for p in plan(f, self.target)] or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        wanted = to_arrow_schema(self.schema, prefers_large_types=False)
        system, at = _system(partition.path)
        with system.open_input_file(at) as f:
            if partition.end is None:
                found = iter(pa.ipc.open_stream(f))
            else:
                reader = pa.ipc.open_file(f)
                found = (reader.get_batch(i) for i in range(partition.first, partition.end))
            for batch in found:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    columns = [_as(part.column(n), wanted.field(n).type) if n in part.schema.names else pa.nulls(part.num_rows, wanted.field(n).type) for n in wanted.names]
                    yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def _as(column: pa.Array, kind: pa.DataType) -> pa.Array:
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return column if column.type == kind else column.cast(kind)


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrowfile"

    def _files(self) -> list[str]:
        return self.options["files"].split("\n") if self.options.get("files") else []

    def schema(self) -> StructType:
        """The first file's schema holds for all; columns that another one lacks are null there."""
        files = self._files()
        if not files:
            raise ValueError("no Arrow file")
        plain = [f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema_of(files[0])]
        return from_arrow_schema(pa.schema(plain))

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self._files(), schema, int(self.options.get("target", TARGET)))


def arrow(spark: SparkSession, files: list[str], target: int = TARGET) -> DataFrame:
    """The rows of Arrow files."""
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrowfile").option("files", "\n".join(files)).option("target", str(target)).load()


def saved_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A folder as ``save_to_disk`` leaves it: its Arrow files, of one split or of a folder a split (then with a column ``split``)."""
    from functools import reduce

    from pyspark.sql import functions as F

    from corpusloom.sources.catalog import listed

    found = listed(spark, path)
    own = [f for f in found if f.endswith(".arrow")]
    if own:
        return arrow(spark, own)
    splits = {f.rstrip("/").rpartition("/")[2]: [x for x in listed(spark, f) if x.endswith(".arrow")] for f in found if not f.endswith(".json")}
    tables = [arrow(spark, files).withColumn("split", F.lit(name)) for name, files in splits.items() if files]
    if not tables:
        raise FileNotFoundError(f"no Arrow file in {path}")
    return reduce(DataFrame.unionByName, tables)
