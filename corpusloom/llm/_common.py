"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a Python worker.
SLICE_BYTES = 2 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a new temporary one if all runs in one process, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="loom-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/loom-{uuid.uuid4().hex}-{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """``stored``, in as many buckets of column ``by`` as shuffles have partitions, so that grouping by it moves nothing."""
    spark = df.sparkSession
    table = f"loom_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(number, by).option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: a table with a path keeps its files
    return out


def dealt(rows: DataFrame, name: str, weight: str, least: float) -> DataFrame:
    """``rows`` with the groups of column ``name`` whose weights sum to over ``least`` dealt into pairs of chunks.

    Every two rows of a group meet under some new name, and no new name has much over ``least`` in weight, but for single rows.
    """
    total, own_as, other_as = (fresh(x, rows.columns) for x in ("__w", "__own", "__other"))
    large = stored(rows.groupBy(name).agg(F.sum(weight).alias(total)).filter(F.col(total) > least), "large")
    if large.isEmpty():
        return rows
    hot = rows.join(large, name)
    chunks = F.ceil(F.col(total) * 2 / least)
    own = F.pmod(F.xxhash64(*(c for c in rows.columns if c != name)), chunks)
    spread = hot.withColumn(own_as, own).withColumn(other_as, F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    named = spread.withColumn(name, F.xxhash64(name, F.least(own_as, other_as), F.greatest(own_as, other_as)))
    return rows.join(large, name, "left_anti").unionByName(named.select(*rows.columns))


def pieces_of(batch: pa.RecordBatch, text_index: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``size`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False)
    bucket = np.cumsum(sizes, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    start = 0
    for end in [*cuts.tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, with as many more underscores in front as it takes to be none of those taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def segments(data: bytes, size: int = 8 << 20) -> Iterator[bytes]:
    """Parts of a very long text, cut at ASCII white space only."""
    if len(data) <= size:
        yield data
        return
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + size)
        while end < n and data[end] not in b" \t\n\r\x0b\x0c":
            nxt = min((p for p in (data.find(c, end, end + 65536) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0), default=-1)
            end = nxt if nxt >= 0 else min(n, end + 65536)
        yield data[start:end]
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_mod(id_column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(n))


#: LANES[b] has bit j of the byte b in the j-th byte lane of a 64-bit word, so that adding words counts eight bits at once.
LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For groups of consecutive 64-bit hashes (group g has ``counts[g]``), how many have each bit set: (groups, 64)."""
    groups = len(counts)
    out = np.zeros((groups, 64), dtype=np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n_segments = (counts[full] + 254) // 255  # a lane holds 255 at most
    first = np.cumsum(n_segments) - n_segments
    begin = (np.cumsum(counts) - counts)[full]
    starts = np.repeat(begin - 255 * first, n_segments) + 255 * np.arange(int(n_segments.sum()))
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[octets[:, k]], starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
    return out


def majority(bits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if over half of the group's hashes have it."""
    on = (2 * bits > counts[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)
