"""What the corpus operators share: tables, the shared scratch folder, Arrow text slices, hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where an order is needed: before all others.
NULL_ID = -(2**63)
_U = np.uint64
_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one is taken if Spark runs on
    this machine alone (tests); on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="strandloom-"))
        root = _local[0]
    return root.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and the n+1 offsets; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93
_POWERS = np.ones(1 << 12, np.uint64)
_POWERS[1:] = np.multiply.accumulate(np.full((1 << 12) - 1, _STEP, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k symbols, by doubling."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, out, got, step, length = symbols, None, 0, _STEP, 1
    while True:
        if k & length:
            if out is None:
                out, got = power, length
            else:
                m = min(len(out), len(power) - got)
                out = out[:m] * _U(step) + power[got : got + m]
                got += length
        if got == k:
            return mix64(out[:n])
        power = power[:-length] * _U(step) + power[length:]
        step, length = step * step % 2**64, length * 2


def words_of(data: np.ndarray, starts_of_rows: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`; no word spans two rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = starts_of_rows[starts_of_rows < len(data)]
    first[at] = solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    at = at[at > 0] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    codes = LOWER_CODES if lower else BYTE_CODES
    place = np.flatnonzero(solid)
    lengths = ends - starts
    within = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = codes[data[place]] * _POWERS[within & 0xFFF]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return starts, ends, mix64(sums + lengths.astype(np.uint64))


LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[0x41:0x5B] = BYTE_CODES[0x61:0x7B]
