"""Metadata tables, indexes and saved tables as versioned folders.

Every record set is a folder of its own under the store's root, with the names in
the path, so that replacing or dropping one never rewrites another. A write goes
into a new version's folder and counts from the moment its mark is created, which is one step of the
file system: a reader sees the old or the new version, and a write that is cut off at any point
leaves the old one as it was. The version before the last stays until the next write
or `delete_tempfiles`, for readers that still use it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FREQUENT = "kmer_size int, occur_bitlen int, uintkey bigint, appearance_nrow bigint, detection_reason string, created_at timestamp, table_name string, column_name string"
ANALYSES = "kmer_size int, occur_bitlen int, max_appearance_rate double, max_appearance_nrow int, analysis_timestamp timestamp, table_name string, column_name string"
INDEXES = (
    "index_name string, table_name string, column_name string, kind string, id_type string, kmer_size int, occur_bitlen int, key_width int, total_nrow bigint, highfreq_kmer_count bigint, "
    "max_appearance_rate double, max_appearance_nrow int, preclude_highfreq_kmer boolean, buckets int, created_at timestamp"
)
DONE = "_done"
_VERSION = re.compile(r"v(\d{8})-[0-9a-f]{32}")


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get("strandloom.store", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/strandloom_store").rstrip("/")
        self.listeners: list[Callable[[], None]] = []

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def children(self, path: str) -> list[tuple[str, int, bool]]:
        """Name, time of change in ms and whether a folder, of what a folder holds."""
        fs, p = self._fs(path)
        return [(f.getPath().getName(), f.getModificationTime(), f.isDirectory()) for f in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def newest(self, path: str) -> int:
        """Time in ms at which something in a folder, at any depth, last changed."""
        fs, p = self._fs(path)
        times, files = [fs.getFileStatus(p).getModificationTime()], fs.listFiles(p, True)
        while files.hasNext():
            times.append(files.next().getModificationTime())
        return max(times)

    def remove(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.delete(p, True)

    # versions

    def versions(self, path: str) -> list[tuple[str, bool]]:
        """The versions in a folder, oldest first, and whether each is finished."""
        names = sorted(n for n, _, folder in self.children(path) if folder and _VERSION.fullmatch(n))
        return [(f"{path}/{n}", self._fs(f"{path}/{n}/{DONE}")[0].exists(self._fs(f"{path}/{n}/{DONE}")[1])) for n in names]

    def current(self, path: str) -> str | None:
        return next((v for v, done in reversed(self.versions(path)) if done), None)

    def exists(self, path: str) -> bool:
        return self.current(path) is not None

    def write(self, path: str, save: Callable[[str], None]) -> str:
        """A new version that `save` writes; older ones than the one it replaces go."""
        before = self.versions(path)
        number = 1 + max((int(_VERSION.fullmatch(v.rsplit("/", 1)[1])[1]) for v, _ in before), default=0)
        target = f"{path}/v{number:08d}-{uuid.uuid4().hex}"
        save(target)
        self.finish(target)
        for old, _ in [v for v in before if v[1]][:-1]:
            self.remove(old)
        self.changed()
        return target

    def finish(self, version: str) -> None:
        fs, p = self._fs(f"{version}/{DONE}")
        fs.create(p, False).close()

    def replace(self, path: str, df: DataFrame) -> None:
        self.write(path, lambda target: df.write.parquet(target))

    def delete(self, path: str) -> bool:
        gone = self.remove(path)
        self.changed()
        return gone

    def changed(self) -> None:
        for listener in self.listeners:
            listener()

    # paths and tables

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def analysis_path(self, what: str, table: str, column: str, k: int | None = None, b: int | None = None) -> str:
        parts = [what, table, column]
        if k is not None:
            parts.append(f"k{k}b{b}")
        return self.path(*parts)

    def _leaves(self, path: str, depth: int) -> list[str]:
        if depth == 0:
            return [path]
        return [x for name, _, folder in self.children(path) if folder for x in self._leaves(f"{path}/{name}", depth - 1)]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        current = [v for v in map(self.current, paths) if v]
        if not current:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*current)

    def frequent(self) -> DataFrame:
        return self._read(self._leaves(self.path("frequent"), 3), FREQUENT)

    def analyses(self) -> DataFrame:
        return self._read(self._leaves(self.path("analyses"), 3), ANALYSES)

    def indexes(self) -> DataFrame:
        return self._read(self._leaves(self.path("registry"), 1), INDEXES)

    def index_meta(self) -> DataFrame:
        """What each index was built with, and whether and from which table frequent keys were left out."""
        return self.indexes().select(
            "index_name",
            "table_name",
            "column_name",
            F.col("preclude_highfreq_kmer").alias("highfreq_filtered"),
            F.when(F.col("preclude_highfreq_kmer"), F.lit("highfreq_kmer")).alias("highfreq_source_table"),
            "kmer_size",
            "occur_bitlen",
            "max_appearance_rate",
            "max_appearance_nrow",
            "created_at",
        )

    def index_info(self) -> DataFrame:
        return self.indexes().drop("kind", "id_type", "key_width", "buckets")

    def frequent_of(self, table: str, column: str, k: int, b: int) -> DataFrame:
        return self._read([self.analysis_path("frequent", table, column, k, b)], FREQUENT)

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)
