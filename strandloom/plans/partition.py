"""Tables in hash partitions, and back to flat ones.

A table is a folder of Parquet files under a root; its DNA columns are marked in
the schema's metadata. Partitioning deals rows by a hash of the one DNA column
into a new version of the table (`store`), so a reader sees the old or the new layout and
a write that is cut off changes nothing.
Frequency analyses are kept by table name and so outlive the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Store

PART = "_part"


def dna_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Marks a column as DNA of a kind."""
    return df.withMetadata(column, {"dna": kind})


def dna_columns(schema: StructType) -> dict[str, str]:
    return {f.name: f.metadata["dna"] for f in schema.fields if "dna" in f.metadata}


class TableError(ValueError):
    pass


class Tables:
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def path(self, table: str) -> str:
        return self.store.path("tables", table)

    def save(self, table: str, df: DataFrame) -> None:
        self.store.replace(self.path(table), df)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._current(table)).drop(PART)

    def _current(self, table: str) -> str:
        path = self.store.current(self.path(table))
        if path is None:
            raise TableError(f'table "{table}" does not exist')
        return path

    def is_partitioned(self, table: str) -> bool:
        return any(name.startswith(f"{PART}=") for name, _, folder in self.store.children(self._current(table)) if folder)

    def _checked(self, table: str) -> str:
        if self.is_partitioned(table):
            raise TableError(f'table "{table}" is already a partitioned table')
        columns = dna_columns(self.read(table).schema)
        if not columns:
            raise TableError("table must have at least one DNA2 or DNA4 column")
        if len(columns) > 1:
            raise TableError(f"table has {len(columns)} DNA2/DNA4 columns, but exactly one is required")
        return next(iter(columns))

    def partition(self, table: str, count: int) -> None:
        if count < 1:
            raise TableError("partition_count must be at least 1")
        column = self._checked(table)
        df = self.read(table).withColumn(PART, F.pmod(F.xxhash64(column), F.lit(count)).cast("int"))
        self.store.write(self.path(table), lambda path: df.hint("rebalance", PART).write.partitionBy(PART).parquet(path))

    def unpartition(self, table: str) -> None:
        if not self.is_partitioned(table):
            raise TableError(f'table "{table}" is not a partitioned table')
        self.store.replace(self.path(table), self.read(table))

    def partition_sizes(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._current(table)).groupBy(PART).count()

    def drop(self, table: str) -> int:
        """Drops a table and its indexes; returns how many indexes went."""
        from .index import drop_indexes_of

        self.store.delete(self.path(table))
        return drop_indexes_of(table, self.store)

    def drop_schema(self, schema: str) -> int:
        """Drops all tables named `schema.…` and the indexes of all such names; returns how many indexes went."""
        from .index import drop_indexes_of

        names = {n for n, _, folder in self.store.children(self.store.path("tables")) if folder}
        names |= {r.table_name for r in self.store.indexes().select("table_name").distinct().collect()}
        gone = 0
        for name in sorted(n for n in names if n.startswith(f"{schema}.")):
            self.store.remove(self.path(name))
            gone += drop_indexes_of(name, self.store)
        self.store.changed()
        return gone
