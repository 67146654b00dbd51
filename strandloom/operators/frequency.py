"""Frequency analysis: keys that occur in too many rows.

`COUNT(*)` counts every row, null sequences included; a key's appearance is the
number of rows that have it. A key is frequent if it appears in more rows than
the threshold: trunc(rows * max_appearance_rate), or max_appearance_nrow if that
is given and smaller. One job: explode, partial counts, one shuffle by key.
"""

from __future__ import annotations

import time
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KmerConfig
from ..functions.keys import key_totals
from ..plans.store import ANALYSES, Store

_BYTES_PER_KEY = 64


@dataclass(frozen=True)
class AnalysisResult:
    total_rows: int
    highfreq_kmers_count: int
    parallel_workers_used: int
    max_appearance_rate_used: float
    max_appearance_nrow_used: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(self)], "total_rows bigint, highfreq_kmers_count int, parallel_workers_used int, max_appearance_rate_used double, max_appearance_nrow_used int")


@dataclass(frozen=True)
class DropResult:
    dropped_analyses: int
    dropped_highfreq_kmers: int
    freed_storage_bytes: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([astuple(self)], ", ".join(f"{f.name} bigint" for f in fields(self)))


def effective_threshold(total_rows: int, config: KmerConfig) -> int:
    by_rate = int(total_rows * config.max_appearance_rate)
    return min(by_rate, config.max_appearance_nrow) if config.max_appearance_nrow > 0 else by_rate


def key_counts(df: DataFrame, seq_column: str, config: KmerConfig, on_short: str = "empty") -> DataFrame:
    """key and appearance_nrow of all keys."""
    return key_totals(df, seq_column, config, on_short).withColumnRenamed("n", "appearance_nrow")


def frequent_keys(df: DataFrame, seq_column: str, config: KmerConfig, on_short: str = "empty") -> DataFrame:
    """Frequent keys without storing them; the threshold is taken from the same rows."""
    return key_counts(df, seq_column, config, on_short).filter(F.col("appearance_nrow") > effective_threshold(df.count(), config))


def analyze(df: DataFrame, table: str, column: str, config: KmerConfig, store: Store, on_short: str = "error") -> AnalysisResult:
    """Finds and stores the frequent keys of a table's column; an earlier analysis with the same k and occur_bitlen is replaced."""
    total = df.count()
    least = effective_threshold(total, config)
    k, b = config.kmer_size, config.occur_bitlen
    rows = key_counts(df, column, config, on_short).filter(F.col("appearance_nrow") > least)
    path = store.analysis_path("frequent", table, column, k, b)
    store.replace(
        path,
        rows.select(
            F.lit(k).alias("kmer_size"),
            F.lit(b).alias("occur_bitlen"),
            F.col("key").alias("uintkey"),
            "appearance_nrow",
            F.lit("threshold").alias("detection_reason"),
            F.current_timestamp().alias("created_at"),
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
        ),
    )
    meta = store.spark.createDataFrame([(k, b, float(config.max_appearance_rate), config.max_appearance_nrow, store.now(), table, column)], ANALYSES)
    store.replace(store.analysis_path("analyses", table, column, k, b), meta)
    found = store.frequent_of(table, column, k, b).count()
    return AnalysisResult(total, found, store.spark.sparkContext.defaultParallelism, config.max_appearance_rate, least)


def undo(table: str, column: str, store: Store) -> DropResult:
    """Drops all analyses of a column, whatever their k."""
    mine = (F.col("table_name") == table) & (F.col("column_name") == column)
    analyses = store.analyses().filter(mine).count()
    keys = store.frequent().filter(mine).count()
    for what in ("frequent", "analyses"):
        store.remove(store.analysis_path(what, table, column))
    store.changed()
    return DropResult(analyses, keys, _BYTES_PER_KEY * keys)


def analysis_status(store: Store) -> DataFrame:
    """One row per analysis with the number of its frequent keys."""
    key = ["table_name", "column_name", "kmer_size", "occur_bitlen"]
    counts = store.frequent().groupBy(*key).agg(F.countDistinct("uintkey").alias("_n"))
    return store.analyses().join(counts, key, "left").select(*key, "max_appearance_rate", "max_appearance_nrow", "analysis_timestamp", F.coalesce("_n", F.lit(0)).alias("highfreq_kmer_count"))


def delete_tempfiles(store: Store, younger_than_s: float = 60) -> DataFrame:
    """Removes versions that no reader needs: those whose write was never finished, and those that a newer one
    has replaced. A version in which anything changed within the last minute stays: its writer or its readers may be at
    work. deleted_count, deleted_size, error_count."""
    count = size = errors = 0
    edge = (time.time() - younger_than_s) * 1000

    def walk(path: str, depth: int) -> None:
        nonlocal count, size, errors
        versions = store.versions(path)
        current = store.current(path)
        for version, _ in versions:
            if version != current and store.newest(version) <= edge:
                try:
                    n = store.size(version)
                    store.remove(version)
                    count, size = count + 1, size + n
                except Exception:
                    errors += 1
        if not versions and depth:
            for name, _, folder in store.children(path):
                if folder:
                    walk(f"{path}/{name}", depth - 1)

    walk(store.root, 4)
    return store.spark.createDataFrame([(count, size, errors)], "deleted_count int, deleted_size bigint, error_count int")
