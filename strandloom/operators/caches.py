"""Caches of a session, on the driver: query keys, thresholds, and loaded frequent keys.

A query's keys depend on the text, k and occur_bitlen, and the cache is keyed by
all three. Both caches drop what was used least recently when they are full.
"""

from __future__ import annotations

import math
import warnings
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KmerConfig, SettingError
from ..functions.keys import text_keys
from ..plans.store import Store

_STATS = "hits bigint, misses bigint, current_entries int, max_entries int"


class LruCache:
    def __init__(self):
        self.entries: OrderedDict[Hashable, Any] = OrderedDict()
        self.clear_counts()

    def clear_counts(self) -> None:
        self.hits = self.misses = self.limit = 0

    def get(self, key: Hashable, make: Callable[[], Any], limit: int) -> Any:
        self.limit = limit
        if key in self.entries:
            self.hits += 1
            self.entries.move_to_end(key)
            return self.entries[key]
        self.misses += 1
        value = self.entries[key] = make()
        while len(self.entries) > limit:
            self.entries.popitem(last=False)
        return value

    def free(self) -> int:
        n = len(self.entries)
        self.entries.clear()
        self.clear_counts()
        return n

    def stats(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.hits, self.misses, len(self.entries), self.limit)], _STATS)


class FrequentKeys:
    """Loaded frequent keys of one analysis: a table that stays in Spark, and the identity it was loaded for."""

    def __init__(self, table: str, column: str, config: KmerConfig, keys: DataFrame, count: int):
        self.identity = (table, column, config.kmer_size, config.occur_bitlen, config.max_appearance_rate, config.max_appearance_nrow)
        self.keys, self.count = keys, count

    def of(self, wanted: np.ndarray, batch: int = 10_000) -> set[int]:
        """Those of a query's keys that are frequent, asked for a batch at a time."""
        out: set[int] = set()
        for low in range(0, len(wanted), batch):
            asked = [int(x) for x in wanted[low : low + batch]]
            out |= {r.uintkey for r in self.keys.filter(F.col("uintkey").isin(asked)).collect()}
        return out


#: Frequent keys that all sessions of a store share, by the store's root.
_shared: dict[str, FrequentKeys] = {}


class Session:
    """What one user keeps between queries, and `parallel`, the frequent keys that all sessions of a store share."""

    def __init__(self, spark: SparkSession, config: KmerConfig | None = None, store: Store | None = None):
        self.spark, self.config, self.store = spark, config or KmerConfig(), store or Store(spark)
        self.queries, self.thresholds = LruCache(), LruCache()
        self.loaded: FrequentKeys | None = None
        self.listeners: list[Callable[[], None]] = []

    @property
    def parallel(self) -> FrequentKeys | None:
        return _shared.get(self.store.root)

    def frequent(self) -> FrequentKeys | None:
        """The loaded keys that searches use: the session's own, else the shared ones; with
        force_use_parallel_highfreq_kmer_cache the shared ones alone. Shared keys count only if they fit the settings."""
        own = None if self.config.force_use_parallel_highfreq_kmer_cache else self.loaded
        if own is not None or self.parallel is None:
            return own
        c = self.config
        return self.parallel if self.parallel.identity[2:] == (c.kmer_size, c.occur_bitlen, c.max_appearance_rate, c.max_appearance_nrow) else None

    def _changed(self) -> None:
        for listener in self.listeners:
            listener()

    def set(self, **changes: Any) -> KmerConfig:
        """Changes settings and drops what they invalidate; a refused change leaves all as it was."""
        old, self.config = self.config, self.config.with_(**changes)
        changed = {n for n in changes if getattr(old, n) != getattr(self.config, n)}
        if changed & {"kmer_size", "query_kmer_cache_max_entries", "occur_bitlen"}:
            self.queries.free()
        if changed & {"kmer_size", "max_appearance_rate", "max_appearance_nrow", "min_score", "min_shared_kmer_rate", "occur_bitlen", "actual_min_score_cache_max_entries"}:
            self.thresholds.free()
        if changed & {"kmer_size", "max_appearance_rate", "max_appearance_nrow", "occur_bitlen"} and self.loaded:
            warnings.warn("settings changed: the loaded frequent keys are dropped", stacklevel=2)
            self._drop()
        self._changed()
        return self.config

    def _drop(self) -> None:
        if self.loaded:
            self.loaded.keys.unpersist()
            self.loaded = None
            self.thresholds.free()

    def query_keys(self, text: str) -> np.ndarray:
        c = self.config
        keys = self.queries.get((text, c.kmer_size, c.occur_bitlen), lambda: text_keys(text, c), c.query_kmer_cache_max_entries)
        self._changed()
        return keys

    def threshold(self, text: str) -> int:
        """Shared keys that a match needs: the larger of min_score and the share of the query's keys (rounded up
        in double precision); with frequent keys loaded, less the query's frequent keys, but 1 at least."""
        c, frequent = self.config, self.frequent()
        least = self.thresholds.get((text, c, frequent.identity if frequent else None), lambda: self._threshold(self.query_keys(text)), c.actual_min_score_cache_max_entries)
        self._changed()
        return least

    def free_queries(self) -> int:
        n = self.queries.free()
        self._changed()
        return n

    def free_thresholds(self) -> int:
        n = self.thresholds.free()
        self._changed()
        return n

    def _threshold(self, keys: np.ndarray) -> int:
        base, frequent = threshold(len(keys), self.config), self.frequent()
        return base if frequent is None else max(1, base - len(frequent.of(keys, self.config.highfreq_kmer_cache_load_batch_size)))

    # frequent keys

    def _analysis(self, table: str, column: str) -> Any:
        rows = self.store.analyses().filter((F.col("table_name") == table) & (F.col("column_name") == column)).collect()
        if not rows:
            raise SettingError(f"no frequency analysis of column {column} of table {table}")
        c = self.config
        same = [r for r in rows if r.kmer_size == c.kmer_size and r.occur_bitlen == c.occur_bitlen] or [r for r in rows if r.kmer_size == c.kmer_size] or rows
        r = same[0]
        for name, mine, needed in (
            ("kmer_size", c.kmer_size, r.kmer_size),
            ("occur_bitlen", c.occur_bitlen, r.occur_bitlen),
            ("max_appearance_rate", c.max_appearance_rate, r.max_appearance_rate),
            ("max_appearance_nrow", c.max_appearance_nrow, r.max_appearance_nrow),
        ):
            if abs(mine - needed) > (1e-4 if isinstance(mine, float) else 0):
                shown = (lambda x: f"{x:.4f}") if isinstance(mine, float) else str
                raise SettingError(f"setting strandloom.{name} does not match the analysis: current setting {shown(mine)}, required by metadata {shown(needed)}")
        return r

    def _load(self, table: str, column: str) -> FrequentKeys | None:
        self._analysis(table, column)
        c = self.config
        keys = self.store.frequent_of(table, column, c.kmer_size, c.occur_bitlen).select("uintkey").cache()
        count = keys.count()
        if not count:
            keys.unpersist()
            return None
        return FrequentKeys(table, column, c, keys, count)

    def load_frequent(self, table: str, column: str) -> bool:
        """False if the analysis found no frequent key; an error if there is none or its settings differ."""
        loaded = self._load(table, column)
        self._drop()
        self.loaded = loaded
        self.thresholds.free()
        return loaded is not None

    def free_frequent(self, table: str, column: str) -> int:
        if self.loaded is None or self.loaded.identity[:2] != (table, column):
            warnings.warn(f"no frequent keys are loaded for {table}.{column}", stacklevel=2)
            return 0
        n = self.loaded.count
        self._drop()
        return n

    def free_all_frequent(self) -> int:
        n = int(self.loaded is not None)
        self._drop()
        return n

    def load_parallel(self, table: str, column: str) -> bool:
        """Like load_frequent for the shared handle; repeating it is harmless, but it is not replaced by other settings."""
        c = self.config
        if self.parallel is not None:
            return self.parallel.identity == (table, column, c.kmer_size, c.occur_bitlen, c.max_appearance_rate, c.max_appearance_nrow)
        loaded = self._load(table, column)
        if loaded is not None:
            _shared[self.store.root] = loaded
        return loaded is not None

    def free_parallel(self, table: str, column: str) -> int:
        if self.parallel is None or self.parallel.identity[:2] != (table, column):
            warnings.warn(f"no shared frequent keys are loaded for {table}.{column}", stacklevel=2)
            return 0
        return self.free_all_parallel()

    def free_all_parallel(self) -> int:
        if self.parallel is None:
            return 0
        shared = _shared.pop(self.store.root)
        shared.keys.unpersist()
        return shared.count

    def cache_summary(self) -> DataFrame:
        """One row per cache, with its hit rate."""
        parts = [c.stats(self.spark).withColumn("cache_type", F.lit(name)) for name, c in (("query-kmer", self.queries), ("actual_min_score", self.thresholds))]
        both = parts[0].unionByName(parts[1])
        calls = F.col("hits") + F.col("misses")
        return both.select(
            "cache_type",
            F.col("current_entries").alias("total_entries"),
            F.col("hits").alias("total_hits"),
            F.col("misses").alias("total_misses"),
            F.when(calls > 0, F.col("hits").cast("double") / calls).otherwise(0.0).alias("hit_rate"),
        )


def threshold(n_keys: int, config: KmerConfig) -> int:
    return max(config.min_score, math.ceil(config.min_shared_kmer_rate * n_keys))
