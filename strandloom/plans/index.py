"""Inverted indexes: a Parquet table of (key, id), dealt into buckets by key and sorted in them.

A bucket is a folder, and a query names the buckets of its keys in its plan, so it reads
no others; within a file, the sort lets row groups be skipped. The number of
buckets follows from the number of keys that the sequences can have. Files are cut to size while they are written
(a key that very many rows have is split over tasks). The registry holds the settings that
an index was built with, and a search takes only an index with the same. Ids may
be of any type.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KmerConfig, SettingError, check_key_width
from ..functions.keys import BROADCAST_KEYS, broadcast_if_small, exploded, text_keys
from ..operators.caches import Session, threshold
from .postings import INTEGERS, packed, unpacked
from .store import INDEXES, Store

_RATE_TOLERANCE = 1e-4


#: Keys of a bucket, about; the least and the most buckets.
PER_BUCKET, LEAST, MOST = 2_000_000, 16, 16_384
#: Keys of a query up to which they stand in the plan as literals; beyond, they are joined.
LITERALS = 2000


def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_of(key: int, buckets: int) -> int:
    """The same on the driver."""
    h = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def buckets_for(df: DataFrame, seq_column: str, config: KmerConfig) -> int:
    """A power of two, from the number of windows of the sequences."""
    windows = df.agg(F.sum(F.greatest(F.length(seq_column) - (config.kmer_size - 1), F.lit(0)))).first()[0] or 0
    return min(MOST, max(LEAST, 1 << max(0, (-(-windows // PER_BUCKET) - 1).bit_length())))


def build_index(
    df: DataFrame, name: str, table: str, id_column: str, seq_column: str, config: KmerConfig, store: Store, kind: str = "dna2", key_width: int | None = None, buckets: int | None = None, on_short: str = "error", hf_match: str = "exact"
) -> DataFrame:
    """Writes the postings and the registry row, and returns the postings.

    With preclude_highfreq_kmer the column's frequent keys are left out. hf_match
    "exact" compares whole keys; "compat" looks a key's bare k-mer up among the
    whole keys, as some older tools do.
    """
    if key_width is not None:
        check_key_width(key_width, config)
    buckets = buckets or buckets_for(df, seq_column, config)
    frequent, dropped = None, 0
    if config.preclude_highfreq_kmer:
        if not store.exists(store.analysis_path("analyses", table, seq_column, config.kmer_size, config.occur_bitlen)):
            warnings.warn(f"preclude_highfreq_kmer is on, but column {seq_column} of {table} has no frequency analysis", stacklevel=2)
        frequent = store.frequent_of(table, seq_column, config.kmer_size, config.occur_bitlen).select(F.col("uintkey").alias("key"))
        dropped = frequent.count()
    if isinstance(df.schema[id_column].dataType, INTEGERS) and dropped <= BROADCAST_KEYS:
        known = np.sort(frequent.toArrow().column(0).to_numpy()) if dropped else None
        blocks = packed(df, id_column, seq_column, config, buckets, on_short, kind, known, hf_match == "compat")
        postings = unpacked(blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id_width"), df.schema[id_column].dataType.simpleString())
        store.write(store.path("index", name), lambda path: _in_order(postings, path, store))
    else:
        rows = exploded(df, id_column, seq_column, config, on_short, kind).select("key", F.col(id_column).alias("id"))
        if frequent is not None:
            rows = _without(rows, frequent, config, hf_match)
        sorted_rows = rows.withColumn("bucket", _bucket("key", buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "key", "id")
        store.write(store.path("index", name), lambda path: sorted_rows.write.partitionBy("bucket").parquet(path))
    info = (name, table, seq_column, kind, df.schema[id_column].dataType.simpleString(), config.kmer_size, config.occur_bitlen, config.key_width, df.count(), dropped, float(config.max_appearance_rate), config.max_appearance_nrow, config.preclude_highfreq_kmer, buckets, store.now())
    store.replace(store.path("registry", name), store.spark.createDataFrame([info], INDEXES))
    return read_index(name, store)


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _in_order(postings: DataFrame, path: str, store: Store) -> None:
    """Writes rows that come by bucket, which Spark does not know of rows out of Python: with a few writers open at a time it does not sort
    them again. Ids, which ascend within a key, are stored as differences."""
    conf = store.spark.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, "32")
    try:
        postings.write.partitionBy("bucket").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#id", "false").parquet(path)
    finally:
        conf.set(_WRITERS, before)


def _without(rows: DataFrame, frequent: DataFrame, config: KmerConfig, hf_match: str) -> DataFrame:
    if hf_match == "compat":
        shifted = F.shiftrightunsigned("key", config.occur_bitlen) if config.occur_bitlen else F.col("key")
        return rows.withColumn("_bare", shifted).join(frequent.withColumnRenamed("key", "_bare"), "_bare", "left_anti").drop("_bare")
    return rows.join(frequent, "key", "left_anti")


def read_index(name: str, store: Store) -> DataFrame:
    path, row = store.current(store.path("index", name)), _entry(name, store)
    schema = f"key bigint, id {row.id_type if row else 'bigint'}, bucket int"
    return store.spark.read.schema(schema).parquet(path) if path and row else store.spark.createDataFrame([], schema)


def _entry(name: str, store: Store):
    return store.indexes().filter(F.col("index_name") == name).first()


def drop_index(name: str, store: Store) -> bool:
    had = store.exists(store.path("registry", name))
    for what in ("registry", "index"):
        store.remove(store.path(what, name))
    store.changed()
    return had


def drop_all(store: Store) -> int:
    """What dropping the whole store takes along: all its indexes; then the store itself goes."""
    n = store.indexes().count()
    store.delete(store.root)
    return n


def drop_indexes_of(table: str, store: Store) -> int:
    """What dropping a table takes along."""
    names = [r.index_name for r in store.indexes().filter(F.col("table_name") == table).select("index_name").collect()]
    for n in names:
        drop_index(n, store)
    return len(names)


def fits(row, config: KmerConfig) -> bool:
    return (
        row.kmer_size == config.kmer_size
        and row.occur_bitlen == config.occur_bitlen
        and row.max_appearance_nrow == config.max_appearance_nrow
        and row.preclude_highfreq_kmer == config.preclude_highfreq_kmer
        and abs(row.max_appearance_rate - config.max_appearance_rate) <= _RATE_TOLERANCE
    )


def select_index(table: str, column: str, config: KmerConfig, store: Store) -> str | None:
    """The index with the session's settings, None where the column has no index, an error where all have other settings."""
    rows = store.indexes().filter((F.col("table_name") == table) & (F.col("column_name") == column)).orderBy("index_name").collect()
    for r in rows:
        if fits(r, config):
            return r.index_name
    if rows:
        raise SettingError(
            f"no index found matching current settings: kmer_size={config.kmer_size}, occur_bitlen={config.occur_bitlen}, max_appearance_rate={config.max_appearance_rate:.4f}, "
            f"max_appearance_nrow={config.max_appearance_nrow}, preclude_highfreq_kmer={str(config.preclude_highfreq_kmer).lower()}"
        )
    return None


def query_terms(query: str, table: str, column: str, config: KmerConfig, store: Store, hf_match: str = "exact", session: Session | None = None) -> np.ndarray:
    """A query's keys, without frequent ones if they are precluded: as the session has them loaded for this column, else from the table."""
    keys = text_keys(query, config)
    if not config.preclude_highfreq_kmer or not len(keys):
        return keys
    bare = keys if hf_match == "exact" or not config.occur_bitlen else (keys.view(np.uint64) >> np.uint64(config.occur_bitlen)).view(np.int64)
    loaded = session.frequent() if session else None
    if loaded and loaded.identity[:4] == (table, column, config.kmer_size, config.occur_bitlen):
        known = loaded.of(np.unique(bare), config.highfreq_kmer_cache_load_batch_size)
        return keys[~np.isin(bare, np.fromiter(known, np.int64, len(known)))]
    asked = store.spark.createDataFrame([(int(x),) for x in np.unique(bare)], "uintkey bigint")
    frequent = store.frequent_of(table, column, config.kmer_size, config.occur_bitlen).join(asked, "uintkey", "left_semi").select("uintkey").toArrow()
    return keys[~np.isin(bare, frequent.column(0).to_numpy())]


def search_index(query: str, table: str, column: str, config: KmerConfig, store: Store, name: str | None = None, hf_match: str = "exact", session: Session | None = None) -> DataFrame:
    """id and score of the rows that reach the threshold, which is taken from the keys that are left."""
    name = name or select_index(table, column, config, store)
    if name is None:
        raise SettingError(f"column {column} of {table} has no index")
    keys = query_terms(query, table, column, config, store, hf_match, session)
    return _counted(read_index(name, store), keys, max(1, threshold(len(keys), config)), _entry(name, store).buckets)


def _counted(postings: DataFrame, keys: Sequence[int] | np.ndarray, least: int, buckets: int) -> DataFrame:
    wanted = [int(k) for k in keys]
    found = postings.filter(F.col("bucket").isin(sorted({bucket_of(k, buckets) for k in wanted}))) if wanted else postings.filter(F.lit(False))
    if len(wanted) <= LITERALS:
        found = found.filter(F.col("key").isin(wanted))
    else:  # a query's own keys: as many as it has windows, so small by nature
        found = found.join(F.broadcast(postings.sparkSession.createDataFrame([(k,) for k in wanted], "key bigint")), "key")
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("score")).filter(F.col("score") >= least)


def search_many(queries: DataFrame, query_id: str, query_column: str, name: str, config: KmerConfig, store: Store, frequent: DataFrame | None = None) -> DataFrame:
    """query_id, id, score of a table of queries against an index; `frequent` (key) is left out of the queries."""
    asked = exploded(queries, query_id, query_column, config)
    if frequent is not None:
        asked = asked.join(frequent.select("key"), "key", "left_anti")
    sizes = asked.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(max(1, config.min_score)).cast("long"), F.ceil(F.lit(float(config.min_shared_kmer_rate)) * F.col("_n")))
    buckets = _entry(name, store).buckets
    asked = asked.withColumn("bucket", _bucket("key", buckets))
    postings = read_index(name, store)
    named = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most MOST numbers
    if len(named) < buckets:
        postings = postings.filter(F.col("bucket").isin(named))
    counted = postings.join(broadcast_if_small(asked), ["bucket", "key"]).groupBy(query_id, "id").agg(F.count(F.lit(1)).alias("score"))
    return counted.join(sizes.select(query_id, least.alias("_least")), query_id).filter("score >= _least").select(query_id, "id", "score")
