"""Postings on their way to an index: packed into blocks of one bucket each where keys are made, shuffled as blocks, and
unpacked and sorted, a bucket at a time, where they are written.

A block holds the distinct keys of one bucket, how often each follows, and the ids, in as few bytes each as the numbers
of its batch need. So the shuffle has a few bytes for each posting, the sort of rows is one of blocks, and neither side
holds more than `HELD` postings at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..config import KmerConfig
from ..functions.keys import CHUNK, ROWS_OUT, chunks_of_keys

#: Types of ids that are packed.
INTEGERS = (ByteType, ShortType, IntegerType, LongType)
#: Postings packed at a time, and those of a bucket that are sorted at a time.
HELD = 2 * CHUNK
BLOCKS = "bucket int, low bigint, key_width int, count_width int, id_width int, keys binary, counts binary, ids binary"
_UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
_P = [np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """`index.bucket_of` of many keys: xxhash64 of eight bytes, seed 42."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P[4] + np.uint64(8) ^ _rotated(keys.view(np.uint64) * _P[1], 31) * _P[0]
        h = _rotated(h, 27) * _P[0] + _P[3]
        h = (h ^ h >> np.uint64(33)) * _P[1]
        h = (h ^ h >> np.uint64(29)) * _P[2]
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64) % buckets


def _width(most: int) -> int:
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)


def _ordered(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by key (as signed numbers), then id; as one number each where they fit."""
    low, base = int(ids.min()), int(keys.min())
    bits = (int(ids.max()) - low).bit_length()
    if bits < 64 and (int(keys.max()) - base).bit_length() + bits <= 64:
        both = (keys - np.int64(base)).view(np.uint64) << np.uint64(bits) | (ids - np.int64(low)).view(np.uint64)
        both.sort()
        return (both >> np.uint64(bits)).view(np.int64) + np.int64(base), (both & np.uint64((1 << bits) - 1)).view(np.int64) + np.int64(low)
    order = np.lexsort((ids, keys))
    return keys[order], ids[order]


def _binary(values: np.ndarray, width: int, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(_UNSIGNED[width]))])


def _blocks(keys: np.ndarray, ids: np.ndarray, buckets: int, null: bool) -> pa.RecordBatch:
    keys, ids = _ordered(keys, ids)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts, distinct = np.diff(np.append(first, len(keys))), keys[first]
    bucket = buckets_of(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, distinct, counts, first = bucket[order], distinct[order], counts[order], first[order]
    after = np.cumsum(counts)
    low = int(ids.min())
    ids = ids[np.repeat(first - (after - counts), counts) + np.arange(len(ids))] - np.int64(low)
    key_width, count_width, id_width = _width(int(distinct.view(np.uint64).max())), _width(int(counts.max())), _width(int(ids.view(np.uint64).max()))
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]), len(bucket) - 1) + 1
    same = lambda x, kind: pa.array(np.full(len(ends), x), kind)
    held = [_binary(distinct.view(np.uint64), key_width, ends), _binary(counts, count_width, ends), _binary(ids.view(np.uint64), id_width, after[ends - 1])]
    widths = [same(key_width, pa.int32()), same(count_width, pa.int32()), same(0 if null else id_width, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1], pa.int32()), same(low, pa.int64()), *widths, *held], names=[c.split()[0] for c in BLOCKS.split(", ")])


def packed(df: DataFrame, id_column: str, seq_column: str, config: KmerConfig, buckets: int, on_short: str, kind: str, frequent: np.ndarray | None, bare: bool) -> DataFrame:
    """Blocks of the postings of a table, without those of keys that are frequent (or, with `bare`, whose k-mer is among these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def handed_on(null: bool) -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held[null]))
            held[null], size[null] = [], 0
            return _blocks(keys, ids, buckets, null)

        for ids, rows, keys in chunks_of_keys(batches, config, on_short, kind):
            if frequent is not None and len(frequent):
                asked = (keys.view(np.uint64) >> np.uint64(config.occur_bitlen)).view(np.int64) if bare and config.occur_bitlen else keys
                at = np.minimum(np.searchsorted(frequent, asked), len(frequent) - 1)
                rows, keys = rows[frequent[at] != asked], keys[frequent[at] != asked]
            numbers, valid = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            for null in (False, True):
                mine = slice(None) if not null and valid.all() else valid[rows] != null
                part = (keys[mine], numbers[rows[mine]])
                if (null and valid.all()) or not len(part[0]):
                    continue
                held[null].append(part)
                size[null] += len(part[0])
                if size[null] >= HELD:
                    yield handed_on(null)
        for null in (False, True):
            if size[null]:
                yield handed_on(null)

    return df.select(id_column, seq_column).mapInArrow(run, BLOCKS)


def unpacked(blocks: DataFrame, id_type: str) -> DataFrame:
    """(key, id, bucket) of blocks that come by bucket, sorted within each."""
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(bucket: int, parts: list, null: bool) -> Iterator[pa.RecordBatch]:
            keys, ids = _ordered(*(np.concatenate(x) for x in zip(*parts)))
            for at in range(0, len(keys), ROWS_OUT):
                some = keys[at : at + ROWS_OUT]
                own = pa.nulls(len(some), arrow) if null else pa.array(ids[at : at + ROWS_OUT]).cast(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(some), own, pa.array(np.full(len(some), bucket, np.int32))], names=["key", "id", "bucket"])

        parts, size, now = [], 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            for i in range(len(batch)):
                bucket, low, key_width, count_width, id_width = (int(c[i]) for c in columns)
                keys, counts = (np.frombuffer(batch.column(c)[i].as_buffer(), _UNSIGNED[w]) for c, w in ((5, key_width), (6, count_width)))
                n = int(counts.sum())
                if now is not None and (now != (bucket, id_width == 0) or size + n > HELD):
                    yield from handed_on(now[0], parts, now[1])
                    parts, size = [], 0
                now = (bucket, id_width == 0)
                ids = np.frombuffer(batch.column(7)[i].as_buffer(), _UNSIGNED[id_width]).astype(np.int64) + np.int64(low) if id_width else np.zeros(n, np.int64)
                parts.append((np.repeat(keys.astype(np.uint64).view(np.int64), counts), ids))
                size += n
        if parts:
            yield from handed_on(now[0], parts, now[1])

    return blocks.mapInArrow(run, f"key bigint, id {id_type}, bucket int")
