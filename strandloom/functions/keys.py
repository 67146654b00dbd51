"""From sequences to sets of keys.

A key is `k-mer << occur_bitlen | occurrence - 1`; the k-mer has its first base in
the high bits (A 0, C 1, G 2, T 3); occurrences of a k-mer within one sequence are
numbered in the order of scanning and only the first 2**occur_bitlen count (the
first alone if occur_bitlen is 0). A window with one degenerate base stands for
two or three k-mers; with N, or with two or more, it is passed over. Keys of a
sequence are distinct. They are 64-bit patterns in a bigint.

Two engines give the same keys: `key_array`, `exploded` and their relatives in Arrow batches,
and `key_rows`, a plan of built-in functions. Neither shuffles. Batches of `exploded` are cut by
bases, both ways, so the memory of its tasks does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..config import KmerConfig
from .dna import DEGENERATE, canonical

_U = np.uint64
_PLAIN, _BAD = 4, 99
_CODE = np.full(256, _BAD, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_CODE[ord("U")] = _CODE[ord("u")] = 3
_NAMES = list(DEGENERATE)
for _i, _c in enumerate(_NAMES):
    _CODE[ord(_c)] = _CODE[ord(_c) + 32] = 10 + _i
_CODE[ord("N")] = _CODE[ord("n")] = 50
_BASES = np.full((10, 3), -1, np.int64)
for _i, _c in enumerate(_NAMES):
    for _j, _x in enumerate(DEGENERATE[_c]):
        _BASES[_i, _j] = "ACGT".index(_x)


class SequenceError(ValueError):
    """A sequence that is too short or holds a character that is no base."""


def check_query(text: str, config: KmerConfig) -> None:
    """Length first, then characters."""
    if len(text) < config.kmer_size:
        raise SequenceError(f"Query sequence must be at least {config.kmer_size} bases long")
    for c in text:
        if ord(c) > 255 or _CODE[ord(c)] == _BAD:
            raise SequenceError(f"Invalid character '{c}' for DNA sequence")


def _plain_kmers(two: np.ndarray, k: int) -> np.ndarray:
    """The value of every window of k codes of two bits."""
    power, out, got, length = two, None, 0, 1
    while True:  # doubling
        if k & length:
            if out is None:
                out, got = power, length
            else:
                m = min(len(out), len(power) - got)
                out = out[:m] << _U(2 * length) | power[got : got + m]
                got += length
        if got == k:
            break
        power = power[:-length] << _U(2 * length) | power[length:]
        length *= 2
    return out[: len(two) - k + 1]


def kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of a sequence's codes, in order, degenerate ones written out."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    plain = codes < 4
    out = _plain_kmers(np.where(plain, codes, 0).astype(np.uint64), k)
    if plain.all():
        return out
    odd = np.concatenate([[0], np.cumsum(~plain)])
    none = np.concatenate([[0], np.cumsum(codes >= 50)])
    degenerate = odd[k:] - odd[:-k]
    whole = np.flatnonzero(degenerate == 0)
    single = np.flatnonzero((degenerate == 1) & (none[k:] == none[:-k]))
    places = np.flatnonzero(~plain)
    at = places[odd[single]]  # the only odd place in the window
    bases = _BASES[codes[at].astype(np.int64) - 10]
    values = out[single][:, None] | np.maximum(bases, 0).astype(np.uint64) << (2 * (k - 1 - (at - single))).astype(np.uint64)[:, None]
    used = bases >= 0
    windows = np.concatenate([whole, np.repeat(single, used.sum(1))])
    order = np.argsort(windows, kind="stable")
    return np.concatenate([out[whole], values[used]])[order]


def keys_of(codes: np.ndarray, config: KmerConfig) -> np.ndarray:
    """Distinct keys (uint64) in the order of scanning."""
    values = kmers(codes, config.kmer_size)
    if not len(values):
        return values
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.flatnonzero(new)
    occurrence = np.empty(len(values), np.int64)
    occurrence[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    keep = occurrence < config.occurrences
    return values[keep] << _U(config.occur_bitlen) | occurrence[keep].astype(np.uint64)


def text_keys(text: str, config: KmerConfig) -> np.ndarray:
    """Keys of a query, as signed 64-bit numbers."""
    check_query(text, config)
    return keys_of(_CODE[np.frombuffer(text.encode("latin-1"), np.uint8)], config).view(np.int64)


def _row_keys(value: pa.Scalar, config: KmerConfig, on_short: str, kind: str | None = None) -> np.ndarray | None:
    """A stored sequence's keys; a character that is not of the alphabet (of both, where no kind is given) is an error."""
    if not value.is_valid:
        return None
    data = np.frombuffer(value.as_buffer(), np.uint8)
    codes = _CODE[data]
    strange = codes >= (_PLAIN if kind == "dna2" else _BAD)
    if strange.any():
        c = bytes(data[int(np.argmax(strange)) :])[:4].decode("utf-8", "ignore")[:1]
        raise SequenceError(f"invalid character '{c}' for {(kind or 'dna4').upper()} type")
    if len(codes) < config.kmer_size:
        if on_short == "error":
            raise SequenceError(f"Query sequence must be at least {config.kmer_size} bases long")
        return np.zeros(0, np.int64)
    return keys_of(codes, config).view(np.int64)


def key_array(seq: Column, config: KmerConfig, on_short: str = "error", kind: str | None = None) -> Column:
    """array<bigint> of a sequence's keys; null for null. on_short: "error" or "empty"."""

    @arrow_udf(ArrayType(LongType()))
    def keys(batch: pa.Array) -> pa.Array:
        rows = [_row_keys(x, config, on_short, kind) for x in batch]
        lengths = [0 if r is None else len(r) for r in rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate([np.zeros(0, np.int64), *(r for r in rows if r is not None)])
        mask = pa.array([r is None for r in rows], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)

    return keys(seq)


def shared_count(seq: Column, wanted: Sequence[int] | np.ndarray, config: KmerConfig, on_short: str = "error", once: bool = False) -> Column:
    """How many of the wanted keys a sequence has; the keys never leave the batch. With `once` no plan evaluates it twice for a row."""
    own = np.sort(np.asarray(wanted, np.int64))

    @arrow_udf(IntegerType())
    def count(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch:
            keys = _row_keys(x, config, on_short)
            if keys is None:
                out.append(None)
            elif not len(own):
                out.append(0)
            else:
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                out.append(int((own[at] == keys).sum()))
        return pa.array(out, pa.int32())

    return (count.asNondeterministic() if once else count)(seq)


#: Bases whose keys are made at a time (a longer sequence goes alone), and rows of a batch that is handed on.
CHUNK, ROWS_OUT = 1 << 21, 1 << 17


def _checked_codes(seqs: pa.Array, config: KmerConfig, on_short: str, kind: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all sequences in a row, each with one more behind it that no window may hold, and the lengths (-1: null)."""
    seqs = seqs.cast(pa.large_string())
    n, low = len(seqs), seqs.offset
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[low : low + n + 1]
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    valid = seqs.is_valid().to_numpy(zero_copy_only=False)
    codes = _CODE[data]
    strange = codes >= (_PLAIN if kind == "dna2" else _BAD)
    if strange.any():
        at = int(np.argmax(strange))
        end = int(offsets[np.searchsorted(offsets - offsets[0], at, "right")] - offsets[0])
        c = bytes(data[at:end])[:4].decode("utf-8", "ignore")[:1]
        raise SequenceError(f"invalid character '{c}' for {(kind or 'dna4').upper()} type")
    lengths = np.diff(offsets)
    if on_short == "error" and (valid & (lengths < config.kmer_size)).any():
        raise SequenceError(f"Query sequence must be at least {config.kmer_size} bases long")
    out = np.full(len(codes) + n, 50, np.uint8)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(lengths + 1) - 1] = False
    out[kept] = codes
    return out, np.where(valid, lengths, -1)


def _placed_kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of codes and the windows they are from, in no order; see `kmers`."""
    if len(codes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    plain = codes < 4
    out = _plain_kmers(np.where(plain, codes, 0).astype(np.uint64), k)
    odd = np.concatenate([[0], np.cumsum(~plain, dtype=np.int32)])
    none = np.concatenate([[0], np.cumsum(codes >= 50, dtype=np.int32)])
    degenerate = odd[k:] - odd[:-k]
    whole = np.flatnonzero(degenerate == 0)
    single = np.flatnonzero((degenerate == 1) & (none[k:] == none[:-k]))
    if not len(single):
        return out[whole], whole
    at = np.flatnonzero(~plain)[odd[single]]  # the only odd place in the window
    bases = _BASES[codes[at].astype(np.int64) - 10]
    values = out[single][:, None] | np.maximum(bases, 0).astype(np.uint64) << (2 * (k - 1 - (at - single))).astype(np.uint64)[:, None]
    used = bases >= 0
    return np.concatenate([out[whole], values[used]]), np.concatenate([whole, np.repeat(single, used.sum(1))])


def _keys_by_row(codes: np.ndarray, lengths: np.ndarray, config: KmerConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of sequences laid out by `_checked_codes`, in arrays. The keys of a row depend only on how often it
    has each k-mer, so row and k-mer are sorted as one number; with long k-mers that holds few rows, which then take turns."""
    k = config.kmer_size
    begin = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0) + 1)])
    step = 1 << min(24, 64 - 2 * k)
    for low in range(0, len(lengths), step):
        high = min(low + step, len(lengths))
        values, windows = _placed_kmers(codes[begin[low] : begin[high]], k)
        if not len(values):
            continue
        row = np.repeat(np.arange(high - low, dtype=np.uint64), np.diff(begin[low : high + 1]))[windows]
        both = (row << _U(2 * k) if 2 * k < 64 else row) | values
        both.sort()
        new = np.empty(len(both), bool)
        new[0] = True
        np.not_equal(both[1:], both[:-1], out=new[1:])
        first = np.flatnonzero(new)
        occurrence = np.arange(len(both)) - np.repeat(first, np.diff(np.append(first, len(both))))
        keep = occurrence < config.occurrences
        both, occurrence = both[keep], occurrence[keep].astype(np.uint64)
        rows = (both >> _U(2 * k)).astype(np.int64) if 2 * k < 64 else np.zeros(len(both), np.int64)
        values = both & _U((1 << 2 * k) - 1)
        yield low + rows, (values << _U(config.occur_bitlen) | occurrence).view(np.int64)


def chunks_of_keys(batches: Iterator[pa.RecordBatch], config: KmerConfig, on_short: str, kind: str | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Of batches (id, sequence): ids, and row among these and key, for so many sequences at a time as hold CHUNK bases."""
    for batch in batches:
        ids, seqs = batch.column(0), batch.column(1)
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(seqs), 0)) + 1) if len(seqs) else []
        low = 0
        while low < len(seqs):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
            codes, lengths = _checked_codes(seqs[low:high], config, on_short, kind)
            for rows, keys in _keys_by_row(codes, lengths, config):
                yield ids[low:high], rows, keys
            low = high


def exploded(df: DataFrame, id_column: str, seq_column: str, config: KmerConfig, on_short: str = "empty", kind: str | None = None) -> DataFrame:
    """(id, key) by the Arrow engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, keys in chunks_of_keys(batches, config, on_short, kind):
            for at in range(0, len(keys), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[at : at + ROWS_OUT])), pa.array(keys[at : at + ROWS_OUT])], names=[id_column, "key"])

    schema = StructType([df.schema[id_column], StructField("key", LongType())])
    return df.select(id_column, seq_column).mapInArrow(run, schema)


def spelled(df: DataFrame, id_column: str, seq_column: str, config: KmerConfig, on_short: str = "empty", kind: str | None = None) -> DataFrame:
    """(id, kmer, occ from 1, key): `exploded` with each key's k-mer written out where the key is made."""
    k = config.kmer_size
    part = [min(8, k - at) for at in range(0, k, 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = {n: np.frombuffer(b"ACGT", np.uint8)[np.arange(4**n)[:, None] >> 2 * np.arange(n - 1, -1, -1) & 3] for n in set(part)}
        for ids, rows, keys in chunks_of_keys(batches, config, on_short, kind):
            for at in range(0, len(keys), ROWS_OUT):
                some = keys[at : at + ROWS_OUT]
                values = some.view(np.uint64) >> _U(config.occur_bitlen)
                text, low = np.empty((len(some), k), np.uint8), 0
                for n in part:
                    text[:, low : low + n] = bases[n][(values >> _U(2 * (k - low - n)) & _U(4**n - 1)).astype(np.int64)]
                    low += n
                words = pa.StringArray.from_buffers(len(some), pa.py_buffer(np.arange(0, k * len(some) + 1, k, dtype=np.int32)), pa.py_buffer(text))
                occurrence = (some & (config.occurrences - 1)) + 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[at : at + ROWS_OUT])), words, pa.array(occurrence), pa.array(some)], names=[id_column, "kmer", "occ", "key"])

    schema = StructType([df.schema[id_column], StructField("kmer", StringType()), StructField("occ", LongType()), StructField("key", LongType())])
    return df.select(id_column, seq_column).mapInArrow(run, schema)


def key_totals(df: DataFrame, seq_column: str, config: KmerConfig, on_short: str = "empty", kind: str | None = None) -> DataFrame:
    """(key, n): in how many rows a key is, counted for CHUNK bases at a time before the shuffle by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            ordered = np.sort(keys)
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            n = np.diff(np.append(first, len(ordered)))
            for at in range(0, len(first), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(ordered[first[at : at + ROWS_OUT]]), pa.array(n[at : at + ROWS_OUT])], names=["key", "n"])

        held, size = [], 0
        for _, _, keys in chunks_of_keys(batches, config, on_short, kind):
            held.append(keys)
            size += len(keys)
            if size >= 4 * CHUNK:
                yield from handed_on(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from handed_on(np.concatenate(held))

    parts = df.select(F.lit(0).alias("_id"), seq_column).mapInArrow(run, "key bigint, n bigint")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


#: Rows (16 bytes each) up to which a table of query keys is sent to all tasks instead of being shuffled.
BROADCAST_KEYS = 1_000_000


def broadcast_if_small(asked: DataFrame) -> DataFrame:
    """Query keys with a broadcast hint if they are counted to be few; else a shuffled join is left to Spark."""
    return F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked


def key_rows(df: DataFrame, id_column: str, seq_column: str, config: KmerConfig) -> DataFrame:
    """(id, kmer, occurrence from 1) as a plan of built-in functions; ids are distinct. k up to 31 bases and beyond alike.

    A k-mer's occurrences are numbered from 1 up to how often its row has it, so windows need no places: those of a row are taken in one
    pass over the sequence, sorted where they are, and cut into runs."""
    k = config.kmer_size
    seq = canonical(F.col(seq_column), "dna4")
    choices = F.create_map(*[x for c, bases in DEGENERATE.items() for x in (F.lit(c), F.array(*map(F.lit, bases)))])

    def written_out(w: Column) -> Column:
        odd = F.translate(w, "ACGT", "")
        return F.transform(choices[odd], lambda b: F.replace(w, odd, b))

    def windows(pattern: str) -> Column:
        return F.regexp_extract_all("_s", F.lit(f"(?=({pattern}))"), F.lit(1))

    odd = "".join(DEGENERATE)
    single = F.filter(windows(f"(?=[ACGT]{{0,{k - 1}}}[{odd}])[^N]{{{k}}}"), lambda w: w.rlike(f"^[ACGT]*[{odd}][ACGT]*$"))
    plain = windows(f"[ACGT]{{{k}}}")
    all_of_it = F.when(F.col("_s").rlike("[^ACGTN]"), F.concat(plain, F.flatten(F.transform(single, written_out)))).otherwise(plain)
    # each step stands once in the plan: what is exploded is not evaluated again
    runs = df.select(F.col(id_column), F.explode(F.array(seq)).alias("_s")).filter(F.length("_s") >= k)
    runs = runs.select(id_column, F.explode(F.array(F.sort_array(all_of_it))).alias("_w"))
    begins = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    runs = runs.filter(F.size("_w") > 0).select(id_column, "_w", F.explode(F.array(begins)).alias("_b"))
    ends = F.concat(F.slice("_b", F.lit(2), F.size("_b")), F.array(F.size("_w") + 1))
    counted = F.arrays_zip(F.transform("_b", lambda i: F.get("_w", i - 1)).alias("kmer"), F.zip_with("_b", ends, lambda a, z: F.least(z - a, F.lit(config.occurrences))).alias("n"))
    return runs.select(id_column, F.inline(counted)).select(id_column, "kmer", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("occurrence"))


def key_number(kmer: Column, occurrence: Column, config: KmerConfig) -> Column:
    """The key of a k-mer and its occurrence; -10 asks conv for a signed result, so that 32 bases fit."""
    value = F.conv(F.translate(kmer, "ACGT", "0123"), 4, -10).cast("long")
    return F.shiftleft(value, config.occur_bitlen).bitwiseOR(occurrence.cast("long") - 1)


def key_kmer(key: Column, config: KmerConfig) -> Column:
    """The bases of a key's k-mer."""
    value = F.shiftrightunsigned(key, config.occur_bitlen) if config.occur_bitlen else key
    hexes = F.lpad(F.hex(value), (config.kmer_size + 1) // 2, "0")
    pairs = F.transform(F.split(hexes, "(?!^)(?!$)"), lambda h: F.lpad(F.conv(h, 16, 4), 2, "0"))
    return F.translate(F.substring(F.array_join(pairs, ""), -config.kmer_size, config.kmer_size), "0123", "ACGT")


def key_occurrence(key: Column, config: KmerConfig) -> Column:
    return key.bitwiseAND(config.occurrences - 1) + 1
