"""Best-fit packing into sequences of several permitted lengths.

Lengths are counted in words. A document longer than the largest capacity is cut
into pieces; pieces are dealt by a hash of their row and place (so that no id fills one) into shards of about `SHARD`, which are
packed one by one: longest piece first, into the open bin that it fills best. If
it fits no open bin, the size to open is the one with the least cost per word,
each size being filled on trial, longest first, with all that is still to be packed. In the end each bin
shrinks to the smallest capacity that holds its contents.

One row per piece: doc_id, piece, start (word), length, bin, capacity, place (in
the bin). A document without words has one piece of length 0 and no bin. Repeated
rows are packed each. Null doc_ids are packed like others. An empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

CAPACITIES = (512, 1024, 2048, 4096)
SHARD = 20_000


def cost(capacity: int) -> float:
    """Of one sequence: its tokens, attention that grows with the square, and a fixed part."""
    return capacity + capacity * capacity / 16384 + 32


class Shard:
    def __init__(self, capacities: Sequence[int] = CAPACITIES):
        self.capacities = sorted(capacities)
        self.price = {c: cost(c) for c in self.capacities}

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin and place of each piece, and each bin's capacity."""
        order = np.argsort(-lengths, kind="stable")
        left = np.bincount(lengths, minlength=self.capacities[-1] + 1)  # pieces still to be packed, by length
        sizes = np.flatnonzero(left).tolist()
        bins = np.zeros(len(lengths), np.int64)
        place = np.zeros(len(lengths), np.int64)
        used: list[int] = []
        room: dict[int, list[int]] = {}  # open bins by what still fits
        open_rooms = 0  # bit r: a bin has room r
        capacity: list[int] = []
        for i in order.tolist():
            n = int(lengths[i])
            left[n] -= 1
            if not left[n]:
                sizes.remove(n) if sizes[-1] != n else sizes.pop()
            fitting = open_rooms >> n
            if fitting:
                r = n + (fitting & -fitting).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_rooms &= ~(1 << r)
            else:
                r = self._size_to_open(n, left, sizes)
                b = len(used)
                used.append(0)
                capacity.append(r)
            bins[i], place[i] = b, used[b]
            used[b] += n
            if r - n:
                room.setdefault(r - n, []).append(b)
                open_rooms |= 1 << (r - n)
        final = [self.capacities[int(np.searchsorted(self.capacities, u))] for u in used]
        return bins, place, np.array(final, np.int64)

    def _size_to_open(self, n: int, left: np.ndarray, sizes: list[int]) -> int:
        best, choice = None, self.capacities[-1]
        for c in self.capacities:
            if c < n:
                continue
            rest = c - n
            at = bisect_right(sizes, rest) - 1
            while rest and at >= 0:  # as many of each length as fit, longest first: at most one step for each length
                size = sizes[at]
                taken = min(rest // size, int(left[size]))
                rest -= taken * size
                at = min(at, bisect_right(sizes, rest)) - 1
            # an unused tail is cut off in the end
            final = self.capacities[int(np.searchsorted(self.capacities, c - rest))]
            per_word = self.price[final] / (c - rest)
            if best is None or per_word < best - 1e-12:
                best, choice = per_word, c
        return choice


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """Lengths are counted once and written, as their number decides how many shards there are."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    df = docs.select("doc_id", words.alias("_n"), F.monotonically_increasing_id().alias("_row"))
    df = df.select("doc_id", "_n", "_row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("_n") - 1) / largest), F.lit(0)))).alias("piece"))
    return written(df.select("doc_id", "_row", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("_n") - F.col("piece") * largest, F.lit(largest)).alias("length")), "pieces")


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    all_pieces = pieces(docs, max(capacities))
    shards = max(1, -(-all_pieces.count() // shard))
    dealt = all_pieces.withColumn("shard", F.pmod(F.xxhash64("_row", "piece"), F.lit(shards))).drop("_row")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "length"]).reset_index(drop=True)
        filled = frame.length.to_numpy() > 0
        out = frame.assign(bin=pd.array([None] * len(frame), "Int64"), capacity=pd.array([None] * len(frame), "Int32"), place=pd.array([None] * len(frame), "Int64"))
        if filled.any():
            bins, place, final = Shard(capacities).pack(frame.length.to_numpy()[filled])
            out.loc[filled, "bin"] = (int(frame["shard"].iat[0]) << 32) + bins
            out.loc[filled, "capacity"] = final[bins]
            out.loc[filled, "place"] = place
        return out[["doc_id", "piece", "start", "length", "bin", "capacity", "place"]]

    return dealt.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece long, start long, length long, bin long, capacity int, place long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
