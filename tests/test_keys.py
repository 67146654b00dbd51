import random
from collections import Counter

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.config import KmerConfig
from strandloom.functions import keys
from strandloom.functions.dna import DEGENERATE


def model(seq, config):
    """Keys one window at a time."""
    seen, out = Counter(), []
    for i in range(len(seq) - config.kmer_size + 1):
        w = seq[i : i + config.kmer_size]
        odd = [c for c in w if c not in "ACGT"]
        if len(odd) > 1 or "N" in odd:
            continue
        for b in DEGENERATE[odd[0]] if odd else [""]:
            v = w.replace(odd[0], b) if odd else w
            n = 0
            for c in v:
                n = n * 4 + "ACGT".index(c)
            seen[n] += 1
            if seen[n] <= config.occurrences:
                out.append(n << config.occur_bitlen | seen[n] - 1)
    return out


@pytest.mark.parametrize("k,b", [(4, 8), (5, 0), (8, 2), (16, 8), (27, 10), (32, 0)])
def test_keys_agree_with_a_plain_model_and_the_two_engines_agree(spark, k, b):
    rng = random.Random(k * 100 + b)
    config = KmerConfig(kmer_size=k, occur_bitlen=b)
    seqs = ["".join(rng.choices("ACGT" * 12 + "MRWSYKVHDBN", k=rng.randint(0, 120))) for _ in range(30)] + ["A" * 90, "ACGT" * 20, "N" * 40, ""]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    got = {r.id: r.k for r in df.select("id", keys.key_array(F.col("seq"), config, "empty").alias("k")).collect()}
    for i, s in enumerate(seqs):
        assert [x % 2**64 for x in got[i]] == model(s, config)
        assert len(set(got[i])) == len(got[i])
    rows = keys.key_rows(df, "id", "seq", config).select("id", keys.key_number(F.col("kmer"), F.col("occurrence"), config).alias("key"), "kmer").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.id, set()).add(r.key)
    assert all(by_id.get(i, set()) == set(got[i]) for i in got)
    back = keys.exploded(df, "id", "seq", config).select("key", keys.key_kmer(F.col("key"), config).alias("kmer"), keys.key_occurrence(F.col("key"), config).alias("occ"))
    for r in back.limit(50).collect():
        n = 0
        for c in r.kmer:
            n = n * 4 + "ACGT".index(c)
        assert n << b | r.occ - 1 == r.key % 2**64


def test_null_short_and_invalid(spark):
    config = KmerConfig(kmer_size=4, occur_bitlen=8)
    df = spark.createDataFrame([(None,), ("ACG",)], "seq string")
    assert [r.k for r in df.select(keys.key_array(F.col("seq"), config, "empty").alias("k")).collect()] == [None, []]
    with pytest.raises(Exception, match="must be at least 4 bases long"):
        df.select(keys.key_array(F.col("seq"), config)).collect()
    with pytest.raises(keys.SequenceError, match="must be at least 4 bases long"):
        keys.text_keys("AX", config)
    with pytest.raises(keys.SequenceError, match="Invalid character 'X' for DNA sequence"):
        keys.text_keys("ACGTX", config)
    assert (keys.text_keys("acguacgu", config) == keys.text_keys("ACGTACGT", config)).all()
    assert len(keys.text_keys("NNNNNNNN", config)) == 0


def test_highest_key_is_a_64_bit_pattern():
    top = keys.text_keys("T" * 32, KmerConfig(kmer_size=32, occur_bitlen=0))
    assert top.view(np.uint64).tolist() == [2**64 - 1]


def test_batches_are_cut_by_bases_and_hold_the_keys_of_each_row():
    rng = random.Random(5)
    for k, b in ((8, 4), (31, 2), (32, 0)):
        config = KmerConfig(kmer_size=k, occur_bitlen=b)
        seqs = ["".join(rng.choices("ACGTACGTACGTRN", k=n)) for n in [0, 3, 40, 5000, 900_000, 900_000, 900_000, 70]] + [None, "ACGT" * 30]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(seqs))), pa.array(seqs, pa.string())], names=["id", "s"])
        got, sizes = {i: [] for i in range(len(seqs))}, {}
        for at, (ids, rows, found) in enumerate(keys.chunks_of_keys(iter([batch]), config, "empty", "dna4")):
            sizes[at] = len(found)
            for i in set(rows.tolist()):
                got[ids[i].as_py()] += found[rows == i].tolist()
        assert max(sizes.values()) <= 3 * keys.CHUNK and len(sizes) > 1
        for i, s in enumerate(seqs):
            assert sorted(got[i]) == (sorted(keys.text_keys(s, config).tolist()) if s and len(s) >= k else [])


def test_the_plan_of_built_in_functions_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "ACGTACGTRACGN"), (2, "AAAAAAAAAA"), (3, None)], "id long, s string")
    rows = keys.key_rows(df, "id", "s", KmerConfig(kmer_size=4, occur_bitlen=2))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.filter("id = 2").collect()) == [(2, "AAAA", n) for n in (1, 2, 3, 4)]


def test_kmers_are_spelled_where_keys_are_made(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAAGCTTACGGATCCATGACGTTGCAAGCTTACGG"), (2, "T" * 30)], "id long, s string")
    for k in (5, 8, 17, 20):
        config = KmerConfig(kmer_size=k, occur_bitlen=3)
        want = keys.exploded(df, "id", "s", config).select("id", keys.key_kmer(F.col("key"), config), keys.key_occurrence(F.col("key"), config), "key")
        assert sorted(keys.spelled(df, "id", "s", config).collect()) == sorted(want.collect())
        totals = {r.key: r.n for r in keys.key_totals(df, "s", config).collect()}
        assert totals == {r["key"]: 1 for r in want.collect()}
