import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import dna


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_canonical_folds_case_and_u(spark):
    assert one(spark, "acgu", lambda s: dna.canonical(s, "dna2")) == "ACGT"
    assert one(spark, "nmrU", lambda s: dna.canonical(s, "dna4")) == "NMRT"
    assert one(spark, "", lambda s: dna.canonical(s, "dna2")) == ""
    assert one(spark, None, lambda s: dna.canonical(s, "dna2")) is None


@pytest.mark.parametrize("kind,text,bad", [("dna2", "ACGN", "N"), ("dna4", "ACGX", "X"), ("dna2", "AC GT", " ")])
def test_invalid_character_is_named(spark, kind, text, bad):
    with pytest.raises(Exception, match=f"invalid character '{bad}' for {kind.upper()} type"):
        one(spark, text, lambda s: dna.canonical(s, kind))


def test_lengths_and_bytes(spark):
    row = (
        spark.createDataFrame([("ATCGA",)], "s string")
        .select(
            dna.bit_length(F.col("s"), "dna2").alias("b2"),
            dna.bit_length(F.col("s"), "dna4").alias("b4"),
            dna.nuc_length(F.col("s")).alias("n"),
            dna.to_bytes(F.col("s"), "dna2").alias("p2"),
            dna.to_bytes(F.col("s"), "dna4").alias("p4"),
        )
        .first()
    )
    assert (row.b2, row.b4, row.n) == (10, 20, 5)
    assert bytes(row.p2) == (10).to_bytes(4, "big") + bytes([0b00110110, 0])
    assert bytes(row.p4) == (20).to_bytes(4, "big") + bytes([0x18, 0x24, 0x10])


def packed(seq, kind):
    bits, codes = (2, "ACGT") if kind == "dna2" else (4, "?" + dna.DNA4_CODES)
    v = "".join(format(codes.index(c), f"0{bits}b") for c in seq)
    v += "0" * (-len(v) % 8)
    return (bits * len(seq)).to_bytes(4, "big") + bytes(int(v[i : i + 8], 2) for i in range(0, len(v), 8))


@pytest.mark.parametrize("kind,alphabet", [("dna2", "ACGT"), ("dna4", dna.DNA4_CODES)])
def test_wire_form_is_a_round_trip(spark, kind, alphabet):
    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=70), min_size=1, max_size=20))
    def check(seqs):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string").withColumn("b", dna.wire_send(F.col("s"), kind))
        for r in df.withColumn("back", dna.wire_receive(F.col("b"), kind)).collect():
            assert bytes(r.b) == packed(r.s, kind) and r.back == r.s

    check()


def test_order_is_length_then_codes(spark):
    df = spark.createDataFrame([("T",), ("AA",), ("A",), ("",), ("AC",)], "s string")
    assert [r.s for r in df.orderBy(dna.sort_key(F.col("s"), "dna2")).collect()] == ["", "A", "T", "AA", "AC"]
    df = spark.createDataFrame([(c,) for c in sorted(dna.DNA4_CODES)], "s string")
    assert "".join(r.s for r in df.orderBy(dna.sort_key(F.col("s"), "dna4")).collect()) == dna.DNA4_CODES


def test_compare_and_hash(spark):
    df = spark.createDataFrame([("A", "AA"), ("T", "A"), ("C", "C"), (None, "A")], "a string, b string")
    out = df.select(dna.compare(F.col("a"), F.col("b"), "dna2").alias("c"), (dna.hashed(F.col("a")) == dna.hashed(F.col("b"))).alias("h"), dna.hashed_extended(F.col("a"), 7).alias("x")).collect()
    assert [r.c for r in out] == [-1, 1, 0, None]
    assert out[2].h and isinstance(out[2].x, int)


def test_rows_are_told_by_their_values_where_hashes_meet(spark):
    from strandloom.queries_admin import _by_hash

    df = spark.createDataFrame([(1, "AC"), (2, "GT"), (3, "AC"), (4, None), (5, ""), (6, None)], "id long, seq string")
    got = sorted(tuple(r) for r in _by_hash(df, F.lit(1)).collect())
    assert got == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 2), (5, 5, 1), (6, 4, 2)]
