import pytest
from pyspark.sql import functions as F

from strandloom.config import KmerConfig, SettingError, check_key_width
from strandloom.operators import caches, frequency, search
from strandloom.plans import index

C = KmerConfig(kmer_size=4, occur_bitlen=8, min_shared_kmer_rate=0.2)
LONG = "ATCG" * 15 + "A"


@pytest.fixture(scope="module")
def dna2(spark):
    return spark.createDataFrame([(1, "seq1", LONG), (2, "seq2", "GCTA" * 15), (3, "seq3", "ATCGATCG" + "T" * 52)], "id int, name string, sequence string")


@pytest.fixture(scope="module")
def dna4(spark):
    return spark.createDataFrame([(1, "seq1", LONG), (2, "seq2", "GCTA" * 15), (3, "seq3", "ATCGATCGNN" + "ATCG" * 12 + "ATC")], "id int, name string, sequence string")


def scores(df, query, config=C):
    return [r.s for r in df.orderBy("id").select(search.match_score(F.col("sequence"), query, config).alias("s")).collect()]


def ids(df, query, config=C):
    return {r.id for r in df.filter(search.matches(F.col("sequence"), query, config)).collect()}


def test_scores(dna2, dna4):
    assert scores(dna2, LONG) == [58, 0, 5]
    assert scores(dna4, LONG) == [58, 0, 53]
    assert scores(dna2.filter("id = 1"), LONG, C.with_(kmer_size=6)) == [56]


@pytest.mark.parametrize("query,score", [("NNNGATCG", 2), ("ATCGNNNN", 1), ("WTCGATCG", 5), ("RTCGATCG", 5), ("YTCGATCG", 4), ("STCGATCG", 4), ("MTCGATCG", 5), ("KTCGATCG", 4)])
def test_degenerate_queries(spark, query, score):
    assert scores(spark.createDataFrame([(1, "ATCGATCG")], "id int, sequence string"), query) == [score]


def test_matches(dna2, dna4):
    assert ids(dna2, "ATCGATCG") == {1, 3}
    assert ids(dna2, "GCTAG") == {2}
    assert ids(dna2, "TTTTTTTT") == {3}
    assert ids(dna2, "AAAAAAAA") == set()
    assert ids(dna4, "NNATCG") == {1, 3}
    assert ids(dna4, "ATCGNN") == {1, 3}
    assert ids(dna4, "NNNNNNNN", C.with_(min_score=0, min_shared_kmer_rate=0.0)) == set()
    assert ids(dna2, "AAAAAAAA", C.with_(min_score=0, min_shared_kmer_rate=0.0)) == {1, 2, 3}


def test_nulls_and_ranking(spark, dna2):
    assert scores(spark.createDataFrame([(1, None)], "id int, sequence string"), LONG) == [None]
    top = search.search_topk(dna2, "sequence", "ATCGATCG", C, 5, "id").collect()
    assert [(r.id, r.score) for r in top] == [(1, 5), (3, 5)]
    both = search.search_union([(dna2, "a"), (dna2, "b")], "sequence", "GCTAG", C).collect()
    assert {(r.id, r.origin) for r in both} == {(2, "a"), (2, "b")}


def test_threshold_is_taken_in_double_precision():
    assert caches.threshold(100, KmerConfig(min_shared_kmer_rate=0.55)) == 56
    assert caches.threshold(0, KmerConfig(min_score=3)) == 3


def test_batch_search_equals_single_searches(spark, dna2):
    queries = spark.createDataFrame([(10, "ATCGATCG"), (11, "GCTAG"), (12, "AAAAAAAA"), (13, "TTTTTTTT")], "q int, text string")
    got = {(r.q, r.id, r.score) for r in search.batch_search(dna2, "id", "sequence", queries, "q", "text", C).collect()}
    want = {(q, r.id, r.score) for q, t in [(10, "ATCGATCG"), (11, "GCTAG"), (12, "AAAAAAAA"), (13, "TTTTTTTT")] for r in search.search(dna2, "sequence", t, C).collect()}
    assert got == want


HIGH = "AAAACTGTACGT AAAAGCATGCAT AAAATCGATCGA AAAACCCCGGGG AAAATTTTAAAA TCGTAAAACGTA GCATAAAATCGA ATCGAAAACCCC CCCCAAAATTTT TTTTAAAACCCC CCCCCCCCCCCC TTTTTTTTTTTT ACGTACGTACGT TGCATGCATGCA".split()


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs, 1)), "id int, seq string")


@pytest.mark.parametrize(
    "seqs,config,expected",
    [
        (HIGH, KmerConfig(kmer_size=4, occur_bitlen=4, max_appearance_rate=0.25), (14, 6, 3)),
        (["ATCG" * 8] * 5 + ["GCTA" * 7 + "GCT"] * 4 + ["A" * 32] * 4, KmerConfig(kmer_size=4, occur_bitlen=8, max_appearance_rate=0.2, max_appearance_nrow=3), (13, 86, 2)),
        (["ATCG" * 25] * 3, KmerConfig(kmer_size=4, occur_bitlen=8), (3, 97, 1)),
    ],
)
def test_frequency_analysis(spark, store, seqs, config, expected):
    r = frequency.analyze(table(spark, seqs), "t", "seq", config, store)
    assert (r.total_rows, r.highfreq_kmers_count, r.max_appearance_nrow_used) == expected
    assert frequency.analysis_status(store).first().highfreq_kmer_count == expected[1]


PART = ["ATCG" * 8, "ATCG" * 8, "GCTA" * 8, "T" * 32, "A" * 32, "C" * 32, "G" * 32, "ATGC" * 8, "CG" * 16, "TA" * 16]


def test_analysis_is_replaced_and_undone(spark, store):
    df = table(spark, [PART[i % 10] for i in range(1, 101)])
    k8, k4 = (KmerConfig(kmer_size=k, occur_bitlen=8, max_appearance_rate=0.15) for k in (8, 4))
    assert frequency.analyze(df, "t", "seq", k8, store).highfreq_kmers_count == 25
    assert frequency.analyze(df, "t", "seq", k8, store).highfreq_kmers_count == 25
    assert frequency.undo("t", "seq", store) == frequency.DropResult(1, 25, 1600)
    assert frequency.undo("t", "seq", store) == frequency.DropResult(0, 0, 0)
    assert frequency.analyze(df, "t", "seq", k4, store).highfreq_kmers_count == 29
    frequency.analyze(df, "t", "seq", k8, store)
    assert sorted(r.highfreq_kmer_count for r in frequency.analysis_status(store).collect()) == [25, 29]


@pytest.mark.parametrize("hf_match", ["exact", "compat"])
def test_index_leaves_frequent_keys_out(spark, store, hf_match):
    c = KmerConfig(kmer_size=4, occur_bitlen=4, max_appearance_rate=0.25, min_shared_kmer_rate=0.9, preclude_highfreq_kmer=True)
    df = table(spark, HIGH)
    with pytest.warns(UserWarning):
        index.build_index(df, "none", "t", "id", "seq", c, store)
    index.drop_index("none", store)
    frequency.analyze(df, "t", "seq", c, store)
    index.build_index(df, "i", "t", "id", "seq", c, store, hf_match=hf_match)
    found = {r.id for r in index.search_index("AAAACTGT", "t", "seq", c, store, hf_match=hf_match).collect()}
    assert found == {1}
    assert not index.search_index("CCCCTTTT", "t", "seq", c, store, hf_match=hf_match).collect()
    assert scores(df.withColumnRenamed("seq", "sequence").filter("id = 1"), "AAAACTGT", c) == [5]


def test_index_choice(spark, store):
    df = table(spark, ["ATCGATCGATCGATCGATCG"] * 20)
    a, b = KmerConfig(kmer_size=7, occur_bitlen=2), KmerConfig(kmer_size=12, occur_bitlen=4)
    assert index.select_index("t", "seq", a, store) is None
    index.build_index(df, "a", "t", "id", "seq", a, store)
    index.build_index(df, "b", "t", "id", "seq", b, store)
    assert index.select_index("t", "seq", a, store) == "a"
    assert index.select_index("t", "seq", b.with_(max_appearance_rate=0.50005), store) == "b"
    with pytest.raises(SettingError, match="no index found matching current settings: kmer_size=9"):
        index.select_index("t", "seq", a.with_(kmer_size=9), store)
    assert index.search_index("ATCGATCGATCG", "t", "seq", a, store).count() == 20
    many = index.search_many(spark.createDataFrame([(1, "ATCGATCGATCG")], "q int, s string"), "q", "s", "a", a, store)
    assert many.count() == 20
    assert index.drop_indexes_of("t", store) == 2 and store.indexes().count() == 0


def test_key_width_is_checked():
    c = KmerConfig(kmer_size=16, occur_bitlen=8)
    check_key_width(8, c)
    with pytest.raises(SettingError, match="cannot store"):
        check_key_width(4, c)
    with pytest.raises(SettingError, match="not optimal"):
        check_key_width(8, KmerConfig(kmer_size=4, occur_bitlen=8))


def test_caches(spark, store):
    s = caches.Session(spark, C, store)
    assert s.queries.stats(spark).first()[:] == (0, 0, 0, 0)
    for q in ("ATCGATCG", "ATCGATCG", "GCTAG"):
        s.query_keys(q)
    assert s.queries.stats(spark).first()[:] == (1, 2, 2, 50000)
    assert s.threshold("ATCGATCG") == 1 and s.thresholds.misses == 1
    assert {r.cache_type: r.total_entries for r in s.cache_summary().collect()} == {"query-kmer": 2, "actual_min_score": 1}
    s.set(min_score=2)
    assert len(s.queries.entries) == 2 and not s.thresholds.entries
    s.set(kmer_size=5)
    assert not s.queries.entries
    s.query_keys("ATCGATCG")
    assert s.queries.free() == 1 and s.queries.free() == 0


def test_loaded_frequent_keys(spark, store):
    c = KmerConfig(kmer_size=4, occur_bitlen=4, max_appearance_rate=0.25, min_shared_kmer_rate=0.9)
    s = caches.Session(spark, c, store)
    with pytest.raises(SettingError, match="no frequency analysis"):
        s.load_frequent("t", "seq")
    frequency.analyze(table(spark, HIGH), "t", "seq", c, store)
    plain = s.threshold("AAAACTGT")
    assert s.load_frequent("t", "seq") and s.load_parallel("t", "seq") and s.load_parallel("t", "seq")
    assert 1 <= s.threshold("AAAACTGT") < plain
    with pytest.warns(UserWarning):
        assert s.free_frequent("other", "seq") == 0
    assert s.free_frequent("t", "seq") == 6 and s.free_all_frequent() == 0
    assert s.threshold("AAAACTGT") < plain  # the shared ones stand in
    other = caches.Session(spark, c.with_(force_use_parallel_highfreq_kmer_cache=True), store)
    assert other.threshold("AAAACTGT") < plain and other.load_frequent("t", "seq") and s.load_frequent("t", "seq")
    assert other.free_all_parallel() == 6 and other.threshold("AAAACTGT") == plain and s.threshold("AAAACTGT") < plain
    assert s.free_all_frequent() == other.free_all_frequent() == 1 and s.threshold("AAAACTGT") == plain and s.free_all_parallel() == 0
    for change, text in (({"occur_bitlen": 8}, "occur_bitlen does not match.*current setting 8, required by metadata 4"), ({"max_appearance_rate": 0.8}, "current setting 0.8000, required by metadata 0.2500"), ({"max_appearance_nrow": 10}, "max_appearance_nrow does not match")):
        s.config = c.with_(**change)
        with pytest.raises(SettingError, match=text):
            s.load_frequent("t", "seq")
    s.config = c
    s.load_frequent("t", "seq")
    with pytest.warns(UserWarning):
        s.set(max_appearance_rate=0.3)
    assert s.loaded is None
    assert not caches.LruCache().entries
