import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandloom.config import RANGES, KmerConfig, SettingError
from strandloom.functions import keys, sqlapi
from strandloom.operators import frequency
from strandloom.plans import index, partition
from strandloom.sources.fasta import read_fasta, write_fasta
from strandloom.streaming.ingest import ingest, read_stream_index


@pytest.mark.parametrize("name,low,high", [(n, r[1], r[2]) for n, r in RANGES.items() if not isinstance(r[0], bool)])
def test_ranges(name, low, high):
    for bad in (low - 1, high + 1):
        with pytest.raises(SettingError, match="is outside the valid range for parameter"):
            KmerConfig(**{name: bad})
    other = {"occur_bitlen": 0} if name == "kmer_size" else {}
    for good in (low, high):
        assert getattr(KmerConfig(**other, **{name: good}), name) == good


def test_joint_limit_and_refused_changes():
    c = KmerConfig(kmer_size=27, occur_bitlen=10)
    with pytest.raises(SettingError, match="exceeds maximum of 64 bits"):
        c.with_(kmer_size=28)
    assert c.kmer_size == 27


def test_settings_from_spark(spark):
    spark.conf.set("strandloom.kmer_size", "8")
    spark.conf.set("strandloom.preclude_highfreq_kmer", "on")
    try:
        c = KmerConfig.from_spark(spark)
        assert c.kmer_size == 8 and c.preclude_highfreq_kmer
        spark.conf.set("strandloom.kmer_size", "x")
        with pytest.raises(SettingError):
            KmerConfig.from_spark(spark)
    finally:
        spark.conf.unset("strandloom.kmer_size")
        spark.conf.unset("strandloom.preclude_highfreq_kmer")


def test_partitions(spark, store):
    tables = partition.Tables(store)
    df = spark.createDataFrame([(i, "ACGT" * (i + 1), f"d{i}") for i in range(8)], "id int, sequence string, description string")
    rows = sorted(df.collect())
    tables.save("t", partition.dna_column(df, "sequence", "dna2"))
    with pytest.raises(partition.TableError, match='"t" is not a partitioned table'):
        tables.unpartition("t")
    with pytest.raises(partition.TableError, match="partition_count must be at least 1"):
        tables.partition("t", 0)
    tables.partition("t", 4)
    assert tables.is_partitioned("t") and sorted(tables.read("t").collect()) == rows
    assert sum(r["count"] for r in tables.partition_sizes("t").collect()) == 8
    with pytest.raises(partition.TableError, match='"t" is already a partitioned table'):
        tables.partition("t", 2)
    frequency.analyze(tables.read("t"), "t", "sequence", KmerConfig(kmer_size=4), store)
    before = store.frequent().count()
    tables.unpartition("t")
    assert not tables.is_partitioned("t") and sorted(tables.read("t").collect()) == rows and store.frequent().count() == before > 0
    index.build_index(tables.read("t"), "i", "t", "id", "sequence", KmerConfig(kmer_size=4), store)
    assert tables.drop("t") == 1
    tables.save("plain", df)
    with pytest.raises(partition.TableError, match="at least one DNA2 or DNA4 column"):
        tables.partition("plain", 2)
    two = df.withColumn("b", F.col("sequence"))
    tables.save("two", partition.dna_column(partition.dna_column(two, "sequence", "dna2"), "b", "dna4"))
    with pytest.raises(partition.TableError, match="table has 2 DNA2/DNA4 columns, but exactly one is required"):
        tables.partition("two", 2)


def test_delete_tempfiles(spark, store):
    path = store.path("tables", "x")
    store.replace(path, spark.range(3))
    store.replace(path, spark.range(4))
    spark.range(3).write.parquet(f"{path}/v00000009-{'0' * 32}")  # a write that was cut off
    assert len(store.versions(path)) == 3 and spark.read.parquet(store.current(path)).count() == 4
    assert frequency.delete_tempfiles(store).first()[:] == (0, 0, 0)
    time.sleep(1.1)
    r = frequency.delete_tempfiles(store, 1).first()
    assert r.deleted_count == 2 and r.deleted_size > 0 and r.error_count == 0
    assert len(store.versions(path)) == 1 and spark.read.parquet(store.current(path)).count() == 4
    store.replace(path, spark.range(5))
    assert spark.read.parquet(store.current(path)).count() == 5


def test_a_write_that_fails_at_any_point_leaves_the_old_version(spark, store, monkeypatch):
    tables = partition.Tables(store)
    df = spark.createDataFrame([(1, "ATCGATCG"), (2, "GGGGAAAA")], "id int, s string")
    tables.save("t", partition.dna_column(df, "s", "dna2"))
    index.build_index(df, "i", "t", "id", "s", KmerConfig(kmer_size=4), store)
    before = sorted(index.read_index("i", store).collect())
    more = partition.dna_column(df.union(spark.createDataFrame([(3, "TTTTTTTT")], df.schema)), "s", "dna2")

    def fails(*_):
        raise OSError("the file system is gone")

    for step in ("finish", "remove"):
        with monkeypatch.context() as m:
            m.setattr(store, step, fails)
            for work in (lambda: tables.save("t", more), lambda: tables.partition("t", 2), lambda: index.build_index(more, "i", "t", "id", "s", KmerConfig(kmer_size=4), store)):
                try:
                    work()
                except OSError:
                    pass
        if step == "finish":  # nothing was finished: all is as it was
            assert not tables.is_partitioned("t") and tables.read("t").count() == 2 and sorted(index.read_index("i", store).collect()) == before
    assert tables.read("t").count() == 3


def test_a_search_reads_only_the_buckets_of_its_keys(spark, store):
    rng = random.Random(1)
    df = spark.createDataFrame([(f"s{i}", "".join(rng.choices("ACGT", k=300))) for i in range(200)], "id string, s string")
    c = KmerConfig(kmer_size=10, occur_bitlen=4)
    index.build_index(df, "i", "t", "id", "s", c, store, buckets=64)
    query = df.filter("id = 's7'").first().s[:30]
    found = index.search_index(query, "t", "s", c, store)
    assert found.filter("id = 's7'").first().score == 21
    assert {index.bucket_of(r.key, 64) == r.bucket for r in index.read_index("i", store).select("key", "bucket").distinct().collect()} == {True}
    wanted = {index.bucket_of(int(k), 64) for k in keys.text_keys(query, c)}
    assert named_buckets(found) == wanted and len(wanted) <= 21 and "PushedFilters: [In(key" in found._jdf.queryExecution().executedPlan().toString()
    few = spark.createDataFrame([(1, query)], "q int, t string")
    many = index.search_many(few, "q", "t", "i", c, store)
    assert named_buckets(many) == wanted
    assert [(r.q, r.id, r.score) for r in many.filter("id = 's7'").collect()] == [(1, "s7", 21)]


def named_buckets(df):
    """The partitions that a plan's scan of an index is restricted to."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return {int(x) for x in re.findall(r"\d+", re.search(r"PartitionFilters: \[bucket#\d+ (?:INSET|IN) \(?([\d, ]+)", text)[1])}


def test_buckets_follow_from_the_number_of_keys(spark):
    df = spark.createDataFrame([("A" * 107,)], "s string")
    assert index.buckets_for(df, "s", KmerConfig(kmer_size=8)) == index.LEAST
    big = spark.range(40_000).selectExpr("repeat('ACGT', 500) AS s")
    assert index.buckets_for(big, "s", KmerConfig(kmer_size=8)) == 64
    assert index.buckets_for(big.filter("false"), "s", KmerConfig(kmer_size=8)) == index.LEAST


def test_strange_characters_are_refused(spark, store):
    c = KmerConfig(kmer_size=4)
    for text, kind, bad in (("ACGTXACGT", "dna2", "X"), ("ACGTNACGT", "dna2", "N"), ("ACGT ACGT", "dna4", " "), ("ACGTéACGT", "dna4", "é")):
        df = spark.createDataFrame([(1, text)], "id int, s string")
        with pytest.raises(Exception, match=f"invalid character '{bad}' for {kind.upper()} type"):
            index.build_index(df, "i", "t", "id", "s", c, store, kind=kind)
    ok = spark.createDataFrame([(1, "acgtnacgu")], "id int, s string")
    assert index.build_index(ok, "i", "t", "id", "s", c, store, kind="dna4").count() == 2
    with pytest.raises(Exception, match="invalid character"):
        keys.key_rows(spark.createDataFrame([(1, "ACGTXACGT")], "id int, s string"), "id", "s", c).collect()


def test_sql_names(spark, store):
    from strandloom.operators.caches import Session

    c = KmerConfig(kmer_size=4, occur_bitlen=8, min_shared_kmer_rate=0.2)
    sqlapi.register(spark, Session(spark, c, store))
    row = spark.sql("SELECT dna2_bit_length('ATCGA') a, dna4_bit_length('ATCGA') b, nuc_length('ATCGA') n, dna2_valid('ACGN') v, dna4_valid('ACGN') w, strandloom_version() x").first()
    assert (row.a, row.b, row.n, row.v, row.w) == (10, 20, 5, False, True) and row.x
    spark.createDataFrame([(1, "ATCGATCG"), (2, "TTTTTTTT")], "id int, s string").createOrReplaceTempView("seqs")
    out = spark.sql("SELECT id, match_score(s, 'ATCGATCG') n, kmer_match(s, 'ATCGATCG') m, size(kmer_keys(s)) k FROM seqs ORDER BY id").collect()
    assert [(r.id, r.n, r.m, r.k) for r in out] == [(1, 5, True, 5), (2, 0, False, 5)]
    assert spark.table("cache_summary").count() == 2 and spark.table("analysis_status").count() == 0
    assert spark.sql("SELECT hex(dna2_to_bytes('ATCGA')) a, hex(dna4_to_bytes('ACN')) b").first()[:] == ("0000000A3600", "0000000C12F0")
    with pytest.raises(Exception, match="invalid character 'N' for DNA2 type"):
        spark.sql("SELECT match_score_dna2('ACGTN', 'ACGT')").collect()
    assert spark.sql("SELECT match_score_dna4('ACGTN', 'ACGT')").first()[0] == 1


def test_sql_commands(spark, store):
    from strandloom.operators.caches import Session

    session = sqlapi.register(spark, Session(spark, KmerConfig(kmer_size=4, occur_bitlen=4, max_appearance_rate=0.25), store))
    run = lambda s: sqlapi.run(session, s)
    df = spark.createDataFrame([(i, "AAAACCCC" if i % 2 else "GGGGTTTT") for i in range(8)], "id long, s string")
    partition.Tables(store).save("t", partition.dna_column(df, "s", "dna2"))
    r = run("CALL perform_highfreq_analysis('t', 's')").first()
    assert (r.total_rows, r.highfreq_kmers_count, r.max_appearance_nrow_used) == (8, 10, 2)
    assert run("SELECT highfreq_kmer_count FROM analysis_status").first()[0] == 10 and run("SELECT count(*) FROM highfreq_kmer").first()[0] == 10
    assert run("CALL highfreq_kmer_cache_load('t', 's')").first()[0] and run("call HIGHFREQ_KMER_CACHE_FREE('t', 's');").first()[0] == 10
    assert run("CALL parallel_highfreq_kmer_cache_load('t', 's')").first()[0] and run("CALL parallel_highfreq_kmer_cache_free_all()").first()[0] == 10
    run("CALL partition_table('t', 3)")
    assert partition.Tables(store).is_partitioned("t")
    run("CALL unpartition_table('t')")
    assert run("CALL create_index('i', 't', 'id', 's')").first().total_nrow == 8 and run("SELECT count(*) FROM gin_index_meta").first()[0] == 1
    session.query_keys("ACGTACGT")
    assert run("SELECT misses FROM query_cache_stats").first()[0] == 1 and run("CALL query_kmer_cache_free()").first()[0] == 1
    assert run("SELECT total_entries FROM cache_summary WHERE cache_type = 'query-kmer'").first()[0] == 0
    assert run("CALL drop_table('t')").first()[0] == 1 and run("SELECT count(*) FROM index_info").first()[0] == 0
    assert run("CALL undo_highfreq_analysis('t', 's')").first().dropped_highfreq_kmers == 10 and run("SELECT count(*) FROM analysis_status").first()[0] == 0
    assert run("CALL delete_tempfiles()").first().error_count == 0
    with pytest.raises(ValueError, match="no command"):
        run("CALL nothing()")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first record\nACGT\nAC\n>two\nTTTT\n\n>three  x y\r\nGG\r\nCC\r\n")
    got = sorted((r.name, r.description, r.sequence) for r in read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("one", "first record", "ACGTAC"), ("three", "x y", "GGCC"), ("two", "", "TTTT")]
    write_fasta(read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert read_fasta(spark, str(tmp_path / "out")).count() == 3


def test_streaming_ingest(spark, store, tmp_path):
    src = str(tmp_path / "src")
    config = KmerConfig(kmer_size=4)
    spark.createDataFrame([(1, "ATCGATCG")], "id long, seq string").write.parquet(src)
    read = lambda: spark.readStream.schema("id long, seq string").parquet(src)
    ingest(read(), "s", "id", "seq", config, store, str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([(2, "TTTTT")], "id long, seq string").write.mode("append").parquet(src)
    ingest(read(), "s", "id", "seq", config, store, str(tmp_path / "cp")).awaitTermination(60)
    rows = read_stream_index("s", store)
    names = spark.readStream.schema("id long, seq string").parquet(src).withColumn("id", F.concat(F.lit("n"), F.col("id")))
    ingest(names, "names", "id", "seq", config, store, str(tmp_path / "cp2")).awaitTermination(60)
    assert {r.id for r in read_stream_index("names", store).select("id").collect()} == {"n1", "n2"}
    assert rows.groupBy("id").count().orderBy("id").collect() == [(1, 5), (2, 2)]


def test_entry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 38
    assert entry.entry(spark).count() == 10


def test_postings_travel_in_blocks(spark, store):
    from strandloom.plans import postings

    some = np.concatenate([np.arange(-50, 50), np.array([2**63 - 1, -(2**63), 123456789012345])]).astype(np.int64)
    for n in (16, 64, 4096):
        assert [int(b) for b in postings.buckets_of(some, n)] == [index.bucket_of(int(k), n) for k in some]
    n = np.random.default_rng(1)
    batch = postings._blocks(n.integers(0, 1 << 20, 400_000), n.integers(0, 3000, 400_000) + 10**12, 16, False)
    assert sum(batch.column(c).nbytes for c in (5, 6, 7)) < 8 * 400_000 and len(batch) == 16
    c = KmerConfig(kmer_size=16, occur_bitlen=8)
    rows = [(i, "".join("ACGT"[i * j * j % 7 % 4] for j in range(60))) for i in (-(2**62), -1, 0, 5, 5, 2**62)] + [(None, "ACGT" * 9), (None, "ACGT" * 9), (7, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    built = index.build_index(df, "i", "t", "id", "s", c, store).select("id", "key")
    text = sorted(str(tuple(r)) for r in built.collect())
    assert text == sorted(str(tuple(r)) for r in keys.exploded(df, "id", "s", c).collect()) and len(text) > 100


def test_a_large_partition_is_dealt_over_tasks(spark, store):
    tables = partition.Tables(store)
    tables.save("t", partition.dna_column(spark.range(60_000).select("id", F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGT" * 4).alias("s")).repartition(8), "s", "dna2"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        tables.partition("t", 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(tables.read("t").inputFiles()) > 1 and tables.read("t").select("id").distinct().count() == 60_000
