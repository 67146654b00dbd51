"""The engine's queries over the given tables, and the SQL that gives the same rows.

The tables hold no DNA, so two views derive it from every whole text of
`documents`: letters a-z (either case) become bases, all else is left out.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import KmerConfig
from .functions import dna, keys
from .operators import caches, frequency, search
from .plans import index, partition
from .plans.store import Store

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_DNA2 = "ACGTACGTACGTACGTACGTACGTAC"
TO_DNA4 = "ACGTACGTAMBTACGTRCGTACGYAN"
QUERY = "ATCGATCGGCTAAGCTTACGATCGATTACGCATCGATCGGATTACAGATTACATCGATCGAACGTTAGCATCGATCGGCTA"
QUERY4 = "ATCGATCGRGCTAAGCTTMCGATCGATTACGNATCGATCGGATTACAGYTTACATCGATCG"
K5 = KmerConfig(kmer_size=5, occur_bitlen=8, min_score=30, min_shared_kmer_rate=0.5)
K8 = KmerConfig(kmer_size=8, occur_bitlen=4, max_appearance_rate=0.2, min_shared_kmer_rate=0.3)


def documents(spark: SparkSession, sf_dir: str, kind: str = "dna2") -> DataFrame:
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    target = (TO_DNA2 if kind == "dna2" else TO_DNA4) * 2
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.translate(letters, LETTERS, target).alias("seq"))


_stores: list[Store] = []


def store(spark: SparkSession) -> Store:
    """A store of its own for one query, in the shared folder; it goes when the driver ends. Where the session names no
    folder, a local one is taken if Spark runs on this machine alone, else it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-store-")
    _stores.append(Store(spark, f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"))
    return _stores[-1]


@atexit.register
def _clean() -> None:
    for s in _stores:
        try:
            s.remove(s.root)
        except Exception:  # the session may be gone already
            return


# the same views and steps in SQL


def _view(kind: str) -> str:
    target = (TO_DNA2 if kind == "dna2" else TO_DNA4) * 2
    return f"src AS (SELECT doc_id AS id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{target}') AS seq FROM documents)"


_CODES = ", ".join(f"('{c}', '{b}')" for c, bases in dna.DEGENERATE.items() for b in bases)


def _key_steps(config: KmerConfig, source: str, name: str) -> str:
    """CTEs that end in `name`(id, kmer, occ)."""
    k = config.kmer_size
    return f"""
{name}_w AS (SELECT id, pos, substr(seq, pos, {k}) AS kmer FROM (SELECT id, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS pos FROM {source})),
{name}_g AS (SELECT id, pos, kmer, translate(kmer, 'ACGT', '') AS deg FROM {name}_w),
{name}_e AS (
  SELECT id, pos, kmer FROM {name}_g WHERE deg = ''
  UNION ALL
  SELECT g.id, g.pos, replace(g.kmer, g.deg, c.nt) FROM {name}_g g JOIN (VALUES {_CODES}) c(code, nt) ON g.deg = c.code WHERE length(g.deg) = 1),
{name}_n AS (SELECT id, kmer, row_number() OVER (PARTITION BY id, kmer ORDER BY pos) AS occ FROM {name}_e),
{name} AS (SELECT id, kmer, occ FROM {name}_n WHERE occ <= {config.occurrences})"""


def _key_sql(kmer: str, occ: str, config: KmerConfig) -> str:
    digits = " + ".join(f"CAST(substr(translate({kmer}, 'ACGT', '0123'), {i + 1}, 1) AS BIGINT) * {4 ** (config.kmer_size - 1 - i)}" for i in range(config.kmer_size))
    return f"(({digits}) * {1 << config.occur_bitlen} + {occ} - 1)"


def _asked(query: str) -> str:
    return f"q AS (SELECT 0 AS id, '{query}' AS seq)"


def _scores(config: KmerConfig, kind: str, query: str, out: str, where: str = "") -> str:
    return f"""WITH {_view(kind)}, {_asked(query)}, {_key_steps(config, "src", "kk")}, {_key_steps(config, "q", "qk")},
s AS (SELECT src.id, CAST(count(qk.kmer) AS INTEGER) AS score FROM src LEFT JOIN kk ON kk.id = src.id LEFT JOIN qk ON qk.kmer = kk.kmer AND qk.occ = kk.occ GROUP BY src.id),
t AS (SELECT greatest({config.min_score}, CAST(ceil(CAST({config.min_shared_kmer_rate} AS DOUBLE) * count(*)) AS BIGINT)) AS least FROM qk)
SELECT {out} FROM s, t {where}"""


def _simple(body: str, kind: str = "dna2") -> str:
    return f"WITH {_view(kind)} {body}"


_BYTES = {
    "dna2": "list_aggregate(list_transform(generate_series(1, length(p), 2), lambda i: substr('0123456789abcdef', 4 * (instr('ACGT', substr(p, i, 1)) - 1) + instr('ACGT', substr(p, i + 1, 1)), 1)), 'string_agg', '')",
    "dna4": "translate(p, 'ACMGRSVTWYHKDBN', '123456789abcdef')",
}


def _bytes_sql(kind: str, bits: int, pad: str, multiple: int) -> str:
    padded = f"seq || repeat('{pad}', ({multiple} - length(seq) % {multiple}) % {multiple})"
    return _simple(f", d AS (SELECT id, length(seq) AS n, {padded} AS p FROM src) SELECT id, lower(printf('%08x', n * {bits})) || coalesce({_BYTES[kind]}, '') AS bytes FROM d", kind)


def _hf_rows(config: KmerConfig) -> str:
    least = f"CAST(trunc(count(*) * CAST({config.max_appearance_rate} AS DOUBLE)) AS BIGINT)"
    if config.max_appearance_nrow:
        least = f"least({least}, {config.max_appearance_nrow})"
    return f"""{_view("dna2")}, {_key_steps(config, "src", "kk")}, thr AS (SELECT {least} AS n FROM src),
hf AS (SELECT kmer, occ, count(*) AS appearance_nrow FROM kk GROUP BY kmer, occ HAVING count(*) > (SELECT n FROM thr))"""


# queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@_query(r"SELECT doc_id AS id, regexp_matches(upper(text), '^[ACGTU]*$') AS valid2, regexp_matches(upper(lang), '^[ACMGRSVTWYHKDBNU]*$') AS valid4 FROM documents")
def dna_validate(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").alias("id"), dna.is_valid(F.col("text"), "dna2").alias("valid2"), dna.is_valid(F.col("lang"), "dna4").alias("valid4"))


@_query(_simple("SELECT id, seq AS canonical FROM src"))
def dna_canonical(spark, sf_dir):
    rna = F.lower(F.translate("seq", "T", "U"))
    return documents(spark, sf_dir).select("id", dna.canonical(rna, "dna2").alias("canonical"))


@_query(_simple("SELECT id, CAST(length(seq) * 2 AS INTEGER) AS bits FROM src"))
def dna2_bit_length(spark, sf_dir):
    return documents(spark, sf_dir).select("id", dna.bit_length(F.col("seq"), "dna2").alias("bits"))


@_query(_simple("SELECT id, CAST(length(seq) * 4 AS INTEGER) AS bits FROM src", "dna4"))
def dna4_bit_length(spark, sf_dir):
    return documents(spark, sf_dir, "dna4").select("id", dna.bit_length(F.col("seq"), "dna4").alias("bits"))


@_query(_simple("SELECT id, CAST(length(seq) AS INTEGER) AS nuc_length, CAST(length(seq) AS INTEGER) AS char_length, CAST(length(seq) AS INTEGER) AS length FROM src"))
def nuc_length(spark, sf_dir):
    s = F.col("seq")
    return documents(spark, sf_dir).select("id", dna.nuc_length(s).alias("nuc_length"), dna.char_length(s).alias("char_length"), dna.length(s).alias("length"))


@_query(_bytes_sql("dna2", 2, "A", 4))
def dna2_to_bytes(spark, sf_dir):
    return documents(spark, sf_dir).select("id", F.lower(F.hex(dna.to_bytes(F.col("seq"), "dna2"))).alias("bytes"))


@_query(_bytes_sql("dna4", 4, "0", 2))
def dna4_to_bytes(spark, sf_dir):
    return documents(spark, sf_dir, "dna4").select("id", F.lower(F.hex(dna.to_bytes(F.col("seq"), "dna4"))).alias("bytes"))


@_query(_simple("SELECT id, seq, true AS same FROM src", "dna4"))
def dna_wire_roundtrip(spark, sf_dir):
    df = documents(spark, sf_dir, "dna4")
    back = dna.wire_receive(dna.wire_send(F.col("seq"), "dna4"), "dna4")
    df2 = documents(spark, sf_dir).select("id", F.col("seq").alias("_s2"), dna.wire_receive(dna.wire_send(F.col("seq"), "dna2"), "dna2").alias("_b2"))
    return df.select("id", back.alias("seq")).join(df2, "id").select("id", "seq", (F.col("_s2") == F.col("_b2")).alias("same"))


def _extreme_sql(kind: str, order: str) -> str:
    codes = "seq" if kind == "dna2" else f"translate(seq, '{dna.DNA4_CODES}', '123456789ABCDEF')"
    return _simple(
        f", r AS (SELECT source, src.id, seq, row_number() OVER (PARTITION BY source ORDER BY length(seq) {order}, {codes} {order}, src.id {order}) AS k "
        "FROM src JOIN documents ON documents.doc_id = src.id) SELECT source, id, CAST(length(seq) AS INTEGER) AS n, seq FROM r WHERE k = 1",
        kind,
    )


def _extreme(spark, sf_dir, kind, pick):
    """Of each source the least or greatest sequence in the order of DNA values."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "source")
    df = documents(spark, sf_dir, kind).join(sources, "id")
    best = df.groupBy("source").agg(pick(F.struct(dna.sort_key(F.col("seq"), kind).alias("k"), "id", "seq")).alias("m"))
    return best.select("source", "m.id", F.col("m.k.n").alias("n"), "m.seq")


@_query(_extreme_sql("dna2", "ASC"))
def dna2_order(spark, sf_dir):
    return _extreme(spark, sf_dir, "dna2", F.min)


@_query(_extreme_sql("dna4", "DESC"))
def dna4_order(spark, sf_dir):
    return _extreme(spark, sf_dir, "dna4", F.max)


@_query(_simple(f"SELECT id, CAST(CASE WHEN length(seq) < {len(QUERY)} OR (length(seq) = {len(QUERY)} AND seq < '{QUERY}') THEN -1 WHEN seq = '{QUERY}' THEN 0 ELSE 1 END AS INTEGER) AS cmp FROM src"))
def dna_compare(spark, sf_dir):
    return documents(spark, sf_dir).select("id", dna.compare(F.col("seq"), F.lit(QUERY), "dna2").alias("cmp"))


@_query(_simple("SELECT seq, min(id) AS first_id, max(id) AS last_id, count(*) AS n_rows FROM src GROUP BY seq HAVING count(*) > 1"))
def dna_eq_join(spark, sf_dir):
    """Rows with an equal sequence elsewhere, found by an equi-join of the sequences with those that repeat."""
    df = documents(spark, sf_dir)
    repeated = df.groupBy("seq").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("seq")
    return df.join(repeated, "seq").groupBy("seq").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n_rows"))


@_query(_simple("SELECT DISTINCT seq FROM src"))
def dna_distinct(spark, sf_dir):
    return documents(spark, sf_dir).select("seq").distinct()


@_query(_simple("SELECT seq, count(*) AS n FROM src GROUP BY seq"))
def dna_group_count(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


def _rows(config: KmerConfig, kind: str, out: str) -> str:
    return f"WITH {_view(kind)}, {_key_steps(config, 'src', 'kk')} SELECT {out} FROM kk"


def _keys_query(spark, sf_dir, config, kind):
    return keys.spelled(documents(spark, sf_dir, kind), "id", "seq", config).select("id", "kmer", "occ", "key")


@_query(_rows(K8, "dna2", f"id, kmer, occ, {_key_sql('kmer', 'occ', K8)} AS key"))
def kmers_dna2(spark, sf_dir):
    return _keys_query(spark, sf_dir, K8, "dna2")


@_query(_rows(K8, "dna4", f"id, kmer, occ, {_key_sql('kmer', 'occ', K8)} AS key"))
def kmers_dna4_expand(spark, sf_dir):
    return _keys_query(spark, sf_dir, K8, "dna4")


@_query(_rows(K5, "dna4", "id, kmer, CAST(occ AS INTEGER) AS occ"))
def kmers_builtin(spark, sf_dir):
    return keys.key_rows(documents(spark, sf_dir, "dna4"), "id", "seq", K5).select("id", "kmer", F.col("occurrence").alias("occ"))


_CAP = KmerConfig(kmer_size=4, occur_bitlen=2)


@_query(_rows(_CAP, "dna2", "id, count(*) AS n_keys, max(occ) AS most") + " GROUP BY id")
def kmer_occurrence_cap(spark, sf_dir):
    rows = keys.exploded(documents(spark, sf_dir), "id", "seq", _CAP)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_keys"), F.max(keys.key_occurrence(F.col("key"), _CAP)).alias("most"))


_ZERO = KmerConfig(kmer_size=6, occur_bitlen=0)


@_query(_rows(_ZERO, "dna4", "id, count(*) AS n_keys") + " GROUP BY id")
def kmer_occ0_distinct(spark, sf_dir):
    return keys.exploded(documents(spark, sf_dir, "dna4"), "id", "seq", _ZERO).groupBy("id").agg(F.count(F.lit(1)).alias("n_keys"))


@_query(f"WITH {_asked(QUERY4)}, {_key_steps(K8, 'q', 'qk')} SELECT kmer, occ, {_key_sql('kmer', 'occ', K8)} AS key FROM qk")
def query_keys(spark, sf_dir):
    rows = spark.createDataFrame([(int(k),) for k in keys.text_keys(QUERY4, K8)], "key long")
    return rows.select(keys.key_kmer(F.col("key"), K8).alias("kmer"), keys.key_occurrence(F.col("key"), K8).alias("occ"), "key")


@_query(_scores(K5, "dna2", QUERY, "id, score"))
def matchscore_dna2(spark, sf_dir):
    return documents(spark, sf_dir).select("id", search.match_score(F.col("seq"), QUERY, K5, "empty").alias("score"))


@_query(_scores(K5, "dna4", QUERY4, "id, score"))
def matchscore_dna4(spark, sf_dir):
    return documents(spark, sf_dir, "dna4").select("id", search.match_score(F.col("seq"), QUERY4, K5, "empty").alias("score"))


_RATE = K8.with_(min_shared_kmer_rate=0.1)


@_query(_scores(_RATE, "dna2", QUERY, "id, score >= least AS matched"))
def match_scan_rate(spark, sf_dir):
    return documents(spark, sf_dir).select("id", search.matches(F.col("seq"), QUERY, _RATE, "empty").alias("matched"))


_LEAST = K5.with_(min_shared_kmer_rate=0.0)


@_query(_scores(_LEAST, "dna2", QUERY, "id, score", "WHERE score >= least"))
def match_scan_min_score(spark, sf_dir):
    return search.search(documents(spark, sf_dir), "seq", QUERY, _LEAST, "empty")[["id", "score"]]


_HF = KmerConfig(kmer_size=5, occur_bitlen=4, max_appearance_rate=0.8, min_shared_kmer_rate=0.5)


@_query(
    f"""WITH {_hf_rows(_HF)}, {_asked(QUERY)}, {_key_steps(_HF, "q", "qk")},
s AS (SELECT kk.id, CAST(count(*) AS INTEGER) AS score FROM kk JOIN qk ON qk.kmer = kk.kmer AND qk.occ = kk.occ GROUP BY kk.id),
t AS (SELECT greatest(1, greatest({_HF.min_score}, CAST(ceil(CAST({_HF.min_shared_kmer_rate} AS DOUBLE) * count(*)) AS BIGINT)) - count(hf.kmer)) AS least
      FROM qk LEFT JOIN hf ON hf.kmer = qk.kmer AND hf.occ = qk.occ)
SELECT id, score FROM s, t WHERE score >= least"""
)
def match_scan_hf_adjusted(spark, sf_dir):
    """With frequent keys loaded, a scan's threshold falls by the query's frequent keys."""
    df, s = documents(spark, sf_dir), store(spark)
    frequency.analyze(df, "documents", "seq", _HF, s, "empty")
    session = caches.Session(spark, _HF, s)
    session.load_frequent("documents", "seq")
    return search.search(df, "seq", QUERY, session, "empty").select("id", "score")


@_query(_scores(_LEAST, "dna2", QUERY, "id, score", "WHERE score >= least ORDER BY score DESC, id LIMIT 10"))
def search_topk(spark, sf_dir):
    return search.search_topk(documents(spark, sf_dir), "seq", QUERY, _LEAST, 10, "id", "empty").select("id", "score")


@_query(
    f"SELECT id, score, 'dna2' AS origin FROM ({_scores(_LEAST, 'dna2', QUERY, 'id, score', 'WHERE score >= least')}) "
    f"UNION ALL SELECT id, score, 'dna4' AS origin FROM ({_scores(_LEAST, 'dna4', QUERY, 'id, score', 'WHERE score >= least')})"
)
def search_union_dna2_dna4(spark, sf_dir):
    parts = [(documents(spark, sf_dir, kind), kind) for kind in ("dna2", "dna4")]
    return search.search_union(parts, "seq", QUERY, _LEAST, "empty").select("id", "score", "origin")


_BATCH = KmerConfig(kmer_size=12, occur_bitlen=4, min_shared_kmer_rate=0.3)
_ITEMS = f"items AS (SELECT item_id AS id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{TO_DNA2 * 2}') AS seq FROM benchmark)"


def _batch_sql(drop: str = "") -> str:
    return f"""WITH {_view("dna2")}, {_ITEMS}, {_key_steps(_BATCH, "src", "kk")}, {_key_steps(_BATCH, "items", "qk")},
n AS (SELECT id, greatest({_BATCH.min_score}, CAST(ceil(CAST({_BATCH.min_shared_kmer_rate} AS DOUBLE) * count(*)) AS BIGINT)) AS least FROM qk GROUP BY id),
s AS (SELECT qk.id AS query_id, kk.id, count(*) AS score FROM kk JOIN qk ON qk.kmer = kk.kmer AND qk.occ = kk.occ GROUP BY qk.id, kk.id)
SELECT query_id, s.id, score FROM s JOIN n ON n.id = query_id WHERE score >= least"""


def _items(spark, sf_dir):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.translate(letters, LETTERS, TO_DNA2 * 2).alias("query"))


@_query(_batch_sql())
def batch_search(spark, sf_dir):
    """Every benchmark passage against every document."""
    return search.batch_search(documents(spark, sf_dir), "id", "seq", _items(spark, sf_dir), "query_id", "query", _BATCH)


@_query(f"WITH {_hf_rows(K8)} SELECT {_key_sql('kmer', 'occ', K8)} AS uintkey, appearance_nrow FROM hf")
def hf_analysis(spark, sf_dir):
    s = store(spark)
    frequency.analyze(documents(spark, sf_dir), "documents", "seq", K8, s, "empty")
    return s.frequent().select("uintkey", "appearance_nrow")


_NROW = K8.with_(max_appearance_nrow=50)


@_query(f"WITH {_hf_rows(_NROW)} SELECT {_key_sql('kmer', 'occ', K8)} AS uintkey, appearance_nrow FROM hf")
def hf_analysis_nrow_cap(spark, sf_dir):
    return frequency.frequent_keys(documents(spark, sf_dir), "seq", _NROW).select(F.col("key").alias("uintkey"), "appearance_nrow")


@_query(f"WITH {_hf_rows(K8)} SELECT {_key_sql('kmer', 'occ', K8)} AS uintkey, appearance_nrow FROM hf")
def hf_analysis_partitioned(spark, sf_dir):
    """The same analysis over a table that was dealt into hash partitions."""
    s = store(spark)
    tables = partition.Tables(s)
    tables.save("documents", partition.dna_column(documents(spark, sf_dir), "seq", "dna2"))
    tables.partition("documents", 4)
    frequency.analyze(tables.read("documents"), "documents", "seq", K8, s, "empty")
    return s.frequent().select("uintkey", "appearance_nrow")


@_query(f"WITH {_hf_rows(K8)} SELECT CAST(1 AS BIGINT) AS dropped_analyses, count(*) AS dropped_highfreq_kmers, 64 * count(*) AS freed_storage_bytes FROM hf")
def hf_undo(spark, sf_dir):
    s = store(spark)
    frequency.analyze(documents(spark, sf_dir), "documents", "seq", K8, s, "empty")
    return frequency.undo("documents", "seq", s).frame(spark)


@_query(f"WITH {_hf_rows(K8)} SELECT 'documents' AS table_name, 'seq' AS column_name, {K8.kmer_size} AS kmer_size, {K8.occur_bitlen} AS occur_bitlen, count(*) AS highfreq_kmer_count FROM hf")
def analysis_status(spark, sf_dir):
    s = store(spark)
    frequency.analyze(documents(spark, sf_dir), "documents", "seq", K8, s, "empty")
    return frequency.analysis_status(s).select("table_name", "column_name", "kmer_size", "occur_bitlen", "highfreq_kmer_count")


@_query(_rows(K8, "dna2", f"{_key_sql('kmer', 'occ', K8)} AS key, id"))
def index_build(spark, sf_dir):
    return index.build_index(documents(spark, sf_dir), "by_seq", "documents", "id", "seq", K8, store(spark), on_short="empty").select("key", "id")


def _index_scores(config: KmerConfig) -> str:
    return f"""WITH {_view("dna2")}, {_asked(QUERY)}, {_key_steps(config, "src", "kk")}, {_key_steps(config, "q", "qk")},
t AS (SELECT greatest(1, {config.min_score}, CAST(ceil(CAST({config.min_shared_kmer_rate} AS DOUBLE) * count(*)) AS BIGINT)) AS least FROM qk),
s AS (SELECT kk.id, count(*) AS score FROM kk JOIN qk ON qk.kmer = kk.kmer AND qk.occ = kk.occ GROUP BY kk.id)
SELECT id, score FROM s, t WHERE score >= least"""


@_query(_index_scores(_RATE))
def index_search(spark, sf_dir):
    s = store(spark)
    index.build_index(documents(spark, sf_dir), "by_seq", "documents", "id", "seq", _RATE, s, on_short="empty")
    return index.search_index(QUERY, "documents", "seq", _RATE, s)


_OUT = K8.with_(max_appearance_rate=0.3, min_shared_kmer_rate=0.1, preclude_highfreq_kmer=True)


@_query(
    f"""WITH {_hf_rows(_OUT)}, {_asked(QUERY)}, {_key_steps(_OUT, "q", "q0")},
qk AS (SELECT kmer, occ FROM q0 WHERE NOT EXISTS (SELECT 1 FROM hf WHERE hf.kmer = q0.kmer AND hf.occ = q0.occ)),
t AS (SELECT greatest(1, {_OUT.min_score}, CAST(ceil(CAST({_OUT.min_shared_kmer_rate} AS DOUBLE) * count(*)) AS BIGINT)) AS least FROM qk),
s AS (SELECT kk.id, count(*) AS score FROM kk JOIN qk ON qk.kmer = kk.kmer AND qk.occ = kk.occ GROUP BY kk.id)
SELECT id, score FROM s, t WHERE score >= least"""
)
def index_search_hf_excluded(spark, sf_dir):
    df, s = documents(spark, sf_dir), store(spark)
    frequency.analyze(df, "documents", "seq", _OUT, s, "empty")
    index.build_index(df, "by_seq", "documents", "id", "seq", _OUT, s, on_short="empty")
    return index.search_index(QUERY, "documents", "seq", _OUT, s)


@_query(_batch_sql())
def index_search_many(spark, sf_dir):
    s = store(spark)
    index.build_index(documents(spark, sf_dir), "by_seq", "documents", "id", "seq", _BATCH, s, on_short="empty")
    return index.search_many(_items(spark, sf_dir), "query_id", "query", "by_seq", _BATCH, s)


@_query(_simple("SELECT id, seq FROM src"))
def partition_roundtrip(spark, sf_dir):
    tables = partition.Tables(store(spark))
    tables.save("documents", partition.dna_column(documents(spark, sf_dir), "seq", "dna2"))
    tables.partition("documents", 4)
    tables.unpartition("documents")
    return tables.read("documents")
