"""Names for SQL: temporary functions, live views and commands of the engine in a session.

Functions take columns. The views follow the store and the session's caches: they are
made anew whenever either changes through this session. What changes something (analysis, partitions, caches,
clean-up) is a command, `CALL name(arguments)`, given to `run`, which passes any other statement on to Spark.
"""

from __future__ import annotations

import ast
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from .. import __version__
from ..config import KmerConfig
from ..operators import frequency
from ..operators.caches import Session, threshold
from ..plans import index
from ..plans.partition import Tables
from .dna import DNA4_CODES
from .keys import _row_keys, text_keys

_LENGTH = "unhex(lpad(hex(length(s) * {}), 8, '0'))"
_PAIRS = "transform(regexp_extract_all(concat(s, repeat('A', pmod(-length(s), 4))), '[ACGT]{2}', 0), p -> conv(translate(p, 'ACGT', '0123'), 4, 16))"
_SQL = {
    "dna_length": ("s STRING", "INT", "length(s)"),
    "nuc_length": ("s STRING", "INT", "length(s)"),
    "dna2_bit_length": ("s STRING", "INT", "length(s) * 2"),
    "dna4_bit_length": ("s STRING", "INT", "length(s) * 4"),
    "dna2_valid": ("s STRING", "BOOLEAN", "upper(s) rlike '^[ACGTU]*$'"),
    "dna4_valid": ("s STRING", "BOOLEAN", "upper(s) rlike '^[ACMGRSVTUWYHKDBN]*$'"),
    "dna2_to_bytes": ("s STRING", "BINARY", f"concat({_LENGTH.format(2)}, unhex(array_join({_PAIRS}, '')))"),
    "dna4_to_bytes": ("s STRING", "BINARY", f"concat({_LENGTH.format(4)}, unhex(concat(translate(s, '{DNA4_CODES}', '123456789ABCDEF'), repeat('0', length(s) % 2))))"),
    "strandloom_version": ("", "STRING", f"'{__version__}'"),
}


def capability(config: KmerConfig) -> str:
    """What sequences are worked on with. The setting that forces one has no other effect than to be told here."""
    forced = f" (forced to {config.force_simd_capability})" if config.force_simd_capability >= 0 else ""
    return f"JVM code generation and Arrow batches{forced}"


def register(spark: SparkSession, session: Session | None = None) -> Session:
    """Defines the functions above, strandloom_capability(), kmer_keys(seq), match_score(seq, query) and kmer_match(seq, query), also
    for one alphabet alone (match_score_dna2, …), with the session's settings of this moment, and the views
    analysis_status, cache_summary, query_cache_stats, min_score_cache_stats, highfreq_kmer, highfreq_kmer_meta, index_info and gin_index_meta."""
    session = session or Session(spark, KmerConfig.from_spark(spark))
    config = session.config
    for name, (args, kind, body) in {**_SQL, "strandloom_capability": ("", "STRING", f"'{capability(config)}'")}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")

    def counted(seqs: pa.Array, queries: pa.Array, alphabet: str | None):
        known: dict[str, np.ndarray] = {}
        for s, q in zip(seqs, queries):
            q = q.as_py()
            if q is None or not s.is_valid:
                yield None, 0
                continue
            if q not in known:
                known[q] = np.sort(text_keys(q, config))
            keys = _row_keys(s, config, "error", alphabet)
            yield int(np.isin(keys, known[q]).sum()), len(known[q])

    @arrow_udf(ArrayType(LongType()))
    def kmer_keys(seqs: pa.Array) -> pa.Array:
        return pa.array([None if (k := _row_keys(s, config, "error")) is None else k.tolist() for s in seqs], pa.list_(pa.int64()))

    spark.udf.register("kmer_keys", kmer_keys)
    def for_alphabet(alphabet: str | None, ending: str) -> None:
        @arrow_udf(IntegerType())
        def match_score(seqs: pa.Array, queries: pa.Array) -> pa.Array:
            return pa.array([n for n, _ in counted(seqs, queries, alphabet)], pa.int32())

        @arrow_udf(BooleanType())
        def kmer_match(seqs: pa.Array, queries: pa.Array) -> pa.Array:
            return pa.array([None if n is None else bool(m) and n >= threshold(m, config) for n, m in counted(seqs, queries, alphabet)], pa.bool_())

        spark.udf.register(f"match_score{ending}", match_score)
        spark.udf.register(f"kmer_match{ending}", kmer_match)

    for alphabet, ending in ((None, ""), ("dna2", "_dna2"), ("dna4", "_dna4")):
        for_alphabet(alphabet, ending)

    def stored() -> None:
        s = session.store
        frequency.analysis_status(s).createOrReplaceTempView("analysis_status")
        for name, frame in (("highfreq_kmer", s.frequent()), ("highfreq_kmer_meta", s.analyses()), ("index_info", s.index_info()), ("gin_index_meta", s.index_meta())):
            frame.createOrReplaceTempView(name)

    def cached() -> None:
        session.cache_summary().createOrReplaceTempView("cache_summary")
        session.queries.stats(spark).createOrReplaceTempView("query_cache_stats")
        session.thresholds.stats(spark).createOrReplaceTempView("min_score_cache_stats")

    for views, listeners in ((stored, session.store.listeners), (cached, session.listeners)):
        views()
        listeners.append(views)
    return session


def _commands(session: Session) -> dict:
    store, spark = session.store, session.spark
    tables = Tables(store)

    def one(value, name: str = "result") -> DataFrame:
        kind = {bool: "boolean", int: "bigint", str: "string"}.get(type(value))
        return spark.createDataFrame([(value,)], f"{name} {kind}") if kind else spark.createDataFrame([], f"{name} string")

    def frame(table: str) -> DataFrame:
        return tables.read(table) if store.exists(tables.path(table)) else spark.table(table)

    def build(name: str, table: str, id_column: str, column: str, kind: str = "dna2") -> DataFrame:
        index.build_index(frame(table), name, table, id_column, column, session.config, store, kind)
        return store.index_info().filter(f"index_name = '{name}'")

    return {
        "perform_highfreq_analysis": lambda table, column: frequency.analyze(frame(table), table, column, session.config, store).frame(spark),
        "undo_highfreq_analysis": lambda table, column: frequency.undo(table, column, store).frame(spark),
        "delete_tempfiles": lambda younger_than_s=60: frequency.delete_tempfiles(store, younger_than_s),
        "partition_table": lambda table, count: one(tables.partition(table, count)),
        "unpartition_table": lambda table: one(tables.unpartition(table)),
        "create_index": build,
        "drop_index": lambda name: one(index.drop_index(name, store)),
        "drop_table": lambda table: one(tables.drop(table)),
        "drop_schema": lambda schema: one(tables.drop_schema(schema)),
        "query_kmer_cache_stats": lambda: session.queries.stats(spark),
        "query_kmer_cache_free": lambda: one(session.free_queries()),
        "actual_min_score_cache_stats": lambda: session.thresholds.stats(spark),
        "actual_min_score_cache_free": lambda: one(session.free_thresholds()),
        "highfreq_kmer_cache_load": lambda table, column: one(session.load_frequent(table, column)),
        "highfreq_kmer_cache_free": lambda table, column: one(session.free_frequent(table, column)),
        "highfreq_kmer_cache_free_all": lambda: one(session.free_all_frequent()),
        "parallel_highfreq_kmer_cache_load": lambda table, column: one(session.load_parallel(table, column)),
        "parallel_highfreq_kmer_cache_free": lambda table, column: one(session.free_parallel(table, column)),
        "parallel_highfreq_kmer_cache_free_all": lambda: one(session.free_all_parallel()),
    }


def run(session: Session, statement: str) -> DataFrame:
    """`CALL name(literals)` of a command, or any statement of Spark SQL."""
    call = re.fullmatch(r"\s*CALL\s+(\w+)\s*\((.*)\)\s*;?\s*", statement, re.I | re.S)
    if not call:
        return session.spark.sql(statement)
    commands = _commands(session)
    if call[1].lower() not in commands:
        raise ValueError(f"no command {call[1]}; there are {', '.join(commands)}")
    arguments = ast.literal_eval(f"({call[2]},)") if call[2].strip() else ()
    return commands[call[1].lower()](*arguments)
