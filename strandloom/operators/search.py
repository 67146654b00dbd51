"""Scores, matches, rankings and batch search over sequences, without an index.

One query is one narrow stage: its keys are made on the driver and sequences are
scored where they are read, without a shuffle. Many queries are one equi-join on
keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KmerConfig
from ..functions.keys import broadcast_if_small, exploded, shared_count, text_keys
from .caches import Session, threshold


def match_score(seq: Column, query: str, config: KmerConfig, on_short: str = "error") -> Column:
    """Shared keys of a sequence and a query; frequent keys count like others. Null for a null sequence."""
    return shared_count(seq, text_keys(query, config), config, on_short)


def matches(seq: Column, query: str, session: Session | KmerConfig, on_short: str = "error") -> Column:
    """The match predicate: a query without keys matches nothing; else shared keys reach the threshold."""
    if isinstance(session, Session):
        config, keys = session.config, session.query_keys(query)
        least = session.threshold(query) if len(keys) else 0
    else:
        config, keys = session, text_keys(query, session)
        least = threshold(len(keys), config)
    if not len(keys):
        return F.when(seq.isNotNull(), F.lit(False))
    return shared_count(seq, keys, config, on_short) >= least


def search(df: DataFrame, seq_column: str, query: str, session: Session | KmerConfig, on_short: str = "error") -> DataFrame:
    """Matching rows with their `score`; each sequence is scored once."""
    config = session.config if isinstance(session, Session) else session
    keys = session.query_keys(query) if isinstance(session, Session) else text_keys(query, config)
    if not len(keys):
        return df.withColumn("score", F.lit(0)).filter(F.lit(False))
    least = session.threshold(query) if isinstance(session, Session) else threshold(len(keys), config)
    # not repeated by the optimiser in the filter: each sequence is scored once
    return df.withColumn("score", shared_count(F.col(seq_column), keys, config, on_short, once=True)).filter(F.col("score") >= least)


def search_topk(df: DataFrame, seq_column: str, query: str, session: Session | KmerConfig, k: int, id_column: str, on_short: str = "error") -> DataFrame:
    """The k best matches, best first, equals by id."""
    return search(df, seq_column, query, session, on_short).orderBy(F.desc("score"), id_column).limit(k)


def search_union(parts: list[tuple[DataFrame, str]], seq_column: str, query: str, session: Session | KmerConfig, on_short: str = "error") -> DataFrame:
    """Matches of several tables (frame, name of its origin) of either alphabet."""
    out = None
    for df, origin in parts:
        found = search(df, seq_column, query, session, on_short).withColumn("origin", F.lit(origin))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def batch_search(df: DataFrame, id_column: str, seq_column: str, queries: DataFrame, query_id: str, query_column: str, config: KmerConfig) -> DataFrame:
    """query_id, id, score for every matching pair: a join on keys, then counts.

    Counts are summed in part before the shuffle by pair. A key that very many
    rows have makes the join large; that is what frequency analysis finds, and
    `index.search_many` leaves such keys out.
    """
    asked = exploded(queries, query_id, query_column, config)
    sizes = asked.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"))
    least = F.greatest(F.lit(config.min_score).cast("long"), F.ceil(F.lit(float(config.min_shared_kmer_rate)) * F.col("_n")))
    shared = exploded(df, id_column, seq_column, config).join(broadcast_if_small(asked), "key").groupBy(query_id, id_column).agg(F.count(F.lit(1)).alias("score"))
    return shared.join(sizes.select(query_id, least.alias("_least")), query_id).filter(F.col("score") >= F.col("_least")).select(query_id, id_column, "score")
