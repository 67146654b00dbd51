"""Streaming ingest into an index (an extension): each micro-batch adds its postings under its own number,
so a batch that is run again replaces what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import KmerConfig
from ..functions.keys import exploded
from ..plans.store import Store


def ingest(stream: DataFrame, name: str, id_column: str, seq_column: str, config: KmerConfig, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    path = store.path("stream_index", name)
    kind = stream.schema[id_column].dataType.simpleString()
    store.replace(store.path("stream_registry", name), store.spark.createDataFrame([(name, kind)], "index_name string, id_type string"))

    def add(batch: DataFrame, number: int) -> None:
        rows = exploded(batch, id_column, seq_column, config).select("key", F.col(id_column).alias("id"))
        rows.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream_index(name: str, store: Store) -> DataFrame:
    kind = store.spark.read.parquet(store.current(store.path("stream_registry", name))).first().id_type
    return store.spark.read.schema(f"key bigint, id {kind}, batch long").parquet(store.path("stream_index", name))
