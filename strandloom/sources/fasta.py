"""FASTA files as tables (an extension: plain readers do the rest of loading)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence of each record. Records are cut at `>` at a line's start by Spark's text reader,
    so files can be split; sequence lines are joined."""
    lines = spark.read.option("lineSep", "\n>").text(path).withColumnRenamed("value", "record")
    record = F.regexp_replace("record", r"^>|\r", "")
    head = F.substring_index(record, "\n", 1)
    body = F.regexp_replace(F.when(F.instr(record, "\n") > 0, F.expr("substr(record_, instr(record_, '\n') + 1)")).otherwise(""), r"\s", "")
    return (
        lines.withColumn("record_", record)
        .select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), body.alias("sequence"))
        .filter(~((F.col("name") == "") & (F.col("sequence") == "")))
    )


def write_fasta(df: DataFrame, path: str, name: str = "name", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)
