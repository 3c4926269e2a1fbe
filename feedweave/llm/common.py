"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.session import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(text: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder of the cluster; it goes when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, and lost executors lose none of it."""
    folder = run_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def by_shuffle(table: DataFrame) -> DataFrame:
    """A narrow side of a join (keys and a number or two, each key once or nearly so), shuffled and hashed whatever its size.

    In a plan of many joins on growing tables each small one would else be answered through the driver, which keeps
    the memory that dozens of broadcasts took. A task hashes its share of the table, which more partitions make
    smaller; the other side is streamed and may be split where a key is hot.
    """
    return table.hint("shuffle_hash")


def by_merge(table: DataFrame) -> DataFrame:
    """A wide side of a join, shuffled and merged whatever its size: sorts spill, so no share of it has to fit in memory."""
    return table.hint("merge")
