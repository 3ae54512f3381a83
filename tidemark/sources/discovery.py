"""Tables spread over nodes and shards: node/shard/namespace/table/component."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import lww
from tidemark.sources.formats import read_indexes

PARTS = ("node", "shard", "namespace", "table", "component")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row for each component with an index file below root; only the listing is read."""
    return located(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "index").load(root).select("path"))


def located(files: DataFrame) -> DataFrame:
    """node, shard, namespace, table, component and folder of index files (path); folders still being written are left out."""
    parts = F.split("path", "/")
    cols = [F.element_at(parts, i - len(PARTS) - 1).alias(name) for i, name in enumerate(PARTS)]
    return files.select(*cols, F.regexp_replace("path", "/index$", "").alias("path")).filter(~F.col("component").endswith(".writing"))


def list_tables(components: DataFrame, table: str = "table") -> DataFrame:
    return components.select(F.col(table).alias("table_name")).distinct()


def cluster_list_keys(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Keys of a table over all nodes and shards, newest timestamp of each; no values are read, no cutoff applies."""
    return lww(read_indexes(spark, f"{root.rstrip('/')}/*/*/*/{table}").select("key", "ts_ns", "component"), order=("ts_ns", "component")).select("key", "ts_ns")
