"""python -m tidemark.cli list-tables ROOT | list-keys ROOT TABLE | dump-log PATH | components PATH"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import lossy_text
from tidemark.sources.discovery import cluster_list_keys, discover, list_tables
from tidemark.sources.formats import read_write_logs
from tidemark.store import Store


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    match args:
        case ["list-tables", root]:
            out = list_tables(discover(spark, root)).orderBy("table_name")
        case ["list-keys", root, table]:
            out = cluster_list_keys(spark, root, table).orderBy("key")
        case ["dump-log", path]:
            out = read_write_logs(spark, path, valid=False).select("log", "seq", "status", "key", "ts_ns", F.hex("checksum").alias("checksum"), lossy_text("value").alias("value")).orderBy("log", "seq")
        case ["components", path]:
            out = Store.readonly(spark, path).manifest().orderBy("generation", "ordinal")
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    for row in out.toLocalIterator():
        print(*row, sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
