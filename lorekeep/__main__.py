"""python -m lorekeep ROOT PAGES status | rebuild | force | queue | search TEXT: a knowledge base from a Parquet table of pages."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.store import CLAIM, Store
from .sources.tables import HashedEmbeddings


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("pages")
    parser.add_argument("command", choices=["status", "rebuild", "force", "queue", "search"])
    parser.add_argument("text", nargs="?", default="")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, given.root, spark.read.parquet(given.pages), HashedEmbeddings())
    if given.command == "status":
        print(json.dumps(store.status()))
    elif given.command == "queue":
        print(json.dumps(store.drain(CLAIM)))
    elif given.command == "search":
        if not given.text:
            parser.error("search needs a text")
        for row in store.find(given.text).orderBy("rank").collect():
            print(row.entry)
    else:
        print(json.dumps(store.rebuild(force=given.command == "force")))


if __name__ == "__main__":
    main()
