"""``python -m spanquarry FOLDER PATTERN...``: counts and bounded offsets of text patterns in a folder's files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spanquarry.plans.engine import Collection


def main() -> None:
    ap = argparse.ArgumentParser(prog="spanquarry", description=__doc__)
    ap.add_argument("folder")
    ap.add_argument("patterns", nargs="+")
    ap.add_argument("--hex", action="store_true", help="patterns are lower-case hexadecimal")
    ap.add_argument("--most", type=int, default=100)
    given = ap.parse_args()
    spark = SparkSession.builder.appName("spanquarry").getOrCreate()
    hexes = given.patterns if given.hex else [p.encode().hex() for p in given.patterns]
    for line in Collection.from_directory(spark, given.folder).lines(hexes, given.most):
        print(line)


if __name__ == "__main__":
    main()
