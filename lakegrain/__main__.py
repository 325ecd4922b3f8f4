"""python -m lakegrain FOLDER "select .. where .." : one statement over a folder of Parquet files."""

import sys

from pyspark.sql import SparkSession

from .session import Engine


def main(args: list[str]) -> int:
    if len(args) != 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark)
    engine.open(args[0], "T")
    for row in engine.sql(args[1]).toLocalIterator():
        print(", ".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
