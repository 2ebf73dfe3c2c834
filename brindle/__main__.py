"""python -m brindle [DBFILE] < script.sql: run a script, print its rows, write the file back if it changed."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from brindle.plans.session import Session
    from brindle.sources.dbfile import open_database, save_database

    spark = SparkSession.builder.appName("brindle").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    session = open_database(spark, args[0]) if args else Session(spark)
    sys.stdout.write(session.script(sys.stdin.read()))
    if args and session.dirty:
        save_database(session, args[0])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
