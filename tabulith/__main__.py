"""``python -m tabulith run TOKENS OUT`` extracts a folder of token files; ``audit OUT`` sums up what is stored."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tabulith.config import CONFIG, Config
from tabulith.plans.extract import extract
from tabulith.sinks import report, store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabulith", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="extract tables")
    run.add_argument("tokens")
    run.add_argument("out")
    run.add_argument("--config", help="YAML file of all settings")
    sub.add_parser("audit", help="sum up a stored extraction").add_argument("out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tabulith").getOrCreate()
    if a.command == "run":
        config = Config.load(a.config) if a.config else CONFIG
        found = extract(spark.read.parquet(a.tokens), config=config)
        store.write(found, f"{a.out}/store", config)
        report.write_queue(found, f"{a.out}/review_queue", config)
        report.run_log(found).write.mode("overwrite").text(f"{a.out}/log")
        report.summary(found).show(truncate=False)
    else:
        store.rejections(store.read(spark, f"{a.out}/store", "tables")["tables"]).orderBy("doc_id", "verdict").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
