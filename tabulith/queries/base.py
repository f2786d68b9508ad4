"""Registering queries: inputs are SQL that Spark and the checking engine both read."""

from __future__ import annotations

import inspect
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: Bytes of Parquet that a part holds of the tables which are dealt out; of ``lineitem`` some 160,000 rows.
PART_BYTES = 2_000_000


def named(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\{{{t}\}}", sql)]


def parts(spark: SparkSession, sf_dir: str, tables: list[str]) -> int:
    """How many parts tables are dealt to: by their bytes, so that a task's share does not grow with them."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    size = 0
    for t in tables:
        p = path(f"{sf_dir}/{t}.parquet")
        size += p.getFileSystem(conf).getContentSummary(p).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def read(spark: SparkSession, sf_dir: str, sql: str, deal: dict[str, list[str]] | None = None, n: int = 1) -> DataFrame:
    """An input query over the tables of ``sf_dir``; only the tables that it names are opened.

    ``deal`` names the columns by which a table is dealt to ``n`` parts before the query sees it.
    What groups by these columns, windows of the input among it, then needs no other exchange."""
    frame = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    dealt = lambda t: frame(t).repartition(n, *deal[t]) if deal and t in deal else frame(t)
    return spark.sql(sql, args=None, **{t: dealt(t) for t in named(sql)})


def plain(sql: str) -> str:
    """The same input query for the checking engine, whose views are named as the tables."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(name: str, oracle: str | None = None, deal: dict[str, list[str]] | None = None, **inputs: str):
    """Register f(spark, **frames): each input is SQL over ``{table}``; the oracle sees it as a view of its name.

    ``deal`` names tables and the columns by which each is dealt out, see ``read``; an input is named
    too where it is a union, which forgets how its parts were dealt. ``n_parts`` goes to functions that
    deal out what they make of them."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            n = parts(spark, sf_dir, sorted({t for v in inputs.values() for t in named(v)})) if deal else 1
            frames = {k: read(spark, sf_dir, v, deal, n) for k, v in inputs.items()}
            more = {"n_parts": n} if "n_parts" in inspect.signature(f).parameters else {}
            return f(**more, **{k: d.repartition(n, *deal[k]) if deal and k in deal else d for k, d in frames.items()})

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if oracle:
            views = ", ".join(f"{k} AS ({plain(v)})" for k, v in inputs.items())
            ORACLE_SQL[name] = f"WITH {views}{', ' + oracle.strip()[5:] if oracle.strip().upper().startswith('WITH ') else ' ' + oracle.strip()}"
        return f

    return register
